import re

from threatsift.llm import url_filters as U
from threatsift.llm.queries import QUERIES
from tests.llm.helpers import SF

CASES = [
    (1, "http://a.net/x", "a.net", "/x", "net/", "block"),
    (2, "https://WWW.Example.NET/en/1?q=/x", "www.example.net", "/en/1", "example.net/en/", "allow"),
    (3, "http://example.net/EN/1", "example.net", "/EN/1", "net/", "block"),
    (4, "ftp://m.example.com/de/#x", "m.example.com", "/de/", "example.com/de/", "block"),
    (5, "http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
    (6, "http://x.org/fr/a", "x.org", "/fr/a", "org/fr/", "allow"),
    (7, "http://a.net", "a.net", "", None, "allow"),
    (8, "http://a.net?x=/", "a.net", "", None, "allow"),
    (9, "no scheme net/", "", "", None, "allow"),
    (10, None, "", "", None, "allow"),
    (11, "", "", "", None, "allow"),
    (12, "http://www.casino-win.example.org/fr", "www.casino-win.example.org", "/fr", None, "block"),
    (13, "http://a://b.net/c", "a:", "//b.net/c", None, "allow"),
    (14, "http://a.net/x", "a.net", "/x", "net/", "block"),
    (15, "x\ny://É.net/é#", "É.net", "/é", "net/", "block"),
]


def test_cases_with_clashing_columns(spark):
    rows = [(c[0], c[1], "old", "old", "old") for c in CASES]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string, _tokens string")
    got = {r["page_id"]: r for r in U.judge_urls(df).collect()}
    for page, _, host, path, rule, verdict in CASES:
        r = got[page]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict), page


def test_very_long_url_repeated_rows_and_empty_table(spark):
    long = "http://a.example.net/en/" + "x/" * 50_000
    df = spark.createDataFrame([(1, long), (1, long), (None, "http://b.org/fr/")], "page_id long, url string")
    rows = U.judge_urls(df).collect()
    assert sorted(r["rule"] for r in rows) == ["example.net/en/", "example.net/en/", "org/fr/"]
    empty = U.judge_urls(spark.createDataFrame([], "page_id long, url string"))
    assert empty.count() == 0 and "verdict" in empty.columns


def test_index_loses_no_rule(spark):
    """Every rule that matches by running all expressions is also fetched."""
    rules = tuple(U.host_path_rule(v, t) for v, t in (
        ("block", "com/"), ("allow", "example.com/en/"), ("block", "ththin.example.com/en/"), ("allow", "org/es/"),
        ("block", "example.org/es/"), ("allow", "net/de/")))
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    for r in U.judge_urls(pages, listed=rules, method=()).collect():
        fits = [x for x in rules if re.search(x.pattern, r["host"] + r["path"])]
        best = max(fits, key=lambda x: (x.weight, [-ord(c) for c in x.name])) if fits else None
        assert r["rule"] == (best.name if best else None)
        assert r["verdict"] == (best.verdict if best else "allow")


def test_rarest_token_holds_the_rule():
    index = U.rule_index((U.host_path_rule("block", "example.com/de/"),), {"example": 9, "com": 5, "de": 2})
    assert list(index) == ["de"]


def test_native_plan(spark):
    plan = QUERIES["op9_url_filters"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "Exchange"))
