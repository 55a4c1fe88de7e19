import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_ORACLE
from tests.llm.helpers import SF, hard_docs, no_docs
from threatsift.llm import secret_scan as S
from threatsift.llm.queries import QUERIES
from threatsift.llm.trigram_query import clauses, trigram_query

BASE = {
    "assign": (re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A),
               lambda m: len(m.group(2)) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m.group()) >= 24),
}


def brute_base(text):
    out = [(m.start(), i, m.end()) for i, k in enumerate(S.KINDS) for m in BASE[k][0].finditer(text) if BASE[k][1](m)]
    return sorted(out)


def brute(text):
    every = set(brute_base(text))
    for rule in S.ADDED_RULES:
        every |= {(m.start(), S.KINDS.index(rule.kind), m.end()) for m in re.finditer(rule.pattern, text, re.A)}
    return sorted(every)


def written(spans):
    return ",".join(f"{S.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def expected(text):
    base = brute_base(text or "")
    return (*[sum(k == i for _, k, _ in base) for i in range(3)], hashlib.sha256(written(base).encode()).hexdigest(),
            written(brute(text or "")))


HEX, KEY = "0123456789abcdef" * 2, "AKIA" + "Q7" * 8
CASES = [
    None, "", " ", "nothing here", "password=short", "password=abcdef", "PassWord : 'abc.def='", "api_key==\"x/y+z_1\"", "ApiKey = tokens1",
    "secret=token: abcdef", "token=token=abcdef", "token  \t= abcdef", f"{KEY} and {KEY[:19]}", f"xAKIA{KEY}", f"AKIAab {KEY}",
    HEX, HEX[:23], HEX[:24] + "G" + HEX, HEX.upper(), "ghp_" + "aZ9" * 12, "xoxb-1234567890-abc", "sk_live_" + "a1B2" * 5,
    "AIza" + "b" * 35, "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeKK", "-----BEGIN RSA PRIVATE KEY-----",
    "Authorization: Bearer abcdefgh.123", "postgres://user:s3cretpw@host/db", "ünï 👍 password=abcdefg 👍 " + HEX,
    "password=abcdef " * 300, ("token " * 20_000) + "= " + "k" * 9, "a" * 200_000, "passwordpasswordpassword=aaaaaa", "Token=KKabcdef",
]


def test_cases_against_brute_force(spark):
    rows = [(i, t, "x", "y", 1) for i, t in enumerate(CASES)] + [(3, CASES[5], "x", "y", 1)] * 2 + [(None, CASES[5], None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, bits string, block int").repartition(3)
    got = S.find_secrets(df).collect()
    assert len(got) == len(rows)
    want = sorted((repr(r[0]), *expected(r[1])) for r in rows)
    assert sorted((repr(r[0]), *list(r)[1:6]) for r in got) == want


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet")
    want = {r["doc_id"]: expected(r["text"]) for r in docs.collect()}
    got = {r["doc_id"]: tuple(list(r)[1:6]) for r in QUERIES["op11_secret_scan"](spark, SF_ORACLE).collect()}
    assert got == want and sum(v[0] for v in want.values()) > 0


def test_hard_rows_and_empty_table(spark):
    assert S.find_secrets(hard_docs(spark)).count() == hard_docs(spark).count()
    empty = S.find_secrets(no_docs(spark))
    assert empty.count() == 0 and empty.columns[-2:] == ["spans", "n_added"]


@pytest.mark.parametrize("pattern,text", [
    (r"ab(cd|ef)gh", "xabefgh"), (r"(foo|ba)r+x?", "barr"), (r"[abc]de[fg]{1,2}", "cdegf"), (r"(?i:Hello)\s+world", "hELLO \t world"),
    (r"a?b?c?", "zzz"), (r"(abc)+def", "abcabcdef"), (r"x(?:longer|longest)y", "xlongesty")])
def test_query_holds_for_every_match(pattern, text):
    def holds(q):
        if q is True or isinstance(q, str):
            return q is True or q in text.lower()
        return (all if q[0] == "and" else any)(holds(p) for p in q[1])
    assert re.search(pattern, text) and holds(trigram_query(pattern))


def test_rules_without_trigrams_scan_fully():
    assert [r.name for r in S.RULES if r.query is None] == ["lower-case hexadecimal", "upper-case hexadecimal"]
    assert clauses(trigram_query("abc|xyzw")) == [("abc",), ("xyz", "yzw")] and clauses(trigram_query("ab|xyz")) is None
    assert clauses(trigram_query("(abc|def)[x-z]+(ghi|jkl)")) == [("abc", "ghi"), ("abc", "jkl"), ("def", "ghi"), ("def", "jkl")]


def test_candidates_are_few_and_complete(spark):
    """The index finds every row a rule matches, and no row without its trigrams."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(
        "doc_id", "text", S.row_key(F.col("doc_id"), F.col("text")).alias("key"))
    queries = {i: r.query for i, r in enumerate(S.RULES) if r.query is not None}
    found = S.rule_candidates(S.build_index(docs, S.trigrams_of(queries)), queries)
    keys = {(r["rule"], r["key"]) for r in found.collect()}
    rows = docs.collect()
    must = {(i, r["key"]) for r in rows for i in queries if re.search(S.RULES[i].pattern, r["text"] or "", re.A)}
    assert must <= keys and len({k for _, k in keys}) < len(rows) / 4


def test_native_plan(spark):
    plan = QUERIES["op11_secret_scan"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))
