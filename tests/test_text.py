"""Message parser: HTML to text, URL extraction, message cleaning."""

import random

from pyspark.sql import functions as F

from threatsift.functions import text as X


def one(spark, value, fn, dtype="string"):
    return spark.createDataFrame([(value,)], f"t {dtype}").select(fn(F.col("t"))).first()[0]


def test_html_to_text_drops_script_and_style(spark):
    assert one(spark, "<h1>Top</h1><script>var x = '<p>no</p>'</script><p>End</p>", X.html_to_text) == "Top End"
    assert one(spark, "<style>b{}</style><b>One</b> &amp; <i>two</i>", X.html_to_text) == "One & two"


# Pieces of markup and the text each contributes (None: nothing visible).
MARKUP = [
    ("<p>", None), ("</p>", None), ("<br/>", None), ('<a href="x?a=1&amp;b=2">', None), ('<a title="a>b">', None),
    ("<!-- note -->", None), ("<!-- a > b -->", None), ("<script>if (a < b) x();</script>", None), ("<style>p{}</style>", None),
    ("<SCRIPT type='x'>y</SCRIPT >", None), ("plain", "plain"), ("two words", "two words"), ("&eacute;", "é"), ("&euro;", "€"),
    ("&#8217;", "\u2019"), ("&amp;", "&"), ("&lt;b&gt;", "<b>"), ("&nbsp;", None), ("&copy;", "©"), ("&hellip;", "…"),
    ("&quot;", '"'), ("\n\t", None), ("ü 一", "ü 一"), ("<!DOCTYPE html>", None),
]


def test_html_to_text_on_spliced_markup(spark):
    """Documents put together from pieces whose visible text is known."""
    rng = random.Random(11)
    rows, want = [], []
    for _ in range(400):
        pieces = [rng.choice(MARKUP) for _ in range(rng.randint(0, 12))]
        rows.append(" ".join(m for m, _ in pieces))
        want.append(" ".join(" ".join(t for _, t in pieces if t).split()))
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string").repartition(3)
    got = {r["i"]: r for r in df.select("i", X.html_to_text(F.col("t")).alias("h"),
                                        X.simple_html_to_text(F.col("t")).alias("n")).collect()}
    assert [got[i]["h"] for i in range(len(rows))] == want
    simple = [i for i in range(len(rows)) if got[i]["n"] is not None]
    assert len(simple) > 20 and all(got[i]["n"] == want[i] for i in simple)


def test_html_to_text_unfinished_markup(spark):
    cases = {"a<script>hidden()": "a", "x <b title='": "x", "AT&T &lt 3": "AT&T < 3", "<style>p{} <p>z": "", "1 < 2": "1 < 2",
             "<p>caf&eacute; &hellip;</p>": "café …", "": ""}
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    got = {r["i"]: r["h"] for r in df.select("i", X.html_to_text(F.col("t")).alias("h")).collect()}
    # how much of an unfinished tag counts as text differs between parser versions
    assert [got[i] for i, t in enumerate(cases) if "title" not in t] == [v for t, v in cases.items() if "title" not in t]
    assert one(spark, None, X.html_to_text) is None
    spark.udf.register("ts_html_to_text", X.html_to_text_udf)
    df.createOrReplaceTempView("markup")
    assert {r["i"]: r["h"] for r in spark.sql("SELECT i, ts_html_to_text(t) AS h FROM markup").collect()} == got


def test_simple_form_equals_the_parser_on_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where(X.simple_html_to_text("html").isNotNull())
    rows = pages.select(X.simple_html_to_text("html").alias("n"), X.html_to_text_udf("html").alias("p")).collect()
    assert len(rows) > 100 and all(r.n == r.p for r in rows)


def test_extract_urls_cases(spark):
    assert one(spark, "Visit https://a.com and http://b.com and www.c.com", X.extract_urls) == [
        "https://a.com", "http://b.com", "www.c.com"]
    assert one(spark, "(see https://example.com)", X.extract_urls) == ["https://example.com"]
    assert one(spark, "no links here", X.extract_urls) == []
    assert one(spark, None, X.extract_urls) == []
    assert one(spark, 'HTTPS://X.COM/a"b <www.y.org>.', X.extract_urls) == ["HTTPS://X.COM/a", "www.y.org"]


def test_extract_urls_on_composed_texts(spark):
    """Texts composed from URLs, closing marks and words: the URLs are known."""
    rng = random.Random(3)
    texts, want = [], []
    for _ in range(300):
        text, urls = "", []
        for _ in range(rng.randint(0, 6)):
            url = rng.choice(["http://", "https://", "HTTPS://", "www.", "Www."]) + rng.choice(["a.b/c", "x-y.z?q=1&r=é", "h.i/(j)k"])
            before, after = rng.choice(["", "see ", "\t", "(", "word, "]), rng.choice([" ", "\n", "<", '"', ">", "\u3000"])
            closing = rng.choice(["", ".", ").", ",;", "]", ");"])
            text += before + url + closing + after
            urls.append(url)
        texts.append(text)
        want.append(urls)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["u"] for r in df.select("i", X.extract_urls(F.col("t")).alias("u")).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_clean_message(spark):
    assert one(spark, " \t some  words \n", X.clean_message) == "some words"
    assert one(spark, "<html><body>One<br>two &euro;</body></html>", X.clean_message) == "One two €"
    assert one(spark, "a > b &amp; c", X.clean_message) == "a > b &amp; c"
    assert one(spark, "a \n\n b", X.clean_message) == "a b"


def test_is_html(spark):
    assert one(spark, "<HTML>x", X.is_html) is True
    assert one(spark, "a </b>", X.is_html) is True
    assert one(spark, "plain < text", X.is_html) is False


def test_words_and_strip(spark):
    assert one(spark, "Café naïve THE cat_dog ok abc1 hello", X.words) == ["the", "hello"]
    assert one(spark, "   x 　", X.py_strip) == "x"
