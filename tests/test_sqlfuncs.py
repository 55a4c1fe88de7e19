"""SQL-registered functions equal the Column functions."""

import random

from pyspark.sql import functions as F

from threatsift.functions import sqlfuncs, text as X, urls as U
from tests.test_urls import _composed


def test_sql_functions_match_columns(spark):
    sqlfuncs.register(spark)
    rng = random.Random(9)
    noise = ["".join(rng.choice("abX09-._~:/?#[]@!$&'()*+,;=% ü\u2100") for _ in range(rng.randint(0, 25))) for _ in range(200)]
    vals = [_composed(rng)[0] for _ in range(200)] + noise + ["Visit https://a.com) and WWW.b.org;", None, "<html>x</html>"]
    spark.createDataFrame([(v,) for v in vals], "u string").createOrReplaceTempView("sqlf_in")
    got = spark.sql("SELECT u, ts_normalize_url(u) AS n, ts_url_domain(ts_normalize_url(u)) AS d, "
                    "ts_extract_urls(u) AS e, ts_is_html(u) AS h, ts_strip(u) AS s FROM sqlf_in").collect()
    exp = spark.table("sqlf_in").select(
        "u", U.normalize_url(F.col("u")).alias("n"), U.url_domain(U.normalize_url(F.col("u"))).alias("d"),
        X.extract_urls(F.col("u")).alias("e"), X.is_html(F.col("u")).alias("h"), X.py_strip(F.col("u")).alias("s")).collect()
    key = lambda r: (r.u is None, r.u or "")
    assert sorted(got, key=key) == sorted(exp, key=key)
    rows = spark.sql("SELECT i.u, t.url_pos, t.url FROM sqlf_in i, LATERAL ts_explode_urls(i.u) t").collect()
    want = spark.table("sqlf_in").select("u", F.posexplode(X.extract_urls(F.col("u")))).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, want)) and rows
    r = spark.sql("SELECT ts_html_to_text('<p>caf&eacute;</p>') AS t, ts_allowlisted('google.com') AS a").first()
    assert r.t == "café" and r.a is True
