"""Every registered query runs on the smallest tables, and every query with
an oracle matches DuckDB there (the driver repeats this at sf0.01)."""

import math

import duckdb

import __spark_entry__ as E
from threatsift.plans.views import TABLES

SF = "/root/testdata/sf0.001"


def norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def v(x):
        if isinstance(x, float):
            return round(x, 6) if not math.isnan(x) else "nan"
        return x
    return sorted((tuple(v(r[i]) for i in order) for r in rows), key=repr)


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["msg_id", "label", "confidence", "is_phishing", "reason"]
    assert df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_all_queries_against_oracle(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    bad = []
    for k, fn in qs.items():
        df = fn(spark, SF)
        rows = [tuple(r) for r in df.collect()]
        if k in sqls:
            cur = con.execute(sqls[k])
            cols = [d[0] for d in cur.description]
            if sorted(cols) != sorted(df.columns) or norm(rows, df.columns) != norm(cur.fetchall(), cols):
                bad.append(k)
    assert not bad
