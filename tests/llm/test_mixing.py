import numpy as np
import pytest
from pyspark.sql import functions as F

from threatsift.llm import mixing as M
from threatsift.llm.queries import QUERIES
from tests.llm.helpers import SF, hard_docs, no_docs


def filled(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Targets by repeated resharing, as the contract words it."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, free = share * sum(sizes.values()), {s: 0.0 for s in names}, set(names)
    while free and left > 1e-9:
        unit = left / sum(w[s] for s in free)
        over = [s for s in free if target[s] + unit * w[s] >= cap * sizes[s] - 1e-9]
        if not over:
            for s in free:
                target[s] += unit * w[s]
            break
        for s in over:
            left -= cap * sizes[s] - target[s]
            target[s] = cap * sizes[s]
            free.discard(s)
    return target


def test_query_meets_targets(spark):
    rows = QUERIES["op10_source_mixing"](spark, SF).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sizes = {}
    for d in docs.values():
        sizes[d["source"]] = sizes.get(d["source"], 0) + len(d["text"].split())
    want = filled(sizes)
    taken = {}
    assert len(rows) == len(docs)
    for r in rows:
        s = docs[r["doc_id"]]["source"]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.5 + 1e-6


def test_reruns_agree_for_any_partitioning_and_buckets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a = {(r["doc_id"], r["taken"]) for r in M.mix(docs, bucket_rows=20, fan=2).collect()}
    b = {(r["doc_id"], r["taken"]) for r in M.mix(docs.repartition(5, F.rand(1)), bucket_rows=20, fan=2).collect()}
    assert a == b and len(a) == docs.count()


def test_hard_rows(spark):
    docs = hard_docs(spark)
    got = M.mix(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["taken"] <= 2 * r["size"] and (r["size"] > 0 or r["taken"] == 0)
    assert {r["source"] for r in got} == {None, "s0", "s1", "s2"}
    assert M.mix(no_docs(spark)).count() == 0


def test_expectations_are_kept():
    """Pivotal steps keep the words of a bucket and every document's expectation."""
    rng = np.random.default_rng(0)
    size, frac = np.array([5.0, 50, 500, 7, 70]), np.array([0.3, 0.6, 0.2, 0.9, 0.5])
    mean = np.zeros(5)
    for _ in range(4000):
        out, held = M.pivot_bucket(size, frac, rng.random(5))
        assert (out * size).sum() == pytest.approx((frac * size).sum())
        assert all(x in (0, 1) for i, x in enumerate(out) if i != held)
        mean += out / 4000
    assert np.abs(mean - frac).max() < 0.04


def test_repeat_rows_keeps_columns_and_counts(spark):
    docs = hard_docs(spark)
    copies = M.mix(docs.withColumn("doc_id", F.xxhash64("doc_id", "source", "text")), whole_copies=True)
    want = copies.agg(F.sum("copies")).first()[0]
    out = M.repeat_rows(docs)
    assert out.columns == docs.columns and out.count() == want
