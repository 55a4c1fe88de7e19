"""Seeded sampling and splitting invariants."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from threatsift.operators import sample as SM


def data(spark, n=3000):
    rows = [(i, f"t{i}", 0 if i % 10 < 6 else (1 if i % 10 < 9 else 2)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, text string, label int")


def test_hash_rank_is_a_permutation_per_class(spark):
    r = SM.hash_rank(data(spark), "id").select("label", "rank").collect()
    by = {}
    for x in r:
        by.setdefault(x.label, []).append(x.rank)
    for ranks in by.values():
        assert sorted(ranks) == list(range(1, len(ranks) + 1))


def test_hash_rank_independent_of_partitioning(spark):
    d = data(spark)
    a = SM.hash_rank(d.repartition(1), "id").select("id", "rank")
    b = SM.hash_rank(d.repartition(8), "id").select("id", "rank")
    assert a.exceptAll(b).count() == 0


def test_balance_exact(spark):
    b = SM.balance_undersample(data(spark), "id")
    c = Counter(r.label for r in b.select("label").collect())
    assert set(c.values()) == {300}


def test_split_sizes_and_disjoint(spark):
    s = SM.stratified_split(data(spark), "id")
    rows = s.select("id", "label", "split").collect()
    assert len({r.id for r in rows}) == 3000
    c = Counter(r.split for r in rows)
    assert c == {"train": 2100, "validation": 450, "test": 450}
    per = Counter((r.split, r.label) for r in rows)
    assert per[("train", 0)] == 1260 and per[("test", 2)] == 45


def test_quota_rules():
    q = SM.split_quotas({0: 7, 1: 5, 2: 3})
    assert sum(sum(v) for v in q.values()) == 15
    assert sum(v[0] for v in q.values()) == 15 - 5  # n_temp = ceil(0.3 * 15) = 5
    with pytest.raises(ValueError):
        SM.split_quotas({0: 10, 1: 1})


def test_seeded_shuffle_positions(spark):
    s = SM.seeded_shuffle(data(spark, 500), "id").select("shuffle_pos").collect()
    assert [r.shuffle_pos for r in s] == list(range(1, 501))
