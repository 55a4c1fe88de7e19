import numpy as np
import random

from pyspark.sql import functions as F

from threatsift.llm import gbdt, quality, textbuf, toxicity
from threatsift.llm.common import held_out
from threatsift.llm.queries import QUERIES
from tests.llm.helpers import HARD_TEXTS, SF, hard_docs, labels_of, no_docs


def auc(score, y):
    order = np.argsort(np.argsort(score))
    n1 = y.sum()
    return (order[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(y) - n1))


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    trees = gbdt.fit(x[:3000], y[:3000], trees=60)
    p = trees.probability(x[3000:])
    assert auc(p, y[3000:]) > 0.98
    assert abs(p.mean() - y[3000:].mean()) < 0.03
    slow = []
    for row in x[3000:3050]:                       # traversal, node by node
        z = trees.base
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            z += leaf[node - len(f)]
        slow.append(z)
    assert np.allclose(slow, trees.margin(x[3000:3050]))


def test_one_class_or_no_rows_give_a_constant():
    for y in (np.zeros(0), np.zeros(5), np.ones(5)):
        p = gbdt.fit(np.zeros((len(y), 2)), y).probability(np.zeros((3, 2)))
        assert len(set(p)) == 1 and 0 < p[0] < 1


def test_statistics_count_what_they_name():
    x = dict(zip(quality.FEATURES, quality.statistics(["Ab cd cd cd!\nx | 12"])[0]))
    assert np.isclose(x["log_words"], np.log1p(7)) and np.isclose(x["log_lines"], np.log1p(2))
    assert np.isclose(x["repeat_adjacent"], 1 / 7) and np.isclose(x["pipe"], 1 / 7) and np.isclose(x["bang"], 1 / 7)
    assert np.isclose(x["distinct_words"], 6 / 7) and np.isclose(x["digits"], 2 / 19)
    assert not quality.statistics(["", ""]).any()
    texts = [t or "" for t in HARD_TEXTS]
    alone = np.concatenate([quality.statistics([t]) for t in texts])
    assert np.allclose(alone, quality.statistics(texts), rtol=1e-5)


def test_quality_query_separates_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in QUERIES["op6_quality"](spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").where(held_out(F.col("doc_id"))).collect()]
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    y = np.array([r["quality"] for r in labels])
    s = np.array([rows[r["doc_id"]]["score"] for r in labels])
    assert all(rows[r["doc_id"]]["held_out"] for r in labels)
    assert auc(s, y) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows.values())


def test_quality_hard_rows(spark):
    docs = hard_docs(spark)
    labels = labels_of(spark, [(0, 1, 0), (1, 0, 0), (1, 0, 0), (None, 1, 1), (3, None, None), (5, 1, 0)])
    rows = quality.score_quality(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    none = labels_of(spark, [])
    assert len({r["score"] for r in quality.score_quality(docs, none).collect()}) == 1
    assert quality.score_quality(no_docs(spark), labels).count() == 0
    kept = quality.keep_good(docs, none, threshold=0.4)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert quality.keep_good(docs, none, threshold=0.6).count() == 0


def _toxic_corpus(rng, n):
    vocabulary = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    bad = ["zkworthling", "vilqrant"]
    texts, y = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 300))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(max(1, len(words) // 60)):
                w = rng.choice(bad)
                words.insert(rng.randrange(len(words)), w[:rng.randint(8, len(w))] + rng.choice(["", "a", "ers", "y", "oo"]))
        texts.append(" ".join(words))
        y.append(int(toxic))
    return texts, y


def test_toxicity_finds_unseen_misspellings(spark):
    texts, y = _toxic_corpus(random.Random(7), 900)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    labels = labels_of(spark, [(i, 1, v) for i, v in enumerate(y)])
    model = toxicity.fit_toxicity(docs, labels)
    rng = random.Random(8)
    fresh, truth = _toxic_corpus(rng, 200)
    p = model.score(fresh)
    assert auc(p, np.array(truth)) > 0.97
    plain = fresh[1]
    assert model.score([plain + " zkworthlngz"])[0] > model.score([plain])[0]


def test_toxicity_query_contract(spark):
    rows = QUERIES["op2_toxicity"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(rows) == docs.count()
    folds = {r["doc_id"]: r["h"] for r in docs.select("doc_id", held_out(F.col("doc_id")).alias("h")).collect()}
    assert all(r["held_out"] == folds[r["doc_id"]] and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_toxicity_hard_rows(spark):
    docs = hard_docs(spark)
    none = labels_of(spark, [])
    rows = toxicity.score_toxicity(docs, none).collect()
    assert len(rows) == docs.count() and len({r["score"] for r in rows}) == 1
    assert toxicity.score_toxicity(no_docs(spark), none).count() == 0
    x = toxicity.pooled(["", "a b", "", "İstanbul ß"], np.zeros(toxicity.TABLE, np.float32))
    assert x.shape == (4, 3) and not x.any()
    assert toxicity.pooled([], np.zeros(toxicity.TABLE, np.float32)).shape == (0, 3)


def test_blocks_do_not_change_scores():
    rng = np.random.default_rng(2)
    table = rng.normal(size=toxicity.TABLE).astype(np.float32)
    texts = ["alpha beta gamma", "", "beta " * 50, "delta"]
    whole = toxicity.pooled(texts, table)
    assert np.allclose(whole, np.concatenate([toxicity.pooled([t], table) for t in texts]), atol=1e-6)
    assert [len(b) for _, b in textbuf.blocks(texts, limit=20)] == [2, 1, 1]


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {(r["doc_id"], r["score"]) for r in quality.score_quality(docs, labels).collect()}
    assert a == {(r["doc_id"], r["score"]) for r in quality.score_quality(docs, flipped).collect()}
