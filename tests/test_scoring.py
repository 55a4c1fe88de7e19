"""Decision rules, softmax, scorers."""

import numpy as np
from pyspark.sql import functions as F

from threatsift.operators.scoring import (
    EMAIL_CLASSES, LexicalScorer, RuleScorer, PandasScorer, decide_email, decide_url, softmax)

MARKERS = ("fake-bank", "phishing")


def test_softmax_and_decisions(spark):
    df = spark.createDataFrame([([10.0, -10.0, -10.0],), ([-5.0, 5.0, 0.0],)], "l array<double>")
    p = df.select(softmax(F.col("l")).alias("p"))
    rows = p.collect()
    assert abs(sum(rows[0].p) - 1) < 1e-12 and rows[0].p[0] > 0.99
    d = p.select(*[v.alias(k) for k, v in decide_email(F.col("p")[0], F.col("p")[1], F.col("p")[2]).items()]).collect()
    assert d[0].message == "Content appears safe" and d[0].confidence > 0.9
    assert d[1].message == "Spam detected" and not d[1].is_phishing
    u = spark.createDataFrame([([-5.0, 5.0],), ([1.0, 1.0],)], "l array<double>").select(softmax(F.col("l")).alias("p"))
    du = u.select(*[v.alias(k) for k, v in decide_url(F.col("p")[0], F.col("p")[1]).items()]).collect()
    assert du[0].is_phishing and du[0].confidence > 0.9
    assert not du[1].is_phishing and du[1].confidence == 0.5


def test_safe_confidence_is_distance_from_threat(spark):
    df = spark.createDataFrame([(0.5, 0.2, 0.3)], "l double, s double, p double")
    r = df.select(*[v.alias(k) for k, v in decide_email("l", "s", "p").items()]).first()
    assert r.confidence == 0.7 and r.p_phishing == 0.3


def test_mock_scorer(spark):
    df = spark.createDataFrame([(1, "visit fake-bank now"), (2, "hello")], "id long, t string")
    r = {x.id: x for x in RuleScorer(MARKERS).predict(df, "t").collect()}
    assert r[1].is_phishing and r[1].confidence == 0.95 and r[1].p_phishing is None
    assert not r[2].is_phishing and r[2].confidence == 0.10


def test_lexical_scores_sum_to_one(spark):
    df = spark.createDataFrame([(1, "verify your bank account password now! free money $$$")], "id long, t string")
    r = LexicalScorer("email").probabilities(df, "t").first()
    assert abs(r.p_legitimate + r.p_spam + r.p_phishing - 1) < 1e-12 and r.p_phishing > r.p_legitimate


def test_pandas_scorer_chunks_and_softmax(spark):
    def factory():
        return lambda texts: np.array([[0.0, 0.0, float(len(t))] for t in texts])

    df = spark.createDataFrame([(i, "x" * i) for i in range(70)], "id long, t string")
    r = PandasScorer(factory, EMAIL_CLASSES, batch_size=32).probabilities(df, "t").orderBy("id").collect()
    assert len(r) == 70 and abs(r[0].p_phishing - 1 / 3) < 1e-12 and r[69].p_phishing > 0.99
