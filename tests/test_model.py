"""Model-side operators: feature indices, token importance, URL classifier, and
the limits that earlier forms had."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threatsift.functions.text import all_words
from threatsift.operators import explain as XP
from threatsift.operators import model as MD
from threatsift.operators import sample as SM
from threatsift.operators.scoring import word_cue_counts
from threatsift.session import ensure_checkpoint_dir
from threatsift.settings import EMAIL_CUE_WORDS


def _corpus(spark, n=240):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["naïve", "ünter", "日本", "a1_b", "x" * 40]
    cues = {0: ["meeting", "team"], 1: ["offer", "prize"], 2: ["verify", "password"]}
    rows = []
    for i in range(n):
        label = i % 3
        text = [rng.choice(words) for _ in range(12)] + rng.sample(cues[label], 1) * rng.randint(1, 2)
        rng.shuffle(text)
        rows.append((i, " ".join(text), label))
    return spark.createDataFrame(rows, "id long, text string, label int")


@pytest.fixture(scope="module")
def fitted(spark):
    df = _corpus(spark)
    return df, MD.train_classifier(df, num_features=1 << 12, max_iter=20)


def test_feature_index_is_the_fitted_stage_s(spark, fitted):
    df, model = fitted
    toks = df.select(F.explode(all_words("text")).alias("token")).where("token <> ''").distinct()
    toks = toks.withColumn("text", F.col("token")).withColumn("ours", MD.feature_index(F.col("token"), 1 << 12))
    rows = model.stages[1].transform(model.stages[0].transform(toks)).select("token", "ours", "tf").collect()
    assert len(rows) > 60
    assert all(r["tf"].indices.tolist() == [r["ours"]] for r in rows)


def test_training_writes_term_vectors_once_and_no_text(spark, fitted, monkeypatch):
    """One table is written, without texts or tokens; the fit is the pipeline's own."""
    df, model = fitted
    written, cut = [], MD.cut_lineage
    monkeypatch.setattr(MD, "cut_lineage", lambda t: written.append(t.columns) or cut(t))
    again = MD.train_classifier(df, num_features=1 << 12, max_iter=20)
    assert written == [["label", "tf"]]
    plain = MD.text_pipeline(num_features=1 << 12, max_iter=20).fit(MD.with_class_weights(df))
    for m in (model, again):
        assert np.allclose(m.stages[-1].coefficientMatrix.toArray(), plain.stages[-1].coefficientMatrix.toArray(), atol=1e-9)
        assert np.array_equal(m.stages[-2].idf.toArray(), plain.stages[-2].idf.toArray())


def test_importance_is_the_change_of_the_logit(spark, fitted):
    """Take every word out of a message in turn and compare the fitted model's
    raw prediction."""
    df, model = fitted
    row = df.where("id = 7").first()
    words = row["text"].split()
    variants = [(-1, " ".join(words))] + [(i, " ".join(words[:i] + words[i + 1:])) for i in range(len(words))]
    v = spark.createDataFrame([(i, t, 0, 1.0) for i, t in variants], "i int, text string, label int, weight double")
    raw = {r["i"]: r["rawPrediction"].toArray() for r in model.transform(v).select("i", "rawPrediction").collect()}
    for target in (0, 1, 2):
        one = spark.createDataFrame([(7, row["text"], target)], "id long, text string, target int")
        got = {r["pos"]: r for r in MD.token_importance(model, one, "id", "text", "target").collect()}
        assert [got[i]["token"] for i in range(len(words))] == [w.lower() for w in words]
        # the raw prediction is centred over the classes; differences of classes are not
        coef = model.stages[-1].coefficientMatrix.toArray()
        for i in range(len(words)):
            change = raw[-1] - raw[i]
            other = (target + 1) % 3
            idx = spark.range(1).select(MD.feature_index(F.lit(words[i].lower()), 1 << 12)).first()[0]
            idf = model.stages[2].idf.toArray()[idx]
            assert np.isclose(change[target] - change[other], (coef[target, idx] - coef[other, idx]) * idf, atol=1e-9)
            assert np.isclose(got[i]["importance"], abs(coef[target, idx] * idf), atol=1e-12)


def test_url_classifier_learns_from_character_ngrams(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        bad = i % 2
        host = rng.choice(["casino", "kasino", "cazino"] if bad else ["library", "museum", "garden"]) + str(rng.randint(0, 99))
        rows.append((f"http://{host}.example.org/{rng.randint(0, 999)}", bad))
    df = spark.createDataFrame(rows, "text string, label int")
    model = MD.train_classifier(df.limit(200), MD.url_pipeline, max_iter=20)
    held = df.exceptAll(df.limit(200)).withColumn("weight", F.lit(1.0))
    out = model.transform(held.unionByName(spark.createDataFrame([("http://casin0.example.net/", 1, 1.0), ("ab", 0, 1.0)], held.schema)))
    assert model.stages[-1].numClasses == 2
    wrong = out.where("prediction <> label").count()
    assert wrong <= 2


def test_cue_counts_beyond_two_million_words(spark):
    n = (1 << 21) + 5
    df = spark.range(1).select(F.repeat(F.lit("offer "), n).alias("t"))
    c = word_cue_counts(F.col("t"), EMAIL_CUE_WORDS, already_lower=True)
    r = df.select(*[v.alias(k) for k, v in c.items()]).first()
    assert (r["spam"], r["phishing"], r["legitimate"]) == (n, 0, 0)


def test_offsets_spans_and_top_tokens_stay_in_the_row(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["see", "http://a.b/c", "www.x.org,", "été", "verify", "  two"]) for _ in range(rng.randint(0, 400))) for _ in range(12)]
    texts += ["", None, "   ", "x"]
    df = spark.createDataFrame([(i // 3, i % 3 * 10 ** 12, t, "Phishing") for i, t in enumerate(texts)],
                               "conv_id long, turn long, text string, label string")
    key = ["conv_id", "turn"]
    rows = XP.piece_rows(df, key, "text").collect()
    by = {}
    for r in rows:
        by.setdefault((r["conv_id"], r["turn"]), []).append(r)
    for i, t in enumerate(texts):
        mine = sorted(by.get((i // 3, i % 3 * 10 ** 12), []), key=lambda r: r["pos"])
        text, at = t or "", 0
        for r in mine:
            assert r["char_offset"] == at and text[at:at + len(r["token"])] == r["token"]
            at += len(r["token"])
        assert text[at:].strip() == ""
    spans = XP.url_span_rows(df, key, "text").collect()
    assert all((texts[r["conv_id"] * 3 + r["turn"] // 10 ** 12])[r["start"]:r["end"]].startswith(("http://", "www.")) for r in spans)
    top = XP.top_rows(df, key, "text", "label").collect()
    assert max(r["imp_rank"] for r in top) == 7
    plan = XP.highlight(df.withColumn("is_phishing", F.lit(True)), key, "text", "label")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_bucket_digits_follow_the_rows():
    assert SM.bucket_digits_for(10) == 2 and SM.bucket_digits_for(10 ** 12) == 7
    assert SM.bucket_digits_for(10 ** 7) < SM.bucket_digits_for(10 ** 10)


def test_no_machine_local_folder_off_a_local_master():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(*_):
                return None

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
