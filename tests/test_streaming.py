"""Streaming forms: windowed verdict counts and streaming triage."""

import os

from pyspark.sql import functions as F

from threatsift.operators import history as H
from threatsift.plans import q_history as QH


def test_windowed_counts_stream_equals_batch(spark, tmp_dir):
    sf = "/root/testdata/sf0.001"
    hist = QH.history_with_ts(spark, sf).filter(F.col("timestamp").isNotNull())
    path = os.path.join(tmp_dir, "hist")
    hist.write.mode("overwrite").parquet(path)
    batch = H.windowed_counts(spark.read.parquet(path))
    stream = spark.readStream.schema(hist.schema).parquet(path)
    q = (H.windowed_counts(stream, watermark="1 hour").writeStream.format("memory").queryName("win_counts")
         .outputMode("complete").trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.table("win_counts")
    assert got.exceptAll(batch).count() == 0 and batch.exceptAll(got).count() == 0


def test_triage_stream_equals_batch(spark):
    from threatsift.plans.q_streaming import q_triage_stream
    from threatsift.plans.triage import triage_messages
    from threatsift.plans.views import view
    sf = "/root/testdata/sf0.001"
    out = q_triage_stream(spark, sf)
    s = out.where("input_type = 'email'").select("id", "prediction_label", "confidence")
    d = view(spark, sf, "documents").select(F.col("doc_id").alias("msg_id"), "text")
    b = triage_messages(d).select(F.col("msg_id").alias("id"), F.col("label").alias("prediction_label"), "confidence")
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0
    from threatsift.plans.triage import triage_urls
    p = view(spark, sf, "pages").select(F.col("page_id").alias("msg_id"), F.col("url").alias("text"))
    u = triage_urls(p).select(F.col("msg_id").alias("id"), F.col("label").alias("prediction_label"), "confidence")
    streamed = out.where("input_type = 'url'").select("id", "prediction_label", "confidence")
    assert streamed.exceptAll(u).count() == 0 and u.exceptAll(streamed).count() == 0


def test_requests_of_both_types_and_explanations(spark):
    from threatsift.operators.scoring import RuleScorer
    from threatsift.plans.triage import triage_requests
    rows = [(1, "please VERIFY your account", "email", True), (2, "http://evil.example.net/login", "url", False), (3, "x", "sms", True),
            (4, None, "email", True), (5, "", "url", False), (6, "hi", None, False)]
    df = spark.createDataFrame(rows, "msg_id long, text string, input_type string, explain boolean")
    got = {r.msg_id: r for r in triage_requests(df, explain_col="explain").collect()}
    assert [w.word.strip() for w in got[1].word_importances] == ["please", "VERIFY", "your", "account"]
    assert got[2].word_importances is None and got[2].label in ("Phishing", "Legitimate") and got[4].word_importances == []
    assert got[3].label == got[6].label == "Unknown" and got[3].confidence == 0.0
    flagged = triage_requests(df, RuleScorer(("verify",)), RuleScorer(("evil",), "url")).collect()
    assert {r.msg_id: r.label for r in flagged if r.msg_id < 3} == {1: "Phishing", 2: "Phishing"}


def test_windowed_counts_appended_once_over_restarts(spark, tmp_path):
    """Each batch is a run of its own on the same checkpoint: a window is
    written when the watermark has passed its end, an entry that comes after
    that is left out, one within the delay counts."""
    from datetime import datetime, timedelta
    t0 = datetime(2024, 1, 1)
    log, sink, ckpt = (str(tmp_path / n) for n in ("log", "out", "ckpt"))

    def run(batch_id, entries):
        rows = [(m, "t", "email", label, 0.9, label == "Phishing", "", None if m is None else t0 + timedelta(minutes=m)) for m, label in entries]
        schema = "id long, input_text string, input_type string, prediction_label string, confidence double, is_phishing boolean, reason string, timestamp timestamp"
        H.append_history(spark.createDataFrame(rows, schema), log, "log", batch_id)
        H.start_windowed_counts(H.stream_history(spark, log), sink, ckpt, watermark="30 minutes").awaitTermination()
        got = spark.read.schema(H.WINDOWED_SCHEMA).parquet(sink).collect()
        return sorted(((r.window_start - t0).total_seconds() // 3600, r.label, r.n) for r in got)

    first = run(0, [(5, "Phishing"), (10, "Phishing"), (59, "Legitimate"), (70, "Phishing"), (None, "Phishing")])
    assert first == []                                                # watermark at minute 40
    second = run(1, [(20, "Phishing"), (100, "Phishing")])            # 20 comes within the delay
    assert second == [(0, "Legitimate", 1), (0, "Phishing", 3)]       # watermark at minute 70
    third = run(2, [(30, "Phishing"), (65, "Legitimate"), (160, "Phishing")])  # 30 is late, 65 is not
    assert third == [*second, (1, "Legitimate", 1), (1, "Phishing", 2)]
    assert run(3, []) == third
    # without entries after the closing of their window, stream and batch agree
    full = H.windowed_counts(H.read_history(spark, log).filter("timestamp is not null"))
    assert {(r.label, r.n) for r in full.collect() if r.window_start == t0} == {("Phishing", 4), ("Legitimate", 1)}
