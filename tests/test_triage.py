"""Whole scoring paths (V7 email, V8 URL) with the test-suite mock scorer."""

from threatsift.operators.scoring import RuleScorer
from threatsift.plans.triage import triage_messages, triage_urls

MARKERS = ("fake-bank", "phishing")


def test_email_path(spark):
    msgs = spark.createDataFrame([
        (1, "Please log in at https://fake-bank.example/verify now"),
        (2, "See https://google.com/search?q=test for details"),
        (3, "  Hello team, lunch at noon  "),
        (4, ""),
    ], "msg_id long, text string")
    v = {r.msg_id: r for r in triage_messages(msgs, RuleScorer(MARKERS), RuleScorer(MARKERS, "url")).collect()}
    assert v[1].label == "Phishing" and v[1].confidence == 0.95
    assert v[1].reason == "High-confidence phishing URL detected in content."
    assert v[2].label == "Legitimate" and v[2].confidence == 0.10
    assert v[3].label == "Legitimate" and v[3].reason == "Email body analysis: Legitimate"
    assert len(v) == 4


def test_url_path_and_allowlist(spark):
    urls = spark.createDataFrame([
        (1, "https://google.com/search?q=test"),
        (2, "http://fake-bank.example/login"),
        (3, "google.com"),
        (4, "https://google.www.com/"),
    ], "msg_id long, text string")
    v = {r.msg_id: r for r in triage_urls(urls, RuleScorer(MARKERS, "url")).collect()}
    assert (v[1].label, v[1].confidence) == ("Legitimate", 0.99) and "allowlist" in v[1].reason
    assert v[2].label == "Phishing"
    assert v[3].confidence == 0.10  # no scheme: not allowlisted, scored
    assert v[4].confidence == 0.99  # every 'www.' removed: allowlisted (parity)


def test_dedupe_plan_equals_in_place(spark):
    from threatsift.functions.text import trim_input
    from pyspark.sql import functions as F
    from threatsift.operators.scoring import LexicalScorer
    from threatsift.plans.triage import url_occurrences, url_predictions
    from threatsift.plans.views import view
    m = view(spark, "/root/testdata/sf0.001", "v_messages").select("msg_id", trim_input(F.col("text")).alias("c"))
    occ = url_occurrences(m, "c")
    a = url_predictions(occ, LexicalScorer("url"), dedupe=True)
    b = url_predictions(occ, LexicalScorer("url"), dedupe=False)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_filter_on_verdict_and_carried_columns(spark):
    """A filter on the verdict columns stays above the scoring projection
    (native scorers); carried columns pass through unchanged; the URL-only
    mode matches the URL path."""
    from pyspark.sql import functions as F
    msgs = spark.createDataFrame([
        (1, "Verify your account password at http://login-secure.example/bank now", 7),
        (2, "See https://google.com/search?q=test for details", 8),
        (3, "Hello team, lunch at noon", None),
    ], "msg_id long, text string, tag int")
    full = {r.msg_id: r for r in triage_messages(msgs, carry=("tag",)).collect()}
    assert {k: r.tag for k, r in full.items()} == {1: 7, 2: 8, 3: None}
    phish = triage_messages(msgs).filter(F.col("label") == "Phishing").collect()
    assert sorted(r.msg_id for r in phish) == sorted(k for k, r in full.items() if r.label == "Phishing")
    plan = triage_messages(msgs).filter(F.col("label") == "Phishing")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Generate")  # the filter sits above the generator
    unknown = triage_messages(msgs, with_email=False).filter(F.col("label") == "Unknown").collect()
    assert [r.msg_id for r in unknown] == [3]
