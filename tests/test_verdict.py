"""Verdict precedence over hand-made prediction rows (the reference's
aggregator cases, plus the branches its tests leave out)."""

from pyspark.sql import functions as F

from threatsift.operators.verdict import verdict

E_SCHEMA = ("msg_id long, _e boolean, e_is_phishing boolean, e_confidence double, e_message string, "
            "e_p_phishing double, e_p_spam double, e_p_legitimate double")
U_SCHEMA = ("msg_id long, url_pos int, is_phishing boolean, confidence double, message string, "
            "p_phishing double, p_legitimate double")


def judge(spark, email, urls):
    e = spark.createDataFrame(email, E_SCHEMA)
    u = spark.createDataFrame(urls, U_SCHEMA)
    return {r.msg_id: r for r in verdict(e, u).collect()}


def test_reference_cases(spark):
    email = [
        (1, True, False, 0.99, "Content appears safe", None, None, None),   # URL override
        (2, True, False, 0.95, "Content appears safe", None, None, None),   # weak URL -> email decides
        (3, True, False, 0.90, "Spam detected", None, None, None),          # message fallback spam
        (4, None, None, None, None, None, None, None),                      # no email: URL only
        (5, None, None, None, None, None, None, None),                      # nothing
    ]
    urls = [
        (1, 0, False, 0.99, "Domain is in the verified safe allowlist.", None, None),
        (1, 1, True, 0.85, "Phishing detected", None, None),
        (2, 0, True, 0.60, "Phishing detected", None, None),
        (4, 0, True, 0.75, "URL analysis only.", None, None),
    ]
    v = judge(spark, email, urls)
    assert (v[1].label, v[1].confidence, v[1].is_phishing) == ("Phishing", 0.85, True)
    assert v[1].reason.startswith("High-confidence")
    assert (v[2].label, v[2].confidence) == ("Legitimate", 0.95)
    assert (v[3].label, v[3].confidence, v[3].is_phishing) == ("Spam", 0.90, False)
    assert (v[4].label, v[4].is_phishing) == ("Phishing", True) and "URL analysis" in v[4].reason
    assert (v[5].label, v[5].confidence, v[5].is_phishing) == ("Unknown", 0.0, False)


def test_argmax_ignores_threshold_and_ties(spark):
    email = [
        (1, True, False, 0.55, "Content appears safe", 0.45, 0.30, 0.25),
        (2, True, False, 0.33, "Content appears safe", 1 / 3, 1 / 3, 1 / 3),
        (3, True, False, 0.5, "x", None, 0.2, 0.5),
    ]
    v = judge(spark, email, [(9, 0, False, 0.1, "", None, None)])
    assert (v[1].label, v[1].confidence, v[1].is_phishing) == ("Phishing", 0.55, True)
    assert v[1].reason == "Email analysis — Phishing: 45.00%, Spam: 30.00%, Legitimate: 25.00%"
    assert v[2].label == "Phishing"
    assert v[3].label == "Legitimate" and v[3].reason == "Email analysis — Spam: 20.00%, Legitimate: 50.00%"


def test_url_first_in_order_and_tie_break(spark):
    urls = [
        (1, 0, True, 0.81, "Phishing detected", 0.81, 0.19),
        (1, 1, True, 0.99, "Phishing detected", 0.99, 0.01),
        (2, 0, False, 0.7, "Content appears safe", 0.3, 0.7),
        (2, 1, True, 0.7, "Phishing detected", 0.7, 0.3),
    ]
    email = [(1, None, None, None, None, None, None, None), (2, None, None, None, None, None, None, None)]
    v = judge(spark, email, urls)
    assert v[1].confidence == 0.81 and v[1].reason == "High-confidence phishing URL detected — Phishing: 81.00%, Legitimate: 19.00%"
    assert v[2].label == "Legitimate" and v[2].reason == "URL analysis — Phishing: 30.00%, Legitimate: 70.00%"
