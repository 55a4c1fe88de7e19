"""Golden numbers: the published confusion matrices reproduce the published
"""

import pytest

from threatsift.operators import evaluate as EV

EMAIL = [[11962, 59, 47], [105, 10296, 1668], [97, 256, 11716]]
URL = [[99846, 2878], [4940, 104145]]


def report(spark, m, classes):
    return {r["class"]: r for r in EV.classification_report(EV.counts_from_matrix(spark, m), classes).collect()}


def test_email_report(spark):
    r = report(spark, EMAIL, [0, 1, 2])
    assert r["0"].precision == pytest.approx(0.983394, abs=1e-6)
    assert r["1"].recall == pytest.approx(0.853095, abs=1e-6)
    assert r["2"].f1 == pytest.approx(0.918902, abs=1e-6)
    assert r["accuracy"].f1 == pytest.approx(0.938353, abs=1e-6)
    assert r["macro avg"].f1 == pytest.approx(0.938043, abs=1e-6)
    assert r["weighted avg"].f1 == pytest.approx(0.938041, abs=1e-6)
    assert r["accuracy"].support == 36206


def test_url_report_and_rates(spark):
    r = report(spark, URL, [0, 1])
    assert r["accuracy"].f1 == pytest.approx(0.963089, abs=1e-6)
    assert r["1"].precision == pytest.approx(0.973109, abs=1e-6)
    er = {x["class"]: x for x in EV.error_rates(EV.counts_from_matrix(spark, URL), [0, 1]).collect()}
    assert er["1"].fnr == pytest.approx(0.045286, abs=1e-6) and er["1"].fpr == pytest.approx(0.028017, abs=1e-6)
    ee = {x["class"]: x for x in EV.error_rates(EV.counts_from_matrix(spark, EMAIL), [0, 1, 2]).collect()}
    assert ee["2"].fpr == pytest.approx(0.071053, abs=1e-6)


def test_confusion_matrix_keeps_zero_cells(spark):
    counts = spark.createDataFrame([(0, 0, 5), (2, 2, 1)], "label_true int, pred int, n long")
    m = {r.label_true: r for r in EV.confusion_matrix(counts, [0, 1, 2]).collect()}
    assert m[1].pred_0 == 0 and m[1].pred_1 == 0 and m[0].pred_0 == 5


def test_report_scans_its_source_once(spark):
    """Each report aggregates the data once: no branch re-runs the source."""
    import re
    df = spark.range(0, 300).selectExpr("CAST(id % 3 AS INT) AS label_true", "CAST(id % 5 % 3 AS INT) AS pred")
    for out in (EV.classification_report(EV.confusion_counts(df), [0, 1, 2]),
                EV.error_rates(EV.confusion_counts(df), [0, 1, 2]),
                EV.confusion_matrix(EV.confusion_counts(df), [0, 1, 2])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Range \(", plan)) == 1, plan
    rep = {r["class"]: r for r in EV.classification_report(EV.confusion_counts(df), [0, 1, 2]).collect()}
    pdf = df.toPandas()
    acc = (pdf.label_true == pdf.pred).mean()
    assert abs(rep["accuracy"]["f1"] - round(acc, 6)) < 1e-9 and rep["accuracy"]["support"] == 300


def test_targets_of_the_published_matrices(spark):
    counts = EV.counts_from_matrix(spark, EMAIL).selectExpr("'email' AS pipeline", "*")
    stats = EV.class_stats("_c", [0, 1, 2])
    rows = {r["metric"]: r for r in EV.target_check(counts, ("pipeline",), stats, [0, 1, 2]).collect()}
    tp, fn, fp = 11716, 97 + 256, 47 + 1668
    total = sum(map(sum, EMAIL))
    assert rows["phishing_precision"]["value"] == pytest.approx(tp / (tp + fp), abs=1e-6) and not rows["phishing_precision"]["met"]
    assert rows["phishing_recall"]["value"] == pytest.approx(tp / (tp + fn), abs=1e-6) and rows["phishing_recall"]["met"]
    assert rows["macro_f1"]["value"] == pytest.approx(0.938043, abs=1e-6) and rows["macro_f1"]["met"]
    assert rows["false_negative_rate"]["value"] == pytest.approx(fn / (tp + fn), abs=1e-6) and rows["false_negative_rate"]["met"]
    assert rows["false_positive_rate"]["value"] == pytest.approx(fp / (total - tp - fn), abs=1e-6)
    assert not rows["false_positive_rate"]["met"]
    # a value equal to its target does not meet it: recall 0.95 exactly
    even = EV.counts_from_matrix(spark, [[100, 0], [5, 95]]).selectExpr("'url' AS pipeline", "*")
    rows = {r["metric"]: r for r in EV.target_check(even, ("pipeline",), EV.class_stats("_c", [0, 1]), [0, 1]).collect()}
    assert rows["phishing_recall"]["value"] == 0.95 and not rows["phishing_recall"]["met"] and not rows["false_negative_rate"]["met"]
