"""Classification metrics from (true, predicted) pairs.

Everything is derived from the confusion-count table ``(label_true, pred,
n)``, which has at most classes^2 rows; the only pass over the data is the
one ``groupBy(label_true, pred).count()``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatsift.settings import METRIC_TARGETS


def confusion_counts(df: DataFrame, true_col: str = "label_true", pred_col: str = "pred") -> DataFrame:
    return df.groupBy(F.col(true_col).alias("label_true"), F.col(pred_col).alias("pred")).agg(
        F.count(F.lit(1)).alias("n"))


# The count table has at most (distinct labels)^2 rows, so each report folds
# it into one row (a short array of (label_true, pred, n) structs) and derives
# every metric from that row with array functions. The data is scanned and
# aggregated once per report; the per-class rows, totals and averages are
# never joined or unioned back onto the count lineage (which would re-run the
# whole upstream plan once per branch).

def count_array(counts: DataFrame, keys: tuple[str, ...] = (), classes: list[int] | None = None) -> DataFrame:
    """``keys`` + ``_c``: the (label_true, pred, n) structs of each key. With
    ``classes``, labels outside them are folded into one (null) first, so the
    array has at most (classes + 1)^2 entries whatever the columns hold."""
    if classes is not None:
        known = {c: F.when(F.col(c).isin(*classes), F.col(c)).alias(c) for c in ("label_true", "pred")}
        counts = counts.groupBy(*keys, *known.values()).agg(F.sum("n").alias("n"))
    return counts.groupBy(*keys).agg(F.collect_list(F.struct("label_true", "pred", "n")).alias("_c"))


def _total(arr, true_cls=None, pred_cls=None):
    """Sum of ``n`` over the elements with the given true / predicted class."""
    def cond(x):
        c = F.lit(True)
        if true_cls is not None:
            c = c & (x["label_true"] == true_cls)
        if pred_cls is not None:
            c = c & (x["pred"] == pred_cls)
        return c
    return F.aggregate(F.filter(arr, cond), F.lit(0).cast("long"), lambda acc, x: acc + x["n"])


def class_stats(arr, classes: list[int]):
    """array<struct<cls, tp, fp, fn, support>>, one element per class, from
    a count array. FP counts every prediction of the class, whatever the
    true label."""
    out = []
    for c in classes:
        support = _total(arr, true_cls=c)
        tp = _total(arr, true_cls=c, pred_cls=c)
        predicted = _total(arr, pred_cls=c)
        out.append(F.struct(F.lit(c).alias("cls"), tp.alias("tp"), (predicted - tp).alias("fp"),
                            (support - tp).alias("fn"), support.alias("support")))
    return F.array(*out)


def confusion_matrix(counts: DataFrame, classes: list[int]) -> DataFrame:
    """One row per true class, one column per predicted class, zero
    cells kept (classes given explicitly so empty rows/columns exist)."""
    rows = F.array(*[
        F.struct(F.lit(r).alias("label_true"),
                 *[_total("_c", true_cls=r, pred_cls=c).alias(f"pred_{c}")
                   for c in classes])
        for r in classes])
    return count_array(counts, (), classes).select(F.inline(rows))


def _ratio(a, b):
    """Undefined ratios (zero denominator) are 0.0."""
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def _field(name, weighted=False):
    if weighted:
        return lambda x: x[name] * x["support"]
    return lambda x: x[name]


def _sum(arr, f, zero):
    return F.aggregate(arr, zero, lambda acc, x: acc + f(x))


def report(stats: DataFrame, keys: tuple[str, ...] = (), digits: int = 6) -> DataFrame:
    """Classification-report rows from ``keys`` + ``_s`` (a class_stats
    array): per class precision, recall, F1, support, then accuracy, macro
    and weighted averages (rows keyed by ``class``)."""
    s = stats.select(*keys, F.transform("_s", lambda x: x.withField(
        "precision", _ratio(x["tp"], x["tp"] + x["fp"])).withField(
        "recall", _ratio(x["tp"], x["tp"] + x["fn"]))).alias("_s"))
    s = s.select(*keys, F.transform("_s", lambda x: x.withField(
        "f1", _ratio(2 * x["precision"] * x["recall"], x["precision"] + x["recall"]))).alias("_s"))
    zero_l, zero_d = F.lit(0).cast("long"), F.lit(0.0)
    k = F.size("_s").cast("double")
    n = _sum("_s", lambda x: x["support"], zero_l)
    s = s.select(*keys, "_s", n.alias("_n"), _sum("_s", lambda x: x["tp"], zero_l).alias("_tp"),
                 *[_sum("_s", _field(m), zero_d).alias(f"_m_{m}") for m in ("precision", "recall", "f1")],
                 *[_sum("_s", _field(m, weighted=True), zero_d).alias(f"_w_{m}")
                   for m in ("precision", "recall", "f1")])

    def row(cls, p, r, f1, sup):
        return F.struct(cls.alias("class"), p.cast("double").alias("precision"), r.cast("double").alias("recall"),
                        f1.cast("double").alias("f1"), sup.cast("long").alias("support"))

    def weighted(m):
        return F.when(F.col("_n") > 0, F.col(f"_w_{m}") / F.col("_n"))

    null = F.lit(None).cast("double")
    per = F.transform("_s", lambda x: row(x["cls"].cast("string"), x["precision"], x["recall"], x["f1"], x["support"]))
    tail = F.array(
        row(F.lit("accuracy"), null, null, _ratio(F.col("_tp"), F.col("_n")), F.col("_n")),
        row(F.lit("macro avg"), *[F.col(f"_m_{m}") / k for m in ("precision", "recall", "f1")], F.col("_n")),
        row(F.lit("weighted avg"), *[weighted(m) for m in ("precision", "recall", "f1")], F.col("_n")),
    )
    rows = s.select(*keys, F.inline(F.concat(per, tail)))
    return rows.select(*keys, "class", *[F.round(c, digits).alias(c) for c in ("precision", "recall", "f1")], "support")


def classification_report(counts: DataFrame, classes: list[int], digits: int = 6) -> DataFrame:
    """Precision, recall, F1, support per class, then accuracy, macro
    and weighted averages (rows keyed by ``class``)."""
    return report(count_array(counts).select(class_stats("_c", classes).alias("_s")), digits=digits)


def error_rates(counts: DataFrame, classes: list[int], digits: int = 6) -> DataFrame:
    """Per-class false-negative rate FN/(TP+FN) and false-positive
    rate FP/(FP+TN); TN counts every row outside the class's TP/FP/FN."""
    s = count_array(counts).select(class_stats("_c", classes).alias("_s"),
                                   _sum("_c", lambda x: x["n"], F.lit(0).cast("long")).alias("_total"))
    total = F.col("_total")
    rows = F.transform("_s", lambda x: F.struct(
        x["cls"].cast("string").alias("class"),
        F.round(_ratio(x["fn"], x["tp"] + x["fn"]), digits).alias("fnr"),
        F.round(_ratio(x["fp"], total - x["tp"] - x["fn"]), digits).alias("fpr")))
    return s.select(F.inline(rows))


def target_check(counts: DataFrame, keys: tuple[str, ...], classes: Column, all_classes: list[int],
                 digits: int = 6) -> DataFrame:
    """Every key's rates against the stated targets, one row per (key,
    metric) with ``value``, ``target`` and ``met``. ``classes`` gives the key's
    ``class_stats`` array over ``_c``; its last class is the positive one.
    Targets are strict: a value equal to its target does not meet it."""
    arr = count_array(counts, keys, all_classes)
    s = arr.select(*keys, classes.alias("_s"), _sum("_c", lambda x: x["n"], F.lit(0).cast("long")).alias("_total"))
    last = F.element_at("_s", -1)
    tp, fp, fn = last["tp"], last["fp"], last["fn"]
    f1 = _sum("_s", lambda x: _ratio(2 * x["tp"], 2 * x["tp"] + x["fp"] + x["fn"]), F.lit(0.0)) / F.size("_s")
    value = {"phishing_precision": _ratio(tp, tp + fp), "phishing_recall": _ratio(tp, tp + fn), "macro_f1": f1,
             "false_negative_rate": _ratio(fn, tp + fn), "false_positive_rate": _ratio(fp, F.col("_total") - tp - fn)}
    rows = []
    for metric, (above, target) in METRIC_TARGETS.items():
        v = F.round(value[metric], digits)
        rows.append(F.struct(F.lit(metric).alias("metric"), v.alias("value"), F.lit(target).alias("target"),
                             ((v > target) if above else (v < target)).alias("met")))
    return s.select(*keys, F.inline(F.array(*rows)))


def counts_from_matrix(spark: SparkSession, matrix: list[list[int]]) -> DataFrame:
    """Confusion-count table from a published matrix (rows = true class)."""
    rows = [(i, j, int(v)) for i, r in enumerate(matrix) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, "label_true int, pred int, n long")
