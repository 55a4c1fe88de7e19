"""Queries for profiling, summaries and classification metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatsift.operators import clean as C
from threatsift.operators import evaluate as EV
from threatsift.operators import profile as PR
from threatsift.operators import sample as SM
from threatsift.plans import sqltext as S
from threatsift.plans.catalog import query
from threatsift.plans.q_clean import canonical_email, sql_canonical_email, sql_map_label, sql_relabel
from threatsift.plans.q_triage import oracle_triage_messages, oracle_triage_urls
from threatsift.plans.triage import triage_messages, triage_urls
from threatsift.plans.views import sub, view
from threatsift.session import fresh_path
from threatsift.settings import EMAIL_LABEL_MAP, LEGACY_EMAIL_LABEL_MAP, NEGATIVE_CLASS_NAMES, POSITIVE_CLASS_NAMES, SEED, STOP_WORDS

MSG = sub("v_messages")
RAW = sub("v_raw_labels")
PREDS = sub("v_preds")


@query("label_distribution", lambda: f"SELECT raw_label, count(*) AS n_rows FROM {RAW} r GROUP BY raw_label")
def q_label_distribution(spark, sf_dir):
    """Rows per raw label, NULL included."""
    return PR.label_distribution(view(spark, sf_dir, "v_raw_labels"), "raw_label")


def _profile(spark, sf_dir):
    return PR.text_profile(view(spark, sf_dir, "v_messages"), "text", ["source"])


def sql_words_ws(e: str) -> str:
    x = S.collapse(f"coalesce({e}, '')")
    return f"CASE WHEN {x} = '' THEN 0 ELSE len(string_split({x}, ' ')) END"


SQL_PROFILE = (
    f"SELECT source, count(*) AS n_rows, round(avg(length(coalesce(text, ''))), 6) AS avg_chars, "
    f"max(length(coalesce(text, ''))) AS max_chars, round(avg({sql_words_ws('text')}), 6) AS avg_words, "
    f"max({sql_words_ws('text')}) AS max_words, "
    f"count(*) FILTER (WHERE regexp_matches(lower(coalesce(text, '')), 'https?://|www\\.')) AS n_with_url, "
    f"round(avg(CASE WHEN regexp_matches(lower(coalesce(text, '')), 'https?://|www\\.') THEN 1.0 ELSE 0.0 END), 6) AS url_share, "
    f"round(avg({S.char_count('text', '!')}), 6) AS avg_exclamations, round(avg({S.char_count('text', '$')}), 6) AS avg_dollars "
    f"FROM {MSG} m GROUP BY source"
)


def _round(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("text_length_stats", lambda: f"SELECT source, n_rows, avg_chars, max_chars, avg_words, max_words FROM ({SQL_PROFILE}) p")
def q_text_length_stats(spark, sf_dir):
    """Mean / max characters and whitespace words per source."""
    p = _profile(spark, sf_dir).select("source", "n_rows", "avg_chars", "max_chars", "avg_words", "max_words")
    return _round(p, {"avg_chars", "avg_words"}).withColumn("max_words", F.col("max_words").cast("long"))


@query("url_rate", lambda: f"SELECT source, n_rows, n_with_url, url_share FROM ({SQL_PROFILE}) p")
def q_url_rate(spark, sf_dir):
    """Rows with an embedded link, and their share, per source."""
    return _round(_profile(spark, sf_dir).select("source", "n_rows", "n_with_url", "url_share"), {"url_share"})


@query("punctuation_stats", lambda: f"SELECT source, n_rows, avg_exclamations, avg_dollars FROM ({SQL_PROFILE}) p")
def q_punctuation_stats(spark, sf_dir):
    """Mean '!' and '$' per message, per source."""
    p = _profile(spark, sf_dir).select("source", "n_rows", "avg_exclamations", "avg_dollars")
    return _round(p, {"avg_exclamations", "avg_dollars"})


def sql_words(e: str) -> str:
    return f"list_filter({S.all_words(e)}, lambda w: regexp_full_match(w, '[a-z]{{3,}}'))"


@query("tokenize_words", lambda: (
    f"SELECT msg_id, CAST(len(w) AS INTEGER) AS n_words, CAST(len(list_distinct(w)) AS INTEGER) AS n_distinct "
    f"FROM (SELECT msg_id, {sql_words('text')} AS w FROM {MSG} m) t"))
def q_tokenize_words(spark, sf_dir):
    """P5: profiler words (3+ ASCII letters) per message."""
    from threatsift.functions.text import words
    m = view(spark, sf_dir, "v_messages").select("msg_id", words(F.col("text")).alias("w"))
    return m.select("msg_id", F.size("w").alias("n_words"), F.size(F.array_distinct("w")).alias("n_distinct"))


def _sql_class_group(e: str) -> str:
    return (f"CASE WHEN lower({e}) IN ({', '.join(S.lit(x) for x in POSITIVE_CLASS_NAMES)}) THEN 'positive' "
            f"WHEN lower({e}) IN ({', '.join(S.lit(x) for x in NEGATIVE_CLASS_NAMES)}) THEN 'negative' END")


@query("top_words", lambda: (
    f"SELECT class_group, word, n, rank FROM (SELECT class_group, word, n, row_number() OVER "
    f"(PARTITION BY class_group ORDER BY n DESC, word) AS rank FROM (SELECT class_group, word, count(*) AS n FROM "
    f"(SELECT {_sql_class_group('raw_label')} AS class_group, unnest({sql_words('text')}) AS word FROM {RAW} r) x "
    f"WHERE class_group IS NOT NULL AND word NOT IN ({', '.join(S.lit(w) for w in STOP_WORDS)}) "
    f"GROUP BY class_group, word) c) t WHERE rank <= 10"), headline=True)
def q_top_words(spark, sf_dir):
    """Top 10 non-stop words of the positive and negative classes."""
    r = view(spark, sf_dir, "v_raw_labels").select(C.class_group(F.col("raw_label")).alias("class_group"), "text")
    r = r.filter(F.col("class_group").isNotNull())
    return PR.top_words(r, "text", "class_group").select("class_group", "word", "n", F.col("rank").cast("long"))


def _sql_cleaned() -> str:
    return (f"SELECT doc_id, label FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY path, doc_id) AS rn "
            f"FROM ({sql_canonical_email()}) c) t WHERE rn = 1")


def _sql_balanced() -> str:
    cl = f"({_sql_cleaned()})"
    return (f"SELECT doc_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY "
            f"md5(concat(CAST(doc_id AS VARCHAR), '|{SEED}')), doc_id) AS rk FROM {cl} c) t "
            f"WHERE rk <= (SELECT min(n) FROM (SELECT count(*) AS n FROM {cl} c2 GROUP BY label) m)")


@query("class_shares", lambda: (
    f"SELECT stage, label, n_rows, round(n_rows * 100.0 / sum(n_rows) OVER (PARTITION BY stage), 6) AS pct FROM ("
    f"SELECT 'original' AS stage, label, count(*) AS n_rows FROM ({sql_canonical_email()}) a GROUP BY label UNION ALL "
    f"SELECT 'cleaned', label, count(*) FROM ({_sql_cleaned()}) b GROUP BY label UNION ALL "
    f"SELECT 'balanced', label, count(*) FROM ({_sql_balanced()}) c GROUP BY label) s"), headline=True)
def q_class_shares(spark, sf_dir):
    """Class counts and shares after mapping, after dedup, after balancing."""
    from threatsift.session import cut_lineage
    # ids, digests and labels once; every stage reads that table, no text again
    keys = canonical_email(spark, sf_dir).select("doc_id", "path", C.text_key("text").alias("text"), "label")
    original = cut_lineage(keys)
    cleaned = cut_lineage(C.dedup_first(original, "text", ["path", "doc_id"], ["doc_id", "label"]))
    balanced = SM.balance_undersample(cleaned, "doc_id")
    return PR.stage_shares({"original": original, "cleaned": cleaned, "balanced": balanced})


def _sql_label_counts(legacy: bool) -> str:
    lab = sql_relabel(sql_map_label("raw_label", LEGACY_EMAIL_LABEL_MAP if legacy else EMAIL_LABEL_MAP), "path")
    return (f"SELECT path, label, count(*) AS n_rows FROM (SELECT path, {lab} AS label FROM {RAW} r) t "
            f"WHERE label IS NOT NULL GROUP BY ROLLUP (path, label)")


@query("raw_label_counts", lambda: _sql_label_counts(False))
def q_raw_label_counts(spark, sf_dir):
    """Mapped label counts per source, with per-source and grand totals."""
    return PR.mapped_label_counts(view(spark, sf_dir, "v_raw_labels"))


@query("raw_label_counts_legacy", lambda: _sql_label_counts(True))
def q_raw_label_counts_legacy(spark, sf_dir):
    """P8 with the profiler's own vocabulary."""
    return PR.mapped_label_counts(view(spark, sf_dir, "v_raw_labels"), legacy=True)


def _sql_summary(src: str, by: str | None = None) -> str:
    g = f"{by}, " if by else ""
    return (f"SELECT {g}count(*) AS total, count(*) FILTER (WHERE label = 'Phishing') AS phishing, "
            f"count(*) FILTER (WHERE label = 'Spam') AS spam, count(*) FILTER (WHERE label = 'Legitimate') AS legitimate, "
            f"count(*) FILTER (WHERE label = 'Unknown') AS unknown FROM {src}" + (f" GROUP BY {by}" if by else ""))


@query("batch_summary", lambda: _sql_summary(f"({oracle_triage_messages()}) v"))
def q_batch_summary(spark, sf_dir):
    """P10: totals per verdict over a scored batch (the message corpus)."""
    return PR.verdict_summary(triage_messages(view(spark, sf_dir, "v_messages")))


def history_frame(spark, sf_dir):
    """Scoring history as it is logged: email verdicts of the messages and
    URL verdicts of the page URLs, with their input and type."""
    m = view(spark, sf_dir, "v_messages").withColumn("input_text", F.col("text"))
    e = triage_messages(m, carry=("input_text",)).withColumn("input_type", F.lit("email"))
    p = view(spark, sf_dir, "pages").select(F.col("page_id").alias("msg_id"), F.col("url").alias("text"),
                                           F.col("url").alias("input_text"))
    u = triage_urls(p, carry=("input_text",)).withColumn("input_type", F.lit("url"))
    return e.unionByName(u)


def sql_history() -> str:
    return (f"SELECT v.*, m.text AS input_text, 'email' AS input_type FROM ({oracle_triage_messages()}) v "
            f"JOIN {MSG} m ON m.msg_id = v.msg_id UNION ALL "
            f"SELECT u.*, p.url AS input_text, 'url' AS input_type FROM ({oracle_triage_urls()}) u "
            f"JOIN pages p ON p.page_id = u.msg_id")


@query("history_summary", lambda: _sql_summary(f"({sql_history()}) h", "input_type"))
def q_history_summary(spark, sf_dir):
    """Verdict totals over the scoring history, per input type."""
    return PR.verdict_summary(history_frame(spark, sf_dir), by=["input_type"])


@query("result_export", lambda: (
    f"SELECT CAST(msg_id AS VARCHAR) AS item, input_type, CASE WHEN label = 'Legitimate' THEN 'Safe' ELSE label END AS verdict, "
    f"round(confidence * 100, 2) AS confidence_pct, CAST(is_phishing AS VARCHAR) AS is_phishing, reason AS details, input_text AS input "
    f"FROM ({sql_history()}) h"))
def q_result_export(spark, sf_dir):
    """K4: results with their input text as CSV files (renamed columns, display
    label), read back."""
    from threatsift.sources import corpus as SRC
    h = history_frame(spark, sf_dir)
    out = h.select(F.col("msg_id").alias("item"), "input_type", PR.display_label("label").alias("verdict"),
                   F.round(F.col("confidence") * 100, 2).alias("confidence_pct"), "is_phishing",
                   F.col("reason").alias("details"), F.col("input_text").alias("input"))
    path = fresh_path(spark, "export")
    SRC.write_table(out, path, "csv")
    back = SRC.tolerant_csv(spark, path, out.columns)
    return back.select("item", "input_type", "verdict", F.col("confidence_pct").cast("double").alias("confidence_pct"),
                       "is_phishing", "details", "input")


# ---------------------------------------------------------------- metrics

def sql_counts(src: str, t: str = "label_true", p: str = "pred") -> str:
    return f"SELECT {t} AS label_true, {p} AS pred, count(*) AS n FROM {src} GROUP BY 1, 2"


def sql_per_class(counts: str, classes) -> str:
    cls = "(SELECT * FROM (VALUES " + ", ".join(f"({c})" for c in classes) + ") v(cls))"
    return (f"SELECT k.cls, coalesce(bt.tp, 0) AS tp, coalesce(bp.predicted, 0) - coalesce(bt.tp, 0) AS fp, "
            f"coalesce(bt.support, 0) - coalesce(bt.tp, 0) AS fn, coalesce(bt.support, 0) AS support FROM {cls} k "
            f"LEFT JOIN (SELECT label_true AS cls, sum(n) AS support, sum(CASE WHEN pred = label_true THEN n ELSE 0 END) AS tp "
            f"FROM ({counts}) c GROUP BY 1) bt ON bt.cls = k.cls "
            f"LEFT JOIN (SELECT pred AS cls, sum(n) AS predicted FROM ({counts}) c GROUP BY 1) bp ON bp.cls = k.cls")


def _r(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) > 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) ELSE 0.0 END"


def sql_report(counts: str, classes) -> str:
    pc = sql_per_class(counts, classes)
    m = (f"SELECT CAST(cls AS VARCHAR) AS class, support, tp, {_r('tp', 'tp + fp')} AS precision, "
         f"{_r('tp', 'tp + fn')} AS recall FROM ({pc}) pc")
    m2 = f"SELECT *, {_r('2 * precision * recall', 'precision + recall')} AS f1 FROM ({m}) m"
    return (f"WITH m2 AS ({m2}) "
            f"SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM m2 "
            f"UNION ALL SELECT 'accuracy', NULL, NULL, round({_r('sum(tp)', 'sum(support)')}, 6), CAST(sum(support) AS BIGINT) FROM m2 "
            f"UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM m2 "
            f"UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), "
            f"round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m2")


EMAIL_CLASSES = [0, 1, 2]


def _counts(spark, sf_dir):
    return EV.confusion_counts(view(spark, sf_dir, "v_preds"))


@query("confusion_matrix", lambda: (
    "SELECT k.label_true, " + ", ".join(f"CAST(coalesce(sum(n) FILTER (WHERE pred = {c}), 0) AS BIGINT) AS pred_{c}" for c in EMAIL_CLASSES)
    + f" FROM (SELECT * FROM (VALUES (0), (1), (2)) v(label_true)) k LEFT JOIN ({sql_counts(PREDS)}) c "
      f"ON c.label_true = k.label_true GROUP BY k.label_true"))
def q_confusion_matrix(spark, sf_dir):
    """Confusion matrix of the email predictions, zero cells kept."""
    return EV.confusion_matrix(_counts(spark, sf_dir), EMAIL_CLASSES)


@query("classification_report", lambda: sql_report(sql_counts(PREDS), EMAIL_CLASSES))
def q_classification_report(spark, sf_dir):
    """Precision / recall / F1 / support, accuracy, macro and weighted."""
    return EV.classification_report(_counts(spark, sf_dir), EMAIL_CLASSES)


@query("error_rates", lambda: (
    f"SELECT CAST(cls AS VARCHAR) AS class, round({_r('fn', 'tp + fn')}, 6) AS fnr, "
    f"round({_r('fp', 'total - tp - fn')}, 6) AS fpr FROM ({sql_per_class(sql_counts(PREDS), EMAIL_CLASSES)}) pc, "
    f"(SELECT sum(n) AS total FROM ({sql_counts(PREDS)}) c) t"))
def q_error_rates(spark, sf_dir):
    """Per-class false-negative and false-positive rates."""
    return EV.error_rates(_counts(spark, sf_dir), EMAIL_CLASSES)


VERDICT_CODE = "CASE v.label WHEN 'Legitimate' THEN 0 WHEN 'Spam' THEN 1 WHEN 'Phishing' THEN 2 ELSE -1 END"


def _sql_sources() -> dict[str, tuple[str, list[int]]]:
    """Confusion counts of each pipeline and its classes, the positive one last."""
    url_src = (f"(SELECT l.label AS label_true, CAST(coalesce(v.is_phishing, FALSE) AS INTEGER) AS pred FROM ({oracle_triage_urls()}) v "
               f"JOIN {sub('v_url_labels')} l ON l.msg_id = v.msg_id) ub")
    comb_src = (f"(SELECT m.label AS label_true, {VERDICT_CODE} AS pred FROM ({oracle_triage_messages()}) v "
                f"JOIN {MSG} m ON m.msg_id = v.msg_id WHERE m.label IS NOT NULL) cb")
    return {"email": (sql_counts(PREDS), EMAIL_CLASSES), "url": (sql_counts(url_src), [0, 1]),
            "combined": (sql_counts(comb_src), EMAIL_CLASSES)}


def _sql_pipeline_metrics() -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS pipeline, * FROM ({sql_report(counts, classes)}) r"
                              for name, (counts, classes) in _sql_sources().items())


@query("pipeline_metrics", _sql_pipeline_metrics)
def q_pipeline_metrics(spark, sf_dir):
    """Metrics of the email model, of the URL verdicts over labelled page
    URLs, and of the combined per-message verdicts."""
    arr = EV.count_array(_pipeline_counts(spark, sf_dir), ("pipeline",), EMAIL_CLASSES)
    return EV.report(arr.select("pipeline", _pipeline_stats().alias("_s")), ("pipeline",))


def _pipeline_stats():
    return (F.when(F.col("pipeline") == "url", EV.class_stats("_c", [0, 1]))
            .otherwise(EV.class_stats("_c", EMAIL_CLASSES)))


def _pipeline_counts(spark, sf_dir):
    preds = view(spark, sf_dir, "v_preds").select("label_true", "pred")
    urls = view(spark, sf_dir, "v_url_labels").select("msg_id", F.col("url").alias("text"), F.col("label").alias("label_true"))
    u = triage_urls(urls, carry=("label_true",)).select("label_true", F.coalesce("is_phishing", F.lit(False)).cast("int").alias("pred"))
    m = view(spark, sf_dir, "v_messages")
    v = triage_messages(m.withColumnRenamed("label", "label_true"), carry=("label_true",))
    v = v.filter(F.col("label_true").isNotNull())
    code = (F.when(F.col("label") == "Legitimate", 0).when(F.col("label") == "Spam", 1)
            .when(F.col("label") == "Phishing", 2).otherwise(-1))
    # all sources counted by one aggregation; each is scanned once
    pairs = (preds.select(F.lit("email").alias("pipeline"), "label_true", "pred")
             .unionByName(u.select(F.lit("url").alias("pipeline"), "label_true", "pred"))
             .unionByName(v.select(F.lit("combined").alias("pipeline"), "label_true", code.alias("pred"))))
    return pairs.groupBy("pipeline", "label_true", "pred").agg(F.count(F.lit(1)).alias("n"))


def _sql_target_check() -> str:
    # the targets are stated here again, so that a wrong constant shows
    targets = [("phishing_precision", ">", 0.92), ("phishing_recall", ">", 0.95), ("macro_f1", ">", 0.93),
               ("false_negative_rate", "<", 0.05), ("false_positive_rate", "<", 0.03)]
    value = {"phishing_precision": _r("tp", "tp + fp"), "phishing_recall": _r("tp", "tp + fn"), "macro_f1": "macro_f1",
             "false_negative_rate": _r("fn", "tp + fn"), "false_positive_rate": _r("fp", "total - tp - fn")}
    parts = []
    for name, (counts, classes) in _sql_sources().items():
        rows = (f"(SELECT cls, tp, fp, fn, avg({_r('2 * tp', '2 * tp + fp + fn')}) OVER () AS macro_f1, "
                f"(SELECT sum(n) FROM ({counts}) c) AS total FROM ({sql_per_class(counts, classes)}) pc) x")
        parts += [f"SELECT '{name}' AS pipeline, '{m}' AS metric, round({value[m]}, 6) AS value, CAST({t} AS DOUBLE) AS target, "
                  f"round({value[m]}, 6) {op} {t} AS met FROM {rows} WHERE cls = {classes[-1]}" for m, op, t in targets]
    return " UNION ALL ".join(parts)


@query("target_check", _sql_target_check)
def q_target_check(spark, sf_dir):
    """Rates of the three pipelines against the stated targets."""
    return EV.target_check(_pipeline_counts(spark, sf_dir), ("pipeline",), _pipeline_stats(), EMAIL_CLASSES)
