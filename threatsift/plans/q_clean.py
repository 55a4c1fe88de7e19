"""Queries for routing, label mapping, cleaning and dedup."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatsift.functions.text import trim_input
from threatsift.operators import clean as C
from threatsift.plans import sqltext as S
from threatsift.plans.catalog import query
from threatsift.plans.triage import url_occurrences
from threatsift.plans.views import sub, view
from threatsift.settings import (
    EMAIL_LABEL_MAP,
    EMAIL_PATH_MARKERS,
    EXCLUDED_EMAIL_FILE,
    EXCLUDED_SOURCE,
    NEGATIVE_CLASS_NAMES,
    PHISHING_SOURCE_KEYWORDS,
    POSITIVE_CLASS_NAMES,
    PROFILE_URL_KEYWORDS,
    URL_LABEL_MAP,
    URL_PATH_MARKERS,
    URL_SOURCE_KEYWORDS,
)

RAW = sub("v_raw_labels")


def _raw(spark, sf_dir):
    return view(spark, sf_dir, "v_raw_labels")


# ---------------------------------------------------------------- SQL mirrors

def sql_any(e: str, words) -> str:
    return "(" + " OR ".join(f"strpos({e}, {S.lit(w)}) > 0" for w in words) + ")"


def sql_file_name(e: str) -> str:
    return f"regexp_extract({e}, '([^/\\\\]*)$', 1)"


def sql_route(e: str) -> str:
    p = f"lower({e})"
    return (f"CASE WHEN {sql_any(p, URL_PATH_MARKERS)} THEN 'url' WHEN {sql_any(p, EMAIL_PATH_MARKERS)} THEN 'email' "
            f"WHEN {sql_any(p, URL_SOURCE_KEYWORDS)} THEN 'url' ELSE 'email' END")


def sql_map_label(e: str, mapping: dict) -> str:
    key = S.strip(f"lower(CAST({e} AS VARCHAR))")
    whens = " ".join(f"WHEN {S.lit(k)} THEN {v}" for k, v in mapping.items())
    return f"CAST(CASE {key} {whens} END AS INTEGER)"


def sql_phish_src(path: str) -> str:
    return sql_any(f"lower({sql_file_name(path)})", PHISHING_SOURCE_KEYWORDS)


def sql_relabel(label: str, path: str) -> str:
    return f"CASE WHEN {sql_phish_src(path)} AND {label} = 1 THEN 2 ELSE {label} END"


def sql_canonical_email() -> str:
    lab = sql_relabel(sql_map_label("raw_label", EMAIL_LABEL_MAP), "path")
    return (f"SELECT doc_id, path, lower(text) AS text, {lab} AS label FROM {RAW} r "
            f"WHERE lower(text) IS NOT NULL AND ({lab}) IS NOT NULL")


def canonical_email(spark, sf_dir):
    return C.canonical_email(_raw(spark, sf_dir), "text", "raw_label", "path")


# ---------------------------------------------------------------- R-series

@query("route_source", lambda: f"SELECT DISTINCT path, {sql_route('path')} AS kind FROM {RAW} r")
def q_route_source(spark, sf_dir):
    """URL vs email source by path rules, per distinct source file."""
    return _raw(spark, sf_dir).select("path", C.route_source(F.col("path")).alias("kind")).distinct()


@query("exclude_source", lambda: (
    f"SELECT doc_id, path FROM {RAW} r WHERE NOT (strpos(lower(path), {S.lit(EXCLUDED_SOURCE)}) > 0 "
    f"OR strpos(lower({sql_file_name('path')}), {S.lit(EXCLUDED_EMAIL_FILE)}) > 0)"))
def q_exclude_source(spark, sf_dir):
    """R2: rows of non-excluded sources."""
    return _raw(spark, sf_dir).filter(~C.is_excluded(F.col("path"))).select("doc_id", "path")


@query("raw_count_router", lambda: (
    f"SELECT DISTINCT path, CASE WHEN {sql_any('lower(path)', PROFILE_URL_KEYWORDS)} THEN 'url' ELSE 'email' END AS kind FROM {RAW} r"))
def q_raw_count_router(spark, sf_dir):
    """The profiler's router, per distinct source file."""
    return _raw(spark, sf_dir).select("path", C.raw_count_router(F.col("path")).alias("kind")).distinct()


@query("nunique_fallback", lambda: (
    f"SELECT n_text, n_label, CASE WHEN n_text < n_label THEN 'text' ELSE 'raw_label' END AS label_col, "
    f"CASE WHEN n_text < n_label THEN 'raw_label' ELSE 'text' END AS text_col FROM "
    f"(SELECT count(DISTINCT text) AS n_text, count(DISTINCT raw_label) AS n_label FROM {RAW} r) t"))
def q_nunique_fallback(spark, sf_dir):
    """Fewer distinct values marks the label column (ties: 2nd)."""
    d = _raw(spark, sf_dir).select("text", "raw_label")
    keys = d.select(C.text_key("text").alias("text"), C.text_key("raw_label").alias("raw_label"))
    agg = keys.agg(F.countDistinct("text").alias("n_text"), F.countDistinct("raw_label").alias("n_label"))
    first_is_label = F.col("n_text") < F.col("n_label")
    return agg.select("n_text", "n_label",
                      F.when(first_is_label, F.lit("text")).otherwise(F.lit("raw_label")).alias("label_col"),
                      F.when(first_is_label, F.lit("raw_label")).otherwise(F.lit("text")).alias("text_col"))


@query("resolve_columns")
def q_resolve_columns(spark, sf_dir):
    """Resolved (text, label) columns of every driver table; the
    two-column distinct-count fallback reads the table."""
    from threatsift.plans.views import TABLES
    rows = []
    for t in TABLES:
        df = view(spark, sf_dir, t)
        text, label = C.resolve_columns(df.columns, C.distinct_counts_of(df))
        ptext, plabel = C.resolve_columns(df.columns, C.distinct_counts_of(df), profile=True)
        rows.append((t, text, label, ptext, plabel))
    return spark.createDataFrame(rows, "table string, text_col string, label_col string, profile_text_col string, profile_label_col string")


# ---------------------------------------------------------------- C-series

@query("to_canonical", lambda: f"SELECT doc_id, text, raw_label AS label FROM {RAW} r")
def q_to_canonical(spark, sf_dir):
    """Project and rename to the (text, label) contract."""
    return _raw(spark, sf_dir).select("doc_id", F.col("text").alias("text"), F.col("raw_label").alias("label"))


@query("lower_text", lambda: f"SELECT doc_id, lower(text) AS text FROM {RAW} r")
def q_lower_text(spark, sf_dir):
    """Lowercase text."""
    return _raw(spark, sf_dir).select("doc_id", F.lower("text").alias("text"))


@query("map_label_email", lambda: f"SELECT doc_id, raw_label, {sql_map_label('raw_label', EMAIL_LABEL_MAP)} AS label FROM {RAW} r")
def q_map_label_email(spark, sf_dir):
    """Email label vocabulary (miss -> NULL)."""
    return _raw(spark, sf_dir).select("doc_id", "raw_label", C.map_label(F.col("raw_label"), EMAIL_LABEL_MAP).alias("label"))


@query("map_label_url", lambda: f"SELECT doc_id, raw_label, {sql_map_label('raw_label', URL_LABEL_MAP)} AS label FROM {RAW} r")
def q_map_label_url(spark, sf_dir):
    """URL label vocabulary (miss -> NULL)."""
    return _raw(spark, sf_dir).select("doc_id", "raw_label", C.map_label(F.col("raw_label"), URL_LABEL_MAP).alias("label"))


@query("relabel_by_source", lambda: (
    f"SELECT doc_id, path, {sql_phish_src('path')} AS phishing_source, "
    f"{sql_relabel(sql_map_label('raw_label', EMAIL_LABEL_MAP), 'path')} AS label FROM {RAW} r"))
def q_relabel_by_source(spark, sf_dir):
    """R3 + C4: phishing sources turn positive (1) into phishing (2)."""
    r = _raw(spark, sf_dir)
    lab = C.map_label(F.col("raw_label"), EMAIL_LABEL_MAP)
    return r.select("doc_id", "path", C.is_phishing_source(F.col("path")).alias("phishing_source"),
                    C.relabel_by_source(lab, F.col("path")).alias("label"))


@query("drop_unlabelled", lambda: f"SELECT doc_id, text, label FROM ({sql_canonical_email()}) c")
def q_drop_unlabelled(spark, sf_dir):
    """Rows with a NULL text or unmapped label are dropped; label INT."""
    return canonical_email(spark, sf_dir).select("doc_id", "text", "label")


@query("distinct_rows", lambda: f"SELECT DISTINCT path, text, label FROM ({sql_canonical_email()}) c")
def q_distinct_rows(spark, sf_dir):
    """Per-source exact-row dedup of (text, label)."""
    return C.distinct_rows(canonical_email(spark, sf_dir).select("path", "text", "label"), "text")


def _benchmark_blocklist(spark, sf_dir):
    # a one-column source: every row is positive (email -> 2)
    b = view(spark, sf_dir, "benchmark")
    return b.select(F.lit("benchmark").alias("source"), F.lower(F.col("text")).alias("text"), F.lit(2).alias("label"))


@query("union_sources", lambda: (
    f"SELECT 'documents' AS source, text, label FROM ({sql_canonical_email()}) c "
    f"UNION ALL SELECT 'benchmark', lower(text), 2 FROM benchmark"))
def q_union_sources(spark, sf_dir):
    """Canonical frames of several sources, UNION ALL by name."""
    docs = canonical_email(spark, sf_dir).select(F.lit("documents").alias("source"), "text", "label")
    return C.union_sources([docs, _benchmark_blocklist(spark, sf_dir)])


@query("dedup_first_text", lambda: (
    f"SELECT doc_id, path, label FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY path, doc_id) AS rn "
    f"FROM ({sql_canonical_email()}) c) t WHERE rn = 1"), headline=True)
def q_dedup_first_text(spark, sf_dir):
    """Cross-source dedup by text; first occurrence (path, row) wins and
    decides the label. Shuffles a 32-byte digest plus small columns."""
    c = canonical_email(spark, sf_dir)
    return C.dedup_first(c, "text", ["path", "doc_id"], ["doc_id", "path", "label"])


def _url_rows(spark, sf_dir):
    m = view(spark, sf_dir, "v_messages").dropna(subset=["label"])
    occ = url_occurrences(m.select("msg_id", "label", trim_input(F.col("text")).alias("clean")), "clean", carry=("label",))
    return occ.select("msg_id", "url_pos", F.lower("raw_url").alias("url"), "label").dropna(subset=["url"])


def sql_url_rows() -> str:
    from threatsift.plans.q_triage import sql_occurrences
    m = f"(SELECT msg_id, label, {S.strip('text')} AS clean FROM {sub('v_messages')} vm)"
    occ = sql_occurrences(m)
    return (f"SELECT o.msg_id, o.url_pos, lower(o.raw_url) AS url, l.label FROM ({occ}) o "
            f"JOIN {m} l ON l.msg_id = o.msg_id WHERE lower(o.raw_url) IS NOT NULL AND l.label IS NOT NULL")


@query("dedup_first_url", lambda: (
    f"SELECT url, label, msg_id, url_pos FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY msg_id, url_pos) AS rn "
    f"FROM ({sql_url_rows()}) u) t WHERE rn = 1"))
def q_dedup_first_url(spark, sf_dir):
    """C8 for URL corpora: labelled URL occurrences deduplicated by URL."""
    return C.dedup_first(_url_rows(spark, sf_dir), "url", ["msg_id", "url_pos"], ["url", "label", "msg_id", "url_pos"])


@query("label_conflicts", lambda: (
    f"SELECT url, count(DISTINCT label) AS n_labels, count(*) AS n_rows FROM ({sql_url_rows()}) u "
    f"GROUP BY url HAVING count(DISTINCT label) > 1"))
def q_label_conflicts(spark, sf_dir):
    """URLs seen with more than one label (the cases first-wins hides)."""
    return C.label_conflicts(_url_rows(spark, sf_dir), "url")


@query("class_filter", lambda: (
    f"SELECT doc_id, CASE WHEN lower(raw_label) IN ({', '.join(S.lit(x) for x in POSITIVE_CLASS_NAMES)}) THEN 'positive' "
    f"ELSE 'negative' END AS class_group FROM {RAW} r WHERE lower(raw_label) IN "
    f"({', '.join(S.lit(x) for x in POSITIVE_CLASS_NAMES + NEGATIVE_CLASS_NAMES)})"))
def q_class_filter(spark, sf_dir):
    """Rows whose raw label is in the profiler's positive / negative sets."""
    r = _raw(spark, sf_dir).select("doc_id", C.class_group(F.col("raw_label")).alias("class_group"))
    return r.filter(F.col("class_group").isNotNull())


@query("unmapped_labels", lambda: (
    f"SELECT path, raw_label, label, count(*) AS n_rows FROM "
    f"(SELECT path, raw_label, {sql_relabel(sql_map_label('raw_label', EMAIL_LABEL_MAP), 'path')} AS label FROM {RAW} r) t "
    f"GROUP BY path, raw_label, label"))
def q_unmapped_labels(spark, sf_dir):
    """Raw labels per source with their mapped label (NULL = dropped as
    unmapped) and row counts. One row per (source, raw, mapped): no per-source
    set is gathered, so a source with millions of distinct raw values stays
    spread over many rows."""
    r = _raw(spark, sf_dir)
    lab = C.relabel_by_source(C.map_label(F.col("raw_label"), EMAIL_LABEL_MAP), F.col("path"))
    t = r.select("path", "raw_label", lab.alias("label"))
    return t.groupBy("path", "raw_label", "label").agg(F.count(F.lit(1)).alias("n_rows"))
