"""Corpus cleaning: routing, column resolution, label mapping, dedup.

All row work is native; column resolution (R4) looks only at column names on
the driver, except the distinct-count fallback (R5), which is one aggregate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatsift.functions.text import py_strip
from threatsift.settings import (
    BANNED_TEXT_NAME_PARTS,
    EMAIL_LABEL_MAP,
    EMAIL_PATH_MARKERS,
    EXCLUDED_EMAIL_FILE,
    EXCLUDED_SOURCE,
    LABEL_NAME_HINTS,
    NEGATIVE_CLASS_NAMES,
    PHISHING_SOURCE_KEYWORDS,
    POSITIVE_CLASS_NAMES,
    PROFILE_LABEL_NAME_HINTS,
    PROFILE_URL_KEYWORDS,
    TEXT_NAME_HINTS,
    URL_LABEL_MAP,
    URL_PATH_MARKERS,
    URL_SOURCE_KEYWORDS,
)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def file_name(path) -> Column:
    """Source file name: the last path segment, or for a Spark-written
    dataset (``.../<name>/part-*``) the dataset folder's name."""
    p = _c(path)
    part_dir = F.regexp_extract(p, r"([^/\\]+)[/\\]part-[^/\\]*\z", 1)
    return F.when(part_dir != "", part_dir).otherwise(F.regexp_extract(p, r"([^/\\]*)\z", 1))


def _contains_any(x: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [x.contains(w) for w in words])


def route_source(path) -> Column:
    """R1: 'url' or 'email' from the file path, in rule order."""
    p = F.lower(_c(path))
    return (F.when(_contains_any(p, URL_PATH_MARKERS), F.lit("url"))
            .when(_contains_any(p, EMAIL_PATH_MARKERS), F.lit("email"))
            .when(_contains_any(p, URL_SOURCE_KEYWORDS), F.lit("url"))
            .otherwise(F.lit("email")))


def raw_count_router(path) -> Column:
    """The profiler's narrower router."""
    return F.when(_contains_any(F.lower(_c(path)), PROFILE_URL_KEYWORDS), F.lit("url")).otherwise(F.lit("email"))


def is_excluded(path, kind: str = "email") -> Column:
    """R2: excluded sources (feature-only URL set; one named email file)."""
    p = F.lower(_c(path))
    cond = p.contains(EXCLUDED_SOURCE)
    if kind == "email":
        cond = cond | F.lower(file_name(path)).contains(EXCLUDED_EMAIL_FILE)
    return cond


def is_phishing_source(path) -> Column:
    """The file NAME mentions a phishing corpus."""
    return _contains_any(F.lower(file_name(path)), PHISHING_SOURCE_KEYWORDS)


def label_map_column(mapping: dict) -> Column:
    return F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])


def map_label(raw, mapping: dict = EMAIL_LABEL_MAP) -> Column:
    """Lower, strip, lookup; a miss is NULL."""
    key = py_strip(F.lower(_c(raw).cast("string")))
    return F.try_element_at(label_map_column(mapping), key).cast("int")


def relabel_by_source(label, path) -> Column:
    """C4: in a phishing source, positive (1) means phishing (2)."""
    return F.when(is_phishing_source(path) & (_c(label) == 1), F.lit(2)).otherwise(_c(label))


def canonical_email(df: DataFrame, text_col: str, label_col: str, path_col: str | None = "path",
                    mapping: dict = EMAIL_LABEL_MAP, null_text: str | None = None) -> DataFrame:
    """C1-C5 for one email source: project, lowercase, map, relabel, drop
    unlabelled; lineage columns are kept. Null texts are dropped, or stand as
    the ``null_text`` literal (string casts elsewhere make it "nan")."""
    if null_text is not None:
        df = df.withColumn(text_col, F.coalesce(F.col(text_col).cast("string"), F.lit(null_text)))
    lab = map_label(F.col(label_col), mapping)
    if path_col:
        lab = relabel_by_source(lab, F.col(path_col))
    keep = [c for c in df.columns if c not in (text_col, label_col)]
    out = df.select(*keep, F.lower(F.col(text_col).cast("string")).alias("text"), lab.alias("label"))
    return out.dropna(subset=["text", "label"])


def canonical_url(df: DataFrame, url_col: str, label_col: str, mapping: dict = URL_LABEL_MAP) -> DataFrame:
    keep = [c for c in df.columns if c not in (url_col, label_col)]
    out = df.select(*keep, F.lower(F.col(url_col).cast("string")).alias("url"), map_label(F.col(label_col), mapping).alias("label"))
    return out.dropna(subset=["url", "label"])


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def text_key(c) -> Column:
    """32-byte digest used as the shuffle key instead of whole texts."""
    return F.unhex(F.sha2(_c(c), 256))


def dedup_first(df: DataFrame, key_col: str, order_cols: list[str], keep_cols: list[str]) -> DataFrame:
    """First occurrence per key by an explicit order. One hash
    aggregation on the key digest; ``min_by`` is combined map-side, so a key
    holding a third of all rows is reduced before the shuffle."""
    order = F.struct(*[F.col(c) for c in order_cols])
    payload = F.struct(*[F.col(c) for c in keep_cols])
    agg = df.groupBy(text_key(F.col(key_col)).alias("_k")).agg(F.min_by(payload, order).alias("_w"))
    return agg.select(*[F.col("_w")[c].alias(c) for c in keep_cols])


def distinct_rows(df: DataFrame, text_col: str) -> DataFrame:
    """Whole-row distinct with the text's digest as its key, so that only
    one copy of each text per task crosses the shuffle and none is compared."""
    others = [c for c in df.columns if c != text_col]
    out = df.groupBy(text_key(text_col).alias("_k"), *others).agg(F.first(text_col).alias(text_col))
    return out.select(*df.columns)


def label_conflicts(df: DataFrame, key_col: str, label_col: str = "label") -> DataFrame:
    """Keys seen with more than one label."""
    g = df.groupBy(key_col).agg(F.countDistinct(label_col).alias("n_labels"), F.count(F.lit(1)).alias("n_rows"))
    return g.filter(F.col("n_labels") > 1)


def class_group(raw) -> Column:
    """J6: 'positive' / 'negative' raw label sets of the profiler (no strip)."""
    x = F.lower(_c(raw).cast("string"))
    return (F.when(x.isin(*POSITIVE_CLASS_NAMES), F.lit("positive"))
            .when(x.isin(*NEGATIVE_CLASS_NAMES), F.lit("negative")))


# --------------------------------------------------------------------------
# Column resolution by name rules (metadata only)
# --------------------------------------------------------------------------

def _has(name: str, parts) -> bool:
    n = str(name).lower()
    return any(p in n for p in parts)


def resolve_columns(columns: list[str], distinct_counts=None, profile: bool = False):
    """R4 (and R6 with ``profile=True``): (text_col, label_col) from column
    names. ``distinct_counts`` is a callable returning (n1, n2) for the
    two-column fallback (R5); it is only invoked when the rules fail."""
    cols = list(dict.fromkeys(columns))  # duplicate names -> first
    label_hints = PROFILE_LABEL_NAME_HINTS if profile else LABEL_NAME_HINTS
    label = next((c for c in cols if _has(c, label_hints)), None)
    if profile:
        text = next((c for c in cols if _has(c, TEXT_NAME_HINTS)), None)
    else:
        text = next((c for c in cols if c != label and not _has(c, BANNED_TEXT_NAME_PARTS) and _has(c, TEXT_NAME_HINTS)), None)
        if text is None:
            text = next((c for c in cols if c != label and not _has(c, BANNED_TEXT_NAME_PARTS)), None)
    if (label is None or text is None) and len(cols) == 2 and distinct_counts is not None:
        n1, n2 = distinct_counts(cols[0], cols[1])
        label, text = (cols[0], cols[1]) if n1 < n2 else (cols[1], cols[0])
    if profile:
        return text, label
    if label is None:
        label = cols[1] if len(cols) > 1 else cols[0]
    if text is None:
        rest = [c for c in cols if c != label]
        text = rest[0] if rest else cols[0]
    return text, label


def distinct_counts_of(df: DataFrame):
    """R5 helper: exact distinct counts of two columns in one aggregate."""
    def counts(c1, c2):
        r = df.select(text_key(F.col(c1).cast("string")).alias("x"), text_key(F.col(c2).cast("string")).alias("y")).agg(
            F.countDistinct("x").alias("a"), F.countDistinct("y").alias("b")).first()
        return r["a"], r["b"]
    return counts
