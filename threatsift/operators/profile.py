"""Corpus profiling aggregates (P1-P11): all single-pass native aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatsift.functions.text import char_count, whitespace_words, words
from threatsift.operators.clean import map_label, relabel_by_source
from threatsift.settings import EMAIL_LABEL_MAP, LEGACY_EMAIL_LABEL_MAP, STOP_WORDS


def label_distribution(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Rows per raw label, NULL included."""
    return df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_rows"))


def text_profile(df: DataFrame, text_col: str = "text", by: list[str] | None = None) -> DataFrame:
    """P2-P4 in one pass: lengths, words, URL rate, punctuation."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    chars = F.length(t)
    nwords = whitespace_words(t)
    has_url = F.lower(t).rlike(r"https?://|www\.")
    aggs = [
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(chars).alias("avg_chars"),
        F.max(chars).alias("max_chars"),
        F.avg(nwords).alias("avg_words"),
        F.max(nwords).alias("max_words"),
        F.count_if(has_url).alias("n_with_url"),
        F.avg(has_url.cast("double")).alias("url_share"),
        F.avg(char_count(t, "!")).alias("avg_exclamations"),
        F.avg(char_count(t, "$")).alias("avg_dollars"),
    ]
    return df.groupBy(*(by or [])).agg(*aggs)


def word_rows(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """P5 exploded: one row per word (3+ ASCII letters, lowercase)."""
    return df.select(*keep, F.explode(words(F.col(text_col))).alias("word"))


def top_words(df: DataFrame, text_col: str, group_col: str, n: int = 10, salt_buckets: int = 64,
              stop_words=STOP_WORDS) -> DataFrame:
    """Top-n non-stop words per group (count desc, word asc).

    Exact two-stage top-k: counts are partial-aggregated per (group, word);
    a first window keeps n per (group, hash bucket of word), so no task ever
    ranks a whole group's vocabulary; the second ranks at most n x buckets
    candidates per group."""
    w = word_rows(df, text_col, [group_col]).filter(~F.col("word").isin(*stop_words))
    counts = w.groupBy(group_col, "word").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("_s", F.pmod(F.xxhash64("word"), F.lit(salt_buckets)))
    order = [F.col("n").desc(), F.col("word").asc()]
    first = counts.withColumn("_r", F.row_number().over(Window.partitionBy(group_col, "_s").orderBy(*order)))
    cand = first.filter(F.col("_r") <= n).drop("_r", "_s")
    ranked = cand.withColumn("rank", F.row_number().over(Window.partitionBy(group_col).orderBy(*order)))
    return ranked.filter(F.col("rank") <= n)


def mapped_label_counts(df: DataFrame, label_col: str = "raw_label", path_col: str = "path", legacy: bool = False) -> DataFrame:
    """Mapped label counts per source with totals. ``legacy`` uses the
    profiler's own, drifted vocabulary."""
    lab = relabel_by_source(map_label(F.col(label_col), LEGACY_EMAIL_LABEL_MAP if legacy else EMAIL_LABEL_MAP), F.col(path_col))
    t = df.select(path_col, lab.alias("label")).filter(F.col("label").isNotNull())
    return t.rollup(path_col, "label").agg(F.count(F.lit(1)).alias("n_rows"))


def stage_shares(stages: dict[str, DataFrame], label_col: str = "label") -> DataFrame:
    """Counts and percentage per class at each named stage."""
    parts = [df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("stage", F.lit(name))
             for name, df in stages.items()]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    tot = F.sum("n_rows").over(Window.partitionBy("stage"))
    return u.withColumn("pct", F.round(F.col("n_rows") * 100.0 / tot, 6))


def verdict_summary(df: DataFrame, label_col: str = "label", by: list[str] | None = None) -> DataFrame:
    """Totals per verdict label in one pass (count_if)."""
    lab = F.col(label_col)
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(lab == "Phishing").alias("phishing"),
        F.count_if(lab == "Spam").alias("spam"),
        F.count_if(lab == "Legitimate").alias("legitimate"),
        F.count_if(lab == "Unknown").alias("unknown"),
    )


def display_label(c) -> Column:
    """Export display name: Legitimate is shown as Safe."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x == "Legitimate", F.lit("Safe")).otherwise(x)
