"""Request validation as row-quality rules (Q1-Q4): error columns, never
exceptions, so one bad row cannot fail a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatsift.functions.text import py_strip
from threatsift.settings import DEFAULT, Settings

INPUT_TYPES = ("email", "url")


def input_type_error(input_type, text=None) -> Column:
    """Q1: NULL when valid; otherwise the reason."""
    t = F.col(input_type) if isinstance(input_type, str) else input_type
    err = F.when(t.isNull() | ~t.isin(*INPUT_TYPES), F.lit("input_type must be email or url"))
    if text is not None:
        x = F.col(text) if isinstance(text, str) else text
        err = err.when(x.isNull(), F.lit("text is required"))
    return err


def quarantine(df: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """Split rows into (valid, quarantined-with-error)."""
    tagged = df.withColumn("error", error)
    return tagged.filter(F.col("error").isNull()).drop("error"), tagged.filter(F.col("error").isNotNull())


def batch_sizes(df: DataFrame, batch_cols: list[str], settings: Settings = DEFAULT) -> DataFrame:
    """Q2: items per batch and whether 1 <= n <= max batch size."""
    g = df.groupBy(*batch_cols).agg(F.count(F.lit(1)).alias("n_items"))
    return g.withColumn("valid", (F.col("n_items") >= 1) & (F.col("n_items") <= settings.max_batch_size))


def payload_ok(text, limit_bytes: int = DEFAULT.max_payload_bytes) -> Column:
    """Q3: UTF-8 size within the limit."""
    x = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.octet_length(x), F.lit(0)) <= F.lit(limit_bytes)


def is_blank(text) -> Column:
    """Q4: empty after stripping whitespace (or NULL)."""
    x = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.length(py_strip(x)) == 0, F.lit(True))
