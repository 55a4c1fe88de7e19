"""Join helpers: size-checked broadcast and allowlist membership joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatsift.settings import DEFAULT, Settings


MAX_BROADCAST_BYTES = 64 << 20


def checked_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint ``df`` as broadcast only after counting at most ``max_rows`` rows
    whose fixed-width size stays below ``MAX_BROADCAST_BYTES``; otherwise return
    it unchanged and let the planner / AQE pick a shuffle join."""
    width = sum(f.dataType.simpleString() in ("string", "binary") and 64 or 16 for f in df.schema.fields)
    rows = min(max_rows, MAX_BROADCAST_BYTES // max(width, 1))
    return F.broadcast(df) if df.count() <= rows else df


def allowlist_table(spark: SparkSession, settings: Settings = DEFAULT) -> DataFrame:
    return spark.createDataFrame([(d,) for d in settings.safe_domains], "domain string")


def semi_by_allowlist(df: DataFrame, allow: DataFrame, col: str = "domain", how: str = "left_semi",
                      settings: Settings = DEFAULT) -> DataFrame:
    """``left_semi`` keeps known-safe rows, ``left_anti`` the rest. The
    allowlist side is broadcast only behind a row-count check."""
    allow = checked_broadcast(allow.select(F.col(allow.columns[0]).alias("_allow")).distinct(),
                              settings.broadcast_row_limit)
    return df.join(allow, df[col] == allow["_allow"], how)


