"""Prediction history as an append-only Parquet table.

Appends are idempotent per (writer id, batch id): each batch lands in its own
``batch`` partition written with dynamic partition overwrite, so a retried
micro-batch replaces its own rows instead of duplicating them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatsift.settings import HISTORY_DEFAULT_LIMIT

HISTORY_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("input_text", T.StringType()),
    T.StructField("input_type", T.StringType()),
    T.StructField("prediction_label", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("is_phishing", T.BooleanType()),
    T.StructField("reason", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("batch", T.StringType()),
])


def history_rows(verdicts: DataFrame, inputs: DataFrame | None, input_type: str | Column, key: str = "msg_id",
                 text_col: str = "text", ts_col: str | None = None) -> DataFrame:
    """One history row per scored item: verdict + original input text.
    ``inputs=None`` when the verdicts already carry the text (and time)
    columns, e.g. ``triage_messages(..., carry=(text, ts))``."""
    j = verdicts.join(inputs, key) if inputs is not None else verdicts
    ts = F.col(ts_col).cast("timestamp") if ts_col else F.current_timestamp()
    return j.select(
        F.col(key).cast("long").alias("id"), F.col(text_col).alias("input_text"), (F.lit(input_type) if isinstance(input_type, str) else input_type).alias("input_type"),
        F.col("label").alias("prediction_label"), F.col("confidence"), F.col("is_phishing"),
        F.col("reason"), F.date_trunc("second", ts).alias("timestamp"))


def append_history(rows: DataFrame, path: str, writer_id: str, batch_id: int | str) -> None:
    """K5: idempotent append of one batch."""
    out = rows.withColumn("batch", F.lit(f"{writer_id}-{batch_id}"))
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch").parquet(path))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY_SCHEMA).parquet(path)


def clear_history(spark: SparkSession, path: str) -> bool:
    """K6: replace the table by an empty one of the same schema."""
    spark.createDataFrame([], HISTORY_SCHEMA).write.mode("overwrite").partitionBy("batch").parquet(path)
    return True


def history_latest(history: DataFrame, n: int = HISTORY_DEFAULT_LIMIT) -> DataFrame:
    """Newest n entries; id breaks the 1-second timestamp ties. Planned
    as TakeOrderedAndProject (per-partition top-n, then a merge)."""
    return history.orderBy(F.col("timestamp").desc_nulls_last(), F.col("id").desc()).limit(n)


def windowed_counts(history: DataFrame, ts_col: str = "timestamp", label_col: str = "prediction_label",
                    every: str = "1 hour", watermark: str | None = None) -> DataFrame:
    """Verdict counts per tumbling window (batch or streaming; pass a
    watermark for streams so old windows are finalised and state dropped)."""
    h = history.withWatermark(ts_col, watermark) if watermark else history
    g = h.groupBy(F.window(ts_col, every).alias("w"), F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "label", "n")


WINDOWED_SCHEMA = "window_start timestamp, window_end timestamp, label string, n long"


def stream_history(spark: SparkSession, path: str) -> DataFrame:
    """The growing history as a stream. A batch that is appended again under its
    id replaces files and would be read again, so restart appends before reading."""
    return spark.readStream.schema(HISTORY_SCHEMA).parquet(path)


def start_windowed_counts(history: DataFrame, path: str, checkpoint: str, watermark: str = "1 hour", every: str = "1 hour",
                          ts_col: str = "timestamp", label_col: str = "prediction_label", available_now: bool = True):
    """X4 as a stream: appends each window's counts to the table at ``path``
    once, when the watermark has passed its end, also over restarts on the same
    checkpoint; returns the StreamingQuery. State: the counts of open windows
    only. Entries of a window already written are late: Spark leaves them out
    (``numRowsDroppedByWatermark`` of its progress), while ``windowed_counts`` over the
    table counts them. Entries without a time belong to no window."""
    w = windowed_counts(history, ts_col, label_col, every, watermark).writeStream.format("parquet").option("path", path)
    w = w.option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
