"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatsift.session import fresh_path, ship_package

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")
LABEL_FOLDS = 4
HELD_OUT_FOLD = 2

# Arrow batches between the JVM and Python tasks: whole texts are long, and the
# default (64 MB, 10,000 rows) holds several such buffers off the heap per task.
ARROW_BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4m"),
               "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000")}


def prepare(spark: SparkSession) -> None:
    """Make the package importable in Python tasks and bound the Arrow batches,
    unless the session sets its own."""
    ship_package(spark)
    for key, (default, ours) in ARROW_BATCH.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, ours)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table below the shared checkpoint folder and read it
    back: the lineage is cut at files every executor sees, so a lost executor
    never repeats the work before it and every later reader sees the same rows."""
    spark = df.sparkSession
    path = fresh_path(spark, f"llm-{name}")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete staged tables whose last reader has been written, so that the
    shared folder holds only what is still read."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: Column) -> Column:
    """Rows kept from every fit: crc32 of the id's decimal text, modulo 4, is 2.
    A null id has no fold and counts as held out."""
    fold = F.crc32(doc_id.cast("string").cast("binary")) % LABEL_FOLDS
    return F.coalesce(fold == HELD_OUT_FOLD, F.lit(True))


def task_count(df: DataFrame) -> int:
    """Shuffle partitions of the session, for explicit repartitioning."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


MAX_BROADCAST_ROWS = 100_000


def small_side(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows stay below the bound,
    else unchanged (Spark then shuffles it). For tables already written."""
    return F.broadcast(df) if df.count() <= max_rows else df


_HASH_SPAN = 1 << 40


def hash_sample(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """About ``rows`` rows of ``df``, all if it has no more: those whose key hash
    falls below a threshold set from the row count. The same rows on every run
    and whatever the partitioning; nothing is sorted or sent to the driver."""
    count = df.count()
    if count <= rows:
        return df
    h = F.pmod(F.xxhash64(F.lit(29), *keys), F.lit(_HASH_SPAN))
    return df.where(h < int(_HASH_SPAN * (rows / count)))


def tile_of(chunk: Column, other: Column) -> Column:
    """Number of the tile of two chunks, in either order; 64-bit."""
    return F.least(chunk, other).cast("long") * F.lit(1 << 20) + F.greatest(chunk, other)


def tiles_of(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of rows with equal ``keys`` from batches sorted by them, one table
    each; only the run at a batch's end waits for the next batch."""
    held: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        table = pa.Table.from_batches([b])
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        change = np.zeros(table.num_rows - 1, dtype=bool)
        for k in keys:
            change |= np.diff(table.column(k).to_numpy()) != 0
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for lo, hi in zip(cuts, cuts[1:]):
            yield table.slice(lo, hi - lo)
        held = table.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield held
