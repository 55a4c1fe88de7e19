"""Quoted multi-line CSV read by many tasks.

A line break inside quotes does not end a record, so whether a line begins a
record depends on everything before it. But a line only maps one of two states
(outside or inside quotes) to another, and maps compose: one job reads all
lines and gives, per block of a file, the state at its end for either state at
its start, with the first lines of every file. The states at the block starts
follow from these few rows; with them every block is cut into records by its
own task. Records that run over a block's end are put together from their
fragments, at most two per block.

Lines come from Spark's text source: any file system, blocks as Spark splits
them. Records are parsed by Spark's CSV parser, as are all other CSV files.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threatsift.session import fresh_path

HEAD_LINES = 100             # first lines of a file that are kept with its first block
MAX_BROADCAST_BLOCKS = 200_000
COMMENT = b"#"


def ends_inside(line: bytes, inside: bool, feed: bool = False) -> bool:
    """Whether a line that begins outside / inside quotes ends inside them. A
    quote opens a field only at its beginning; text behind a closing quote
    belongs to the field until the next comma. In a feed, blanks before a field
    are skipped and a line may be a comment."""
    if feed and not inside and line[:1] == COMMENT:
        return False
    i = 0
    while True:
        if inside:
            j = line.find(b'"', i)
            while j >= 0 and line[j + 1:j + 2] == b'"':
                j = line.find(b'"', j + 2)
            if j < 0:
                return True
            i, inside = line.find(b",", j + 1) + 1, False
            if i == 0:
                return False
        if feed:
            while line[i:i + 1] in (b" ", b"\t"):
                i += 1
        if line[i:i + 1] == b'"':
            i, inside = i + 1, True
            continue
        i = line.find(b",", i) + 1
        if i == 0:
            return False


def plain_path(uri: Column) -> Column:
    """A percent-encoded URI as a path ('+' is literal in paths)."""
    return F.try_url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, start, value): lines in order within each block of a file."""
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):     # splits of later scans must be those of the first
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    return (spark.read.option("lineSep", "\n").text(paths)
            .select(plain_path(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("start"),
                    F.make_valid_utf8("value").alias("value")))


def _runs(b: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Stretches of a batch that belong to one block."""
    path, start = b.column("path").dictionary_encode(), b.column("start").to_numpy()
    index = path.indices.to_numpy()
    lo = 0
    for i in range(1, b.num_rows + 1) if b.num_rows else ():
        if i == b.num_rows or index[i] != index[lo] or start[i] != start[lo]:
            yield path.dictionary[int(index[lo])].as_py(), int(start[lo]), b.slice(lo, i - lo)
            lo = i


class CsvBlocks:
    """What one job over all lines of some files tells about their blocks."""

    def __init__(self, spark: SparkSession, paths: list[str]):
        self.spark, self.paths = spark, list(paths)
        path = fresh_path(spark, "csv-blocks")
        states = "plain0 boolean, plain1 boolean, feed0 boolean, feed1 boolean"
        layout = f"path string, start long, {states}, head array<string>"
        # only lines with quotes decide a state; only first lines are looked at besides
        seen = _lines(spark, self.paths).withColumn("value", F.when(F.col("value").contains('"') | (F.col("start") == 0), F.col("value"))) \
            if self.paths else spark.createDataFrame([], "path string, start long, value string")
        seen.mapInArrow(_block_maps, layout).write.parquet(path)
        self.table = spark.read.schema(layout).parquet(path)

    def heads(self) -> dict[str, list[str]]:
        """First lines of every file: one row per file reaches the driver."""
        rows = self.table.where("start = 0").select("path", "head").collect()
        return {r["path"]: [x.rstrip("\r") for x in r["head"]] for r in rows}

    def states(self, feed: bool) -> DataFrame:
        """(path, start, inside, last): the state every block begins in."""
        out, into = ("feed0", "feed1") if feed else ("plain0", "plain1")
        blocks = (self.table.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", out, into))).alias("b"))
                  .select("path", "b", F.size("b").alias("n")))

        def state(i: Column) -> Column:
            return F.aggregate(F.slice("b", F.lit(1), i), F.lit(False), lambda s, x: F.when(s, x[into]).otherwise(x[out]))

        each = F.transform("b", lambda x, i: F.struct(x["start"].alias("start"), state(i).alias("inside"), (i == F.col("n") - 1).alias("last")))
        return blocks.select("path", F.explode(each).alias("s")).select("path", "s.*")


def _block_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, names = None, ["path", "start", "plain0", "plain1", "feed0", "feed1", "head"]

    def row() -> pa.RecordBatch:
        types = [pa.string(), pa.int64(), *[pa.bool_()] * 4, pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([*held[0], *held[1], held[2]], types)], names=names)

    for b in batches:
        for path, start, rows in _runs(b):
            if held is None or held[0] != (path, start):
                if held is not None:
                    yield row()
                held = ((path, start), [False, True, False, True], [])
            for value in rows.column("value").cast(pa.binary()).to_pylist():
                if value is None:
                    continue
                if start == 0 and len(held[2]) < HEAD_LINES:
                    held[2].append(value.decode("utf-8"))
                if b'"' in value:
                    held[1][:] = [ends_inside(value, s, feed) for s, feed in zip(held[1], (False, False, True, True))]
    if held is not None:
        yield row()


COMPLETE, OPENED, CONTINUED = range(3)


def _cut_records(feed: bool, header: bool):
    """Lines of blocks, with the state each block begins in, as records."""
    schema = pa.schema([("path", pa.string()), ("row_pos", pa.int64()), ("kind", pa.int32()), ("record", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None
        out: list[tuple] = []
        lines: list[bytes] = []
        at = opened = 0
        inside = first = last = headed = False

        def put(kind: int) -> None:
            nonlocal headed
            record = b"\n".join(lines)
            if kind == COMPLETE:
                record = record.removesuffix(b"\r")
                if not record or feed and record[:1] == COMMENT:
                    return
                if headed:                               # the first record of a file
                    headed = False
                    return
            out.append((key[0], 2 * key[1] + opened, kind, record))

        def finish() -> None:
            if lines:                                    # a record runs over the block's end, or the file ends in it
                put(CONTINUED if first else COMPLETE if last else OPENED)

        def taken() -> Iterator[pa.RecordBatch]:
            if out:
                path, pos, kind, record = zip(*out)
                out.clear()
                yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(pos, pa.int64()), pa.array(kind, pa.int32()),
                                                  pa.array(record, pa.binary()).cast(pa.string())], schema=schema)

        for b in batches:
            for path, start, rows in _runs(b):
                if key != (path, start):
                    finish()
                    key, lines, at = (path, start), [], 0
                    inside = first = rows.column("inside")[0].as_py()
                    last, headed = rows.column("last")[0].as_py(), header and start == 0
                for value in rows.column("value").cast(pa.binary()).to_pylist():
                    if at == 0 and start == 0:
                        value = value.removeprefix(b"\xef\xbb\xbf")
                    if not lines:
                        opened = at
                    lines.append(value)
                    inside = ends_inside(value, inside, feed) if b'"' in value else inside
                    if not inside:
                        put(CONTINUED if first else COMPLETE)
                        lines, first = [], False
                    at += 1
            yield from taken()
        finish()
        yield from taken()

    return run


def csv_records(blocks: CsvBlocks, paths: list[str] | None = None, feed: bool = False, header: bool = True) -> DataFrame:
    """(path, row_pos, record): the records of ``paths`` (all files of the job by
    default), without empty ones and, with ``header``, without the first of each
    file. ``row_pos`` grows along each file."""
    spark = blocks.spark
    paths = blocks.paths if paths is None else list(paths)
    layout = "path string, row_pos long, kind int, record string"
    if not paths:
        return spark.createDataFrame([], layout).drop("kind")
    states = blocks.states(feed)
    lines = _lines(spark, paths)
    many = states.count() > MAX_BROADCAST_BLOCKS
    if many:
        lines = lines.withColumn("_n", F.monotonically_increasing_id()).join(states, ["path", "start"], "left") \
            .repartition("path", "start").sortWithinPartitions("path", "start", "_n").drop("_n")
    else:
        lines = lines.join(F.broadcast(states), ["path", "start"], "left")
    same = F.assert_true(F.col("last").isNotNull(), F.lit("the files or their splits changed between two scans"))
    lines = lines.select("path", "start", "value", F.coalesce(same.cast("boolean"), F.col("inside")).alias("inside"), "last")
    records = lines.mapInArrow(_cut_records(feed, header), layout)
    whole = records.where(F.col("kind") == COMPLETE).drop("kind")
    if states.where("inside").isEmpty():              # no record runs over a block's end
        return whole
    at = fresh_path(spark, "csv-fragments")
    records.where(F.col("kind") != COMPLETE).write.parquet(at)
    pieces = spark.read.schema(layout).parquet(at)
    group = F.sum((F.col("kind") == OPENED).cast("int")).over(Window.partitionBy("path").orderBy("row_pos"))
    mended = (pieces.withColumn("_g", group).groupBy("path", "_g")
              .agg(F.min("row_pos").alias("row_pos"), F.array_sort(F.collect_list(F.struct("row_pos", "record"))).alias("_r"))
              .select("path", "row_pos", F.regexp_replace(F.array_join("_r.record", "\n"), r"\r\z", "").alias("record")))
    return whole.unionByName(mended)
