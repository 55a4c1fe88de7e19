"""Best-fit-decreasing packing of tokenised documents into sequences.

Best fit decreasing takes the documents by falling length and puts each into
the open sequence with the least room that still holds it. Equal lengths are
interchangeable, so the whole decision depends only on *how many* pieces there
are of each length: a histogram of at most ``capacity`` rows. The plan runs on
that histogram, with a segment tree over remaining capacities that finds the
tightest open sequences in logarithmic time, and treats runs of equal pieces
and runs of equally filled sequences at once. It is exactly the result of
placing the documents one by one, and its size depends on the capacity alone.

The pieces are then ranked within their length (in hashed buckets, so a length
shared by a third of all rows is many tasks) and look their place up in the
plan: rank r of length s lies in sequence ``first + r // k`` at
``offset + (r % k) * s``.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatsift.llm import tokens
from threatsift.llm.common import staged

CAPACITY = 1024
SEPARATOR_ID = 2
MIN_BUCKETS = 64
BUCKET_ROWS = 50_000


class TightestFit:
    """Segment tree over remaining capacities 0..capacity: which of them have
    an open sequence, and the smallest one that is at least ``size``."""

    def __init__(self, capacity: int):
        self.leaves = 1 << (capacity + 1).bit_length()
        self.open = [False] * (2 * self.leaves)

    def mark(self, room: int, is_open: bool) -> None:
        i = self.leaves + room
        self.open[i] = is_open
        i //= 2
        while i:
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]
            i //= 2

    def tightest(self, size: int) -> int | None:
        i = self.leaves + size
        if self.open[i]:
            return size
        while i > 1:                      # up, to the first open right sibling
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                break
            i //= 2
        else:
            return None
        while i < self.leaves:            # down, to its smallest open leaf
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.leaves


@dataclass(frozen=True)
class Placement:
    """Pieces of ``length`` with ranks from ``rank`` on: ``per`` to a sequence,
    from sequence ``first`` on, at ``offset`` there."""

    length: int
    rank: int
    per: int
    first: int
    offset: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Placement], int]:
    """Placements for all pieces of a {length: count} histogram, by length and
    rank, and the number of sequences."""
    fit = TightestFit(capacity)
    bins: dict[int, list[tuple[int, int]]] = defaultdict(list)   # room -> [(first sequence, how many)]
    out: list[Placement] = []
    opened = 0

    def put(room: int, first: int, count: int) -> None:
        if room > 0 and count:
            bins[room].append((first, count))
            fit.mark(room, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit into {capacity}")
        while left:
            room = fit.tightest(length)
            if room is None:
                need = math.ceil(left / (capacity // length))
                put(capacity, opened, need)
                opened += need
                continue
            first, count = bins[room].pop()
            if not bins[room]:
                fit.mark(room, False)
            per, offset = room // length, capacity - room
            full = min(count, left // per)
            if full:
                out.append(Placement(length, rank, per, first, offset))
                put(room - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            rest = count - full
            if rest and 0 < left < per:
                out.append(Placement(length, rank, per, first + full, offset))
                put(room - left * length, first + full, 1)
                rank, left, full, rest = rank + left, 0, full + 1, rest - 1
            put(room, first + full, rest)
    return out, opened


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY,
                 separator: int = SEPARATOR_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and the
    separator, whole or (only if longer) in pieces of ``capacity``, of which
    the first may be shorter."""
    path = tokenizer or tokens.default_tokenizer()
    schema = T.StructType([docs.schema["doc_id"], T.StructField("piece", T.IntegerType()),
                           *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(b.column(1)):
                ids = np.append(enc.encode(t.as_py()), np.uint32(separator)).astype("<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
                    row.append(i)
                    piece.append(k)
                    start.append(x)
                    length.append(y - x)
                    crc.append(zlib.crc32(ids[x:y].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(run, schema)


def _places(placements: list[Placement]):
    """Arrays for the lookup: keys (length, rank) in one sorted number."""
    rows = sorted(placements, key=lambda p: (p.length, p.rank))
    at = {f: np.array([getattr(p, f) for p in rows], dtype=np.int64) for f in ("length", "rank", "per", "first", "offset")}
    bounds = {int(s): (int(np.searchsorted(at["length"], s)), int(np.searchsorted(at["length"], s, side="right")))
              for s in np.unique(at["length"])}
    return at, bounds


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY,
         separator: int = SEPARATOR_ID, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every
    piece. Needs doc_id and text; other columns are ignored. A null or empty
    text is the separator alone. Repeated rows are packed as often as they
    come; an empty table gives an empty result. Equal pieces are ranked by a
    hash of their ids, so reruns agree."""
    pieces = staged(token_pieces(docs, tokenizer, capacity, separator), "pack-pieces")
    spark = docs.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    placements, _ = plan(histogram, capacity)
    lookup = spark.sparkContext.broadcast(_places(placements))
    buckets = max(MIN_BUCKETS, math.ceil(max(histogram.values(), default=0) / bucket_rows))
    h = F.xxhash64(F.col("doc_id").cast("string"), "piece", "start", "ids_crc32")
    keyed = pieces.withColumn("_h", h).withColumn("_b", F.pmod(F.col("_h"), F.lit(buckets)))
    sizes = keyed.groupBy("length", "_b").count()
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    order = Window.partitionBy("length", "_b").orderBy("_h", "doc_id", "piece")
    ranked = (keyed.withColumn("_r", F.row_number().over(order) - 1)
              .join(offsets, ["length", "_b"])
              .select(*pieces.columns, (F.col("_r") + F.col("_before")).alias("_rank")))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bounds = lookup.value
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = b.column("_rank").to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.zeros(len(rank), dtype=np.int64)
            for s in np.unique(length):
                lo, hi = bounds[int(s)]
                mine = length == s
                row[mine] = lo + np.searchsorted(at["rank"][lo:hi], rank[mine], side="right") - 1
            inside = rank - at["rank"][row]
            per = np.maximum(at["per"][row], 1) if len(row) else rank
            sequence = at["first"][row] + inside // per
            offset = at["offset"][row] + (inside % per) * length
            yield pa.RecordBatch.from_arrays(
                [*[b.column(f.name) for f in schema.fields[:-2]], pa.array(sequence), pa.array(offset)],
                names=schema.names)

    return ranked.mapInArrow(run, schema)
