"""Exact top-k by integer inner product over a bit-sliced index.

Every component becomes an integer, every attribute of a block of rows a set of
bitmaps (slice b of attribute d: bit b of that attribute, one bit per row). The
score of *all* rows of a block against a query is built with bitmap arithmetic
alone: an inner product is a sum of slices, each added once for every set bit
of the query's value there, and full adders over whole bitmaps (sum = a^b^c,
carry = majority) reduce the bitmaps of equal weight until one is left per
weight. These are the slices of the score. The top rows are then selected from
the most significant slice downward; the rows tied at the boundary are resolved
exactly, by the smaller id. Negative numbers: attributes are shifted to be
non-negative per block, and a negative digit of the query enters with
complemented slices; both change every score of the block by a constant. The
query's values are written in signed digits without neighbours (-1, 0, 1), of
which a third are set, so that fewer bitmaps are added.

Blocks of rows are sliced once; they and blocks of queries are rows of two
tables. Rows and queries are dealt into a few groups each, and a task holds the
queries of one group with their best rows so far, past which the row blocks of
one group go one at a time. What moves is the index once per query group and
the queries once per row group, through one shuffle; nothing is joined, so
nothing is broadcast or sent to the driver. Each task returns at most k rows
per query, which a last step merges.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from operator import mul

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatsift.llm.common import release, staged, task_count

BLOCK_ROWS = 8_192
QUERY_ROWS = 256
QUERY_GROUP = 65_536                 # queries that a task holds, with their best rows
SCALE = 256
TOP = 5


def _whole(v: Column) -> Column:
    scaled = v * F.lit(float(SCALE))
    fits = (scaled >= F.lit(-2.0 ** 63)) & (scaled < F.lit(2.0 ** 63))
    return F.when(fits, F.floor(scaled)).otherwise(F.raise_error(F.lit("a component times 256 does not fit 64 bits")).cast("long"))


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, _v array<long>): floor(256 * x) of every component as double.
    Vectors that are null, empty or hold a null or non-finite component take no
    part, nor do rows without an id; of rows with the same id the smallest
    vector stays. Components and scores are 64-bit integers, as in the SQL form;
    a component beyond them is an error."""
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return (vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound & (F.size("embedding") > 0))
            .select("vec_id", F.transform(x, _whole).alias("_v"))
            .groupBy("vec_id").agg(F.min("_v").alias("_v")))


def slices_of(values: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(slices (bits, words) uint64 of every attribute, as many as its range
    needs; shift per attribute) of integer rows."""
    rows, dims = values.shape
    shift = values.min(axis=0)
    words = (rows + 63) // 64
    unsigned = np.zeros((words * 64, dims), dtype=np.uint64)
    unsigned[:rows] = values.astype(np.uint64) - shift.astype(np.uint64)      # modulo 2**64, so of any range
    wide = [max(1, int(m).bit_length()) for m in unsigned.max(axis=0)]
    out = [np.empty((bits, words), dtype=np.uint64) for bits in wide]
    for b in range(max(wide)):
        at = [d for d in range(dims) if b < wide[d]]
        plane = np.packbits((unsigned[:, at] >> np.uint64(b)) & np.uint64(1) != 0, axis=0, bitorder="little")
        for d, bitmap in zip(at, np.ascontiguousarray(plane.T).view(np.uint64)):
            out[d][b] = bitmap
    return out, shift


def signed_digits(query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the positive and of the negative digits: query = plus - minus. In
    non-adjacent form; values beyond 62 bits keep their binary digits."""
    q = query.astype(np.int64)
    size = np.where(q < 0, (-(q + 1)).astype(np.uint64) + np.uint64(1), q.astype(np.uint64))
    plus, minus = size, np.zeros_like(size)
    if int(size.max()) < 2 ** 62:
        thrice = size * np.uint64(3)
        plus, minus = (thrice & ~size) >> np.uint64(1), (~thrice & size) >> np.uint64(1)
    return np.where(q < 0, minus, plus), np.where(q < 0, plus, minus)


class Sliced:
    """Slices of a block of rows, each with its complement, ready to be added."""

    def __init__(self, slices: list[np.ndarray], shift: np.ndarray) -> None:
        planes = np.concatenate(slices)
        self.planes, self.both, self.words = len(planes), np.concatenate([planes, ~planes]), planes.shape[1]
        self.wide = np.array([len(x) for x in slices])
        self.start = np.cumsum(self.wide) - self.wide
        self.full = [(1 << len(x)) - 1 for x in slices]
        self.shift = shift.tolist()
        self.work: list[np.ndarray] = [np.empty((0, self.words), dtype=np.uint64)] * 3

    def _bitmaps(self, plus: np.ndarray, minus: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the bitmaps to add, by weight, and how many each weight has."""
        digits = max(int(plus.max()), int(minus.max())).bit_length()
        set_ = (np.concatenate([plus, minus])[:, None] >> np.arange(digits, dtype=np.uint64)) & np.uint64(1) != 0
        row, at = np.nonzero(set_)
        d = row % len(self.wide)
        n = self.wide[d]
        b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        weight = (np.repeat(at, n) + b).astype(np.int16)
        bitmap = np.repeat(self.start[d] + np.where(row < len(self.wide), 0, self.planes), n) + b
        return bitmap[np.argsort(weight, kind="stable")], np.bincount(weight)

    def score(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Bitmaps of score - offset, least significant first, and the offset."""
        plus, minus = signed_digits(query)
        # a digit -1 at 2^c: -u * 2^c = (full - u) * 2^c - full * 2^c
        offset = sum(map(mul, query.tolist(), self.shift)) - sum(map(mul, minus.tolist(), self.full))
        bitmaps, counts = self._bitmaps(plus, minus)
        most = 2 * int(counts.max(initial=0)) + 2          # bitmaps of a weight, with half of those below it as carries
        if len(self.work[0]) < most:
            self.work = [np.empty((most, self.words), dtype=np.uint64) for _ in range(3)]
        here, above, half = self.work
        out: list[np.ndarray] = []
        done = carried = 0
        while len(out) < len(counts) or carried:
            n = int(counts[len(out)]) if len(out) < len(counts) else 0
            m = here[:carried + n]
            np.take(self.both, bitmaps[done:done + n], axis=0, out=m[carried:], mode="clip")
            done, carried = done + n, 0
            while len(m) > 2:                              # full adders, a third of the bitmaps at a time
                n = len(m) // 3
                a, b, c, x = m[:n], m[n:2 * n], m[2 * n:3 * n], half[:n]
                np.bitwise_xor(a, b, out=x)
                np.bitwise_and(a, b, out=a)
                np.bitwise_and(c, x, out=b)
                np.bitwise_or(a, b, out=above[carried:carried + n])
                np.bitwise_xor(c, x, out=c)
                m, carried = m[2 * n:], carried + n
            if len(m) == 2:                                # half adder
                np.bitwise_and(m[0], m[1], out=above[carried])
                np.bitwise_xor(m[0], m[1], out=m[0])
                carried += 1
            out.append(m[0].copy() if len(m) else np.zeros(self.words, dtype=np.uint64))
            here, above = above, here
        return out, offset


def score_slices(slices: list[np.ndarray], shift: np.ndarray, query: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Bitmaps of score - offset, least significant first, and the offset."""
    return Sliced(slices, shift).score(query)


def _positions(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def select_top(slices: list[np.ndarray], allowed: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k highest scores among ``allowed``, with all rows tied at the
    boundary: from the most significant slice downward, rows that have the bit
    are kept while they are fewer than k, else the others are dropped."""
    sure = np.zeros_like(allowed)
    equal = allowed.copy()
    missing = k
    for plane in reversed(slices):
        high = equal & plane
        n = int(np.bitwise_count(high).sum())
        if n > missing:
            equal = high
        else:
            sure |= high
            equal &= ~plane
            missing -= n
            if missing == 0:
                return _positions(sure)
    return np.concatenate([_positions(sure), _positions(equal)])


def at_least(slices: list[np.ndarray], allowed: np.ndarray, low: int) -> np.ndarray:
    """Bitmap of the rows among ``allowed`` with a score of ``low`` or more."""
    if low <= 0:
        return allowed
    if low.bit_length() > len(slices):
        return np.zeros_like(allowed)
    more, equal = np.zeros_like(allowed), allowed
    for w in range(len(slices) - 1, -1, -1):
        if low >> w & 1:
            equal = equal & slices[w]
        else:
            more |= equal & slices[w]
            equal = equal & ~slices[w]
    return more | equal


def search_block(ids: np.ndarray, block: Sliced, query_id: int, query: np.ndarray, k: int,
                 best: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(score, id) of the k best rows of the block, but for the query's own, and
    of ``best``; ties: smaller id."""
    allowed = np.packbits(np.pad(ids != query_id, (0, -len(ids) % 64)), bitorder="little").view(np.uint64)
    planes, offset = block.score(query)
    if len(best) == k:
        allowed = at_least(planes, allowed, best[-1][0] - offset)
        if not allowed.any():
            return best
    rows = select_top(planes, allowed, k)
    scores = [offset] * len(rows)
    if planes:
        bits = np.stack(planes)[:, rows >> 6] >> (rows & 63).astype(np.uint64) & np.uint64(1)
        scores = [sum(bit << w for w, bit in enumerate(column)) + offset for column in bits.T.tolist()]
    return heapq.nsmallest(k, [*best, *zip(scores, ids[rows].tolist())], key=lambda x: (-x[0], x[1]))


def _narrow(values: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them."""
    low, high = int(values.min()), int(values.max())
    return values.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _integers(data: bytes, rows: int, dims: int) -> np.ndarray:
    return np.frombuffer(data, dtype=f"i{len(data) // (rows * dims)}").reshape(rows, dims)


_BLOCK = "block long, dims int, ids binary, data binary, wide binary, shift binary"


def _packed(df: DataFrame, blocks: int, name: str, sliced: bool) -> DataFrame:
    """Rows of ``df`` packed into one row per block of ids: ids and values, or
    ids and slices with their number and shift per attribute."""
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        values = np.stack([np.asarray(v, dtype=np.int64) for v in pdf["_v"]])
        wide = shift = b""
        data = _narrow(values)
        if sliced:
            slices, low = slices_of(values)
            data, wide, shift = np.concatenate(slices), np.array([len(x) for x in slices], dtype=np.int64).tobytes(), low.tobytes()
        return pd.DataFrame({"block": [int(pdf["_block"].iloc[0])], "dims": [values.shape[1]],
                             "ids": [pdf["vec_id"].to_numpy(dtype=np.int64).tobytes()], "data": [data.tobytes()],
                             "wide": [wide], "shift": [shift]})
    keyed = df.withColumn("_dims", F.size("_v")).withColumn("_block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    return staged(keyed.groupBy("_block", "_dims").applyInPandas(pack, _BLOCK), name)


def _sliced(row: tuple) -> tuple[np.ndarray, Sliced]:
    ids, wide = np.frombuffer(row.ids, dtype=np.int64), np.frombuffer(row.wide, dtype=np.int64)
    planes = np.frombuffer(row.data, dtype=np.uint64).reshape(int(wide.sum()), -1)
    return ids, Sliced(np.split(planes, np.cumsum(wide)[:-1]), np.frombuffer(row.shift, dtype=np.int64))


def grid(blocks: int, query_blocks: int, query_rows: int, tasks: int) -> tuple[int, int]:
    """Groups of row blocks and of query blocks: no more queries in a group than
    a task holds, and about as many pairs of groups as tasks, if there are so
    many blocks. Queries are fewer than rows, so row groups are cut first."""
    q = math.ceil(query_blocks * query_rows / QUERY_GROUP)
    r = min(blocks, math.ceil(tasks / q))
    return r, min(query_blocks, max(q, math.ceil(tasks / r)))


def top_k(vectors: DataFrame, every: int, k: int = TOP, block_rows: int = BLOCK_ROWS,
          query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for every vector whose id is divisible by
    ``every``, the ``k`` highest integer inner products among all other vectors
    of the same length (all of them, if fewer). Ties go to the smaller id.
    Other columns are ignored; an empty table gives an empty result."""
    rows = staged(quantised(vectors), "topk-values")
    queries = rows.where(F.col("vec_id") % every == 0)
    blocks = max(1, math.ceil(rows.count() / block_rows))
    query_blocks = max(1, math.ceil(queries.count() / query_rows))
    index = _packed(rows, blocks, "topk-index", sliced=True)
    asked = _packed(queries, query_blocks, "topk-queries", sliced=False)
    release(rows)
    r, q = grid(blocks, query_blocks, query_rows, 2 * task_count(vectors))

    def groups(n: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    tiles = (asked.withColumn("_g", groups(r)).withColumn("tile", F.col("_g") * q + F.pmod("block", F.lit(q)))
             .unionByName(index.withColumn("_g", groups(q)).withColumn("tile", F.pmod("block", F.lit(r)) * q + F.col("_g")))
             .withColumn("of_rows", F.length("wide") > 0)
             .repartitionById(r * q, F.col("tile").cast("int")).sortWithinPartitions("tile", "dims", "of_rows", "block"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []

        def found() -> Iterator[pd.DataFrame]:
            for q_ids, _, best in held:
                out = [(q_id, i, s) for q_id, rows in zip(q_ids, best) for s, i in rows]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

        for pdf in frames:
            for row in pdf.itertuples(index=False):
                if at != (row.tile, row.dims):         # its queries come first, then its rows
                    yield from found()
                    at, held = (row.tile, row.dims), []
                if not row.of_rows:
                    q_ids = np.frombuffer(row.ids, dtype=np.int64).tolist()
                    held.append((q_ids, _integers(row.data, len(q_ids), row.dims), [[] for _ in q_ids]))
                elif held:
                    ids, block = _sliced(row)
                    for q_ids, values, best in held:
                        for j, q_id in enumerate(q_ids):
                            best[j] = search_block(ids, block, q_id, values[j], k, best[j])
        yield from found()

    scored = tiles.select("tile", "dims", "of_rows", "ids", "data", "wide", "shift").mapInPandas(
        run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
