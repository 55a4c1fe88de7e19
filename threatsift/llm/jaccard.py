"""N-gram Jaccard join by parity sketches.

A document is its set of distinct word shingles. XOR-hashing the set into a bit
sketch (a token flips the bit it hashes to) gives two sketches that differ in
at most as many bits as the sets differ in tokens. Two sets of sizes a and b
whose Jaccard similarity reaches the threshold differ in at most ``d`` tokens,
which follows from a and b; so among more than ``d`` bands of the sketch one is
equal on both sides (pigeonhole), and equal bands are found by a hash join.

* Size bands: sizes fall into classes of a fixed ratio. Within class k and
  towards class k+1 one ``d`` and one number of bands hold. A document enters
  the join of its class and, if it can be the larger partner, of the one below.
* A band of 2**40 bits is never laid out: it is kept as the XOR of 64-bit
  numbers of its set bits, which is its join key, so its width costs nothing and
  strangers do not share bits. Tokens choose their band by hash.
* A band without set bits would join strangers. Bands form pairs, and with
  ``d + 1`` bands (rounded up to even) some *pair* differs in at most one bit.
  A document with an empty band therefore joins on the other band of the pair,
  as it is and with each of its bits left out, instead of on the empty one.
* A pair with at most one bit would still join strangers, so such a *poor* pair
  gives no key. There are ``spare`` more pairs than needed: a document with no
  more poor pairs than that agrees with each partner in another pair as well.
  The few with more are dealt to bands again by another hash (their partners
  with more are too). Those with too many in every dealing join on the numbers
  of their poor pairs in all of them together.
* Rows of one key are streamed in order of key and id; each is paired with the
  first (smallest) id only. Pairs whose whole sketches (as many bits as tokens)
  differ in more than ``d`` bits are dropped, the others verified on the sets.
  Where a key's documents do not end up in one component, its other pairs that
  cross components are compared by sketch in blocks and verified too, so no link
  that matters for a component is lost.

Documents with equal sets are collapsed before, by a 128-bit fingerprint of the
set. Texts never cross a shuffle except those of documents that have a
candidate partner.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatsift.llm import shingles, textbuf
from threatsift.llm.common import release, small_side, staged, tile_of, tiles_of
from threatsift.llm.components import components

WIDTH = 4
PERCENT = 85
CLASS_RATIO = 1.25
BAND_BITS = 40
DEALINGS = 4
WIDE = 8                    # a wide sketch's bits, in sketches
POOR_SHARE = 0.004          # of all pairs, about
SEEN_LIMIT = 500_000
CHUNK = 1_024
MAX_SIZE = 1 << 40


def max_difference(total: int, percent: int) -> int:
    """Largest symmetric difference of two sets of ``total`` elements together
    whose 100 * intersection is at least ``percent`` * union."""
    return (100 - percent) * total // (100 + percent)


def size_classes(percent: int, ratio: float = CLASS_RATIO) -> list[int]:
    """Smallest size of every class. The first class starts at the smallest
    size that can have a partner with another set."""
    lo = 1
    while max_difference(2 * lo + 1, percent) < 1:
        lo += 1
    out = [lo]
    while out[-1] < MAX_SIZE:
        out.append(max(out[-1] + 1, int(out[-1] * ratio)))
    return out


def join_bands(size: int, percent: int, classes: list[int]) -> list[tuple[int, int]]:
    """(class, number of bands) of the joins a set of this size enters."""
    k = bisect.bisect_right(classes, size) - 1
    if k < 0:
        return []
    out = []
    for c in (k, k - 1):
        if c < 0:
            continue
        small = classes[c + 1] - 1                                     # largest size of the class
        large = min(classes[c + 2] - 1, small * 100 // percent)       # largest partner it can have
        if c < k and size > large:
            continue
        d = max_difference(small + large, percent)
        if d >= 1:
            pairs = need = (d + 2) // 2
            while pairs - spare(pairs) < need:
                pairs += 1
            out.append((c, 2 * pairs))
    return out


def spare(pairs: int) -> int:
    """Poor pairs that a document of so many pairs may have without being dealt
    again; few have more. Where they are rare at all, none."""
    poor = POOR_SHARE * pairs
    return 0 if poor < 0.05 else math.ceil(poor + 2.5 * math.sqrt(poor))


def _text_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def sketch_bits(size: np.ndarray) -> np.ndarray:
    """Bits of the whole-set sketch: the power of two at or above the size, at
    least 64. A longer sketch folds onto a shorter one (positions are low bits)."""
    bits = np.int64(1) << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)
    return np.maximum(bits, 64)


def _sketches(owner: np.ndarray, h: np.ndarray, count: np.ndarray, factor: int = 1) -> list[bytes]:
    bits = np.where(count > 0, sketch_bits(count) * factor, 0)
    base = np.cumsum(bits) - bits
    at = base[owner] + ((h >> np.uint64(8)).astype(np.int64) & (bits[owner] - 1))
    odd = (np.bincount(at, minlength=int(bits.sum())) & 1).astype(bool)
    packed = np.packbits(odd, bitorder="little")
    return [packed[x // 8:(x + n) // 8].tobytes() for x, n in zip(base.tolist(), bits.tolist())]


def set_summaries(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, sketch, wide): size, 128-bit fingerprint and
    parity sketches of every set, the wide one of ``WIDE`` times as many bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, f1, f2 = (np.zeros(b.num_rows, np.int64), *(np.zeros(b.num_rows, np.uint64) for _ in range(2)))
            sketches: list[bytes] = []
            wide: list[bytes] = []
            for first, rows, owner, h in shingles.blocks(b.column(1), width):
                count = np.bincount(owner, minlength=rows)
                n[first:first + rows] = count
                sketches += _sketches(owner, h, count)
                wide += _sketches(owner, h, count, WIDE)
                at = np.flatnonzero(count)
                if len(at):
                    begin = (np.cumsum(count) - count)[at]
                    f1[first + at] = np.add.reduceat(textbuf.mix64(h ^ np.uint64(0xA0761D6478BD642F)), begin)
                    f2[first + at] = np.add.reduceat(textbuf.mix64(h ^ np.uint64(0xE7037ED1A0B428DB)), begin)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)),
                                              pa.array(sketches, pa.binary()), pa.array(wide, pa.binary())],
                                             names=["doc_id", "n_shingles", "f1", "f2", "sketch", "wide"])
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("n_shingles", "f1", "f2")],
                           T.StructField("sketch", T.BinaryType()), T.StructField("wide", T.BinaryType())])
    return _text_rows(docs).mapInArrow(run, schema)


def _folded(sketches: list[bytes], words: int) -> np.ndarray:
    """(sketches, words): every sketch folded by XOR to the given length."""
    out = np.empty((len(sketches), words), dtype=np.uint64)
    for i, s in enumerate(sketches):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(s, dtype=np.uint64).reshape(-1, words), axis=0)
    return out


def near_sketches(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the rows (a, b, na, nb, sa, sb) whose sketches differ in no
    more bits than sets of these sizes at the threshold can."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = np.zeros(b.num_rows, dtype=bool)
            for i, (na, nb, x, y) in enumerate(zip(*(b.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")))):
                p, q = _folded([x, y], min(len(x), len(y)) // 8)
                good[i] = int(np.bitwise_count(p ^ q).sum()) <= max_difference(na + nb, percent)
            mask = pa.array(good)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask)], names=["a", "b"])

    return pairs.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def cross_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): within every tile of (key, tile, side, id, c, n, sketch), the
    pairs of different components whose sizes and sketches allow a link. Pairs
    are compared in memory, a tile (two chunks of a key) at a time; only those
    that pass leave the task. The sketches are wide ones here: nearly no pair
    below the threshold passes, so outliers of a large group give no pairs."""
    def compare(t: pa.Table) -> tuple[np.ndarray, np.ndarray] | None:
        c, n, side = (t.column(x).to_numpy() for x in ("c", "n", "side"))
        if (c == c[0]).all():
            return None
        ids = t.column("id").to_numpy()
        sketches = t.column("sketch").to_pylist()
        x = _folded(sketches, min(map(len, sketches)) // 8)
        left, right = [], []
        for i in range(len(ids) - 1):
            total = n[i] + n[i + 1:]
            maybe = (c[i + 1:] != c[i]) & (100 * np.minimum(n[i], n[i + 1:]) >= percent * np.maximum(n[i], n[i + 1:]))
            if side[i]:
                maybe &= side[i + 1:] != side[i]
            j = np.flatnonzero(maybe)
            if len(j):
                bits = np.bitwise_count(x[i + 1 + j] ^ x[i]).sum(1)
                near = bits <= (100 - percent) * total[j] // (100 + percent)
                left.append(np.full(int(near.sum()), i))
                right.append(i + 1 + j[near])
        if not left:
            return None
        p, q = np.concatenate(left), np.concatenate(right)
        return np.minimum(ids[p], ids[q]), np.maximum(ids[p], ids[q])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in tiles_of(batches, ("key", "tile")):
            got = compare(tile) if tile.num_rows > 1 else None
            if got is not None and len(got[0]):
                yield pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1])], names=["a", "b"])

    return (rows.select("key", "tile", "side", "id", "c", "n", "sketch").repartition(F.col("key"), F.col("tile"))
            .sortWithinPartitions("key", "tile").mapInArrow(run, "a long, b long"))


def dealings(bands: np.ndarray) -> np.ndarray:
    """How often documents of a join with so many bands are dealt at most: fewer
    times where poor pairs are many, so that their combinations stay fewer than
    the bands. It depends on the join only, so partners agree on it."""
    poor = np.maximum(2 * POOR_SHARE * bands / 2, 1.0)
    out = np.full(len(bands), DEALINGS)
    for n in range(DEALINGS, 1, -1):
        out[(out == n) & (poor ** n > bands)] = n - 1
    return out


def _dealt(owner: np.ndarray, h: np.ndarray, klass: np.ndarray, bands: np.ndarray, deal: int):
    """One dealing: ((owner, key) of all band keys, (owner, number) of all poor
    pairs). Tokens are grouped by owner."""
    own = textbuf.mix64(h + np.uint64(0x632BE59BD9B4E019 * deal & (1 << 64) - 1)) if deal else h
    band = (own >> np.uint64(20)) % bands.astype(np.uint64)
    value = textbuf.mix64((own & np.uint64((1 << BAND_BITS) - 1)) + np.uint64(0x2545F4914F6CDD1D))
    # one slot per (owner, band): owners' bands laid out one after the other
    first_token = np.concatenate([[True], owner[1:] != owner[:-1]])
    index = np.cumsum(first_token) - 1
    heads = np.flatnonzero(first_token)
    base = np.cumsum(bands[heads]) - bands[heads]
    slot = base[index] + band.astype(np.int64)
    slots = int(bands[heads].sum())
    tokens = np.bincount(slot, minlength=slots)
    order = np.argsort(slot, kind="stable")
    ordered = slot[order]
    xor = np.zeros(slots, dtype=np.uint64)
    begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    xor[ordered[begin]] = np.bitwise_xor.reduceat(value[order], begin)
    slot_head = np.repeat(heads, bands[heads])
    slot_band = np.arange(slots) - np.repeat(base, bands[heads])
    salt = textbuf.mix64((klass[slot_head].astype(np.uint64) * np.uint64(1 << 32) + slot_band.astype(np.uint64) + np.uint64(1))
                         ^ np.uint64(0x9E6C63D0876A9A47 * deal & (1 << 64) - 1))
    other = np.arange(slots) + 1 - 2 * (slot_band % 2)                       # the other band of the pair
    full = tokens > 0
    beside = (tokens[other[slot]] == 0) & (tokens[slot] > 1)                 # beside an empty band: each token left out
    at = slot[beside]
    keys = (np.concatenate([owner[slot_head[full]], owner[beside]]),
            np.concatenate([textbuf.mix64(xor[full] ^ salt[full]), textbuf.mix64((xor[at] ^ value[beside]) ^ salt[at])]))
    poor = np.flatnonzero((tokens + tokens[other] <= 1) & (slot_band % 2 == 0))
    return keys, (owner[slot_head[poor]], salt[poor])


def _band_keys(owner: np.ndarray, h: np.ndarray, klass: np.ndarray, bands: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, key) of all band keys; klass and bands are given per token (of
    its owner's join). Tokens are grouped by owner."""
    heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    ids, most = owner[heads], dealings(bands[heads])
    enough = np.array([spare(n) for n in (bands[heads] // 2).tolist()])
    at = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(owner))))
    who, mark = np.arange(len(heads)), np.zeros(len(heads), dtype=np.uint64)    # poor pairs met so far, combined
    out = []
    for deal in range(DEALINGS):
        (o, key), (poor, number) = _dealt(at, h, klass, bands, deal)
        out.append((ids[o], key))
        count = np.bincount(poor, minlength=len(ids))
        times = np.where(count > enough, count, 0)[who]
        if not times.sum():
            break
        pick = np.repeat((np.cumsum(count) - count)[who] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        who, mark = np.repeat(who, times), textbuf.mix64(np.repeat(mark, times) * np.uint64(0x9FB21C651E98DF25) + number[pick])
        done = most[who] == deal + 1
        out.append((ids[who[done]], mark[done]))
        who, mark = who[~done], mark[~done]
        on = np.zeros(len(ids), dtype=bool)
        on[who] = True
        on = on[at]
        if not on.any():
            break
        at, h, klass, bands = at[on], h[on], klass[on], bands[on]
    return np.concatenate([o for o, _ in out]), np.concatenate([k for _, k in out])


def band_rows(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, ratio: float = CLASS_RATIO) -> DataFrame:
    """(key, doc_id): the band keys of every document, of a set met before in
    the same task only once."""
    classes = size_classes(percent, ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joins: dict[int, list[tuple[int, int]]] = {}
        seen: set[int] = set()
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for first, rows, owner, h in shingles.blocks(b.column(1), width):
                count = np.bincount(owner, minlength=rows)
                begin = np.cumsum(count) - count
                fresh = np.zeros(rows, dtype=bool)
                at = np.flatnonzero(count)
                prints = np.zeros(rows, np.uint64)
                if len(at):
                    prints[at] = np.add.reduceat(textbuf.mix64(h ^ np.uint64(0xA0761D6478BD642F)), begin[at])
                for i in at.tolist():
                    p = int(prints[i])
                    if p not in seen:
                        fresh[i] = True
                        if len(seen) < SEEN_LIMIT:
                            seen.add(p)
                klass, bands = np.zeros((2, rows), np.int64), np.zeros((2, rows), np.int64)
                for i in np.flatnonzero(fresh).tolist():
                    n = int(count[i])
                    if n not in joins:
                        joins[n] = join_bands(n, percent, classes)
                    for s, (k, nb) in enumerate(joins[n]):
                        klass[s, i], bands[s, i] = k, nb
                for s in range(2):
                    use = bands[s][owner] > 0
                    if use.any():
                        o = owner[use]
                        who, key = _band_keys(o, h[use], klass[s][o], bands[s][o])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(key.view(np.int64)), pa.array(ids[first + who].astype(np.int64))], names=["key", "doc_id"])

    return _text_rows(docs.where(F.col("doc_id").isNotNull())).mapInArrow(run, "key long, doc_id long")


def star_pairs(rows: DataFrame) -> DataFrame:
    """(key, leader, doc_id): every document of a key with the key's smallest
    id. Each task streams its keys in order and holds one batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_leader, last_id = None, None, None
        for b in batches:
            key = b.column(0).to_numpy(zero_copy_only=False)
            ids = b.column(1).to_numpy(zero_copy_only=False)
            if not len(key):
                continue
            new = np.concatenate([[last_key is None or key[0] != last_key], key[1:] != key[:-1]])
            begin = np.flatnonzero(new)
            leader = np.empty(len(key), dtype=np.int64)
            head = int(begin[0]) if len(begin) else len(key)
            leader[:head] = last_leader if last_leader is not None else 0
            if len(begin):
                leader[head:] = np.repeat(ids[begin], np.diff(np.append(begin, len(key))))
            before = np.concatenate([[last_id if last_id is not None else ids[0]], ids[:-1]])
            use = ~new & (ids != leader) & (ids != before)
            last_key, last_leader, last_id = int(key[-1]), int(leader[-1]), int(ids[-1])
            if use.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[use]), pa.array(leader[use]), pa.array(ids[use])],
                                                 names=["key", "leader", "doc_id"])

    return (rows.repartition(F.col("key")).sortWithinPartitions("key", "doc_id")
            .mapInArrow(run, "key long, leader long, doc_id long"))


def token_sets(docs: DataFrame, ids: DataFrame, width: int = WIDTH) -> DataFrame:
    """(id, tokens binary): sorted shingle hashes of the documents in ``ids``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = []
            for _, rows, owner, h in shingles.blocks(b.column(1), width):
                count = np.bincount(owner, minlength=rows)
                ends = np.cumsum(count)
                cells += [h[e - c:e].tobytes() for c, e in zip(count, ends)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(cells, pa.binary())], names=["id", "tokens"])

    rows = _text_rows(docs).join(ids, F.col("doc_id") == F.col("id"), "left_semi")
    return rows.mapInArrow(run, "id long, tokens binary").dropDuplicates(["id"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The (a, b) of ``pairs`` that reach the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = np.zeros(b.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3))):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                common = int((q[at] == p).sum()) if len(q) else 0
                good[i] = 100 * common >= percent * (len(p) + len(q) - common)
            mask = pa.array(good)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])

    left = sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))
    return (pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
            .mapInArrow(run, "a long, b long"))


def _mixed_tiles(member: DataFrame, labels: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows (key, tile, side, id, c, n, sketch) of the keys whose documents are in
    more than one component, cut into tiles of two chunks."""
    of = member.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("c"))
    mixed = of.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m")).where("lo <> hi and m > 2")
    return (of.join(mixed.select("key", "m"), "key").join(facts.select("rep", "n", F.col("wide").alias("sketch")), "rep").withColumnRenamed("rep", "id")
            .withColumn("_k", F.ceil(F.col("m") / CHUNK).cast("int"))
            .withColumn("_c", F.pmod(F.xxhash64(F.lit(7), "id"), F.col("_k")).cast("int"))
            .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
            .withColumn("tile", tile_of(F.col("_c"), F.col("_o")))
            .withColumn("side", F.when(F.col("_o") == F.col("_c"), 0).when(F.col("_o") > F.col("_c"), 1).otherwise(2)))


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT,
                       ratio: float = CLASS_RATIO) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Documents link when 100 * intersection >= ``percent`` * union of their
    shingle sets; component_id is the smallest doc_id reachable by links, the
    own one included. Texts without words (null, empty, blank) have empty sets
    and link with nothing. Rows that share a doc_id are one document; should
    their texts differ, one of them stands for it in links. Rows
    without doc_id take part in no link and have a null component. Other columns
    are ignored; an empty table gives an empty result.
    """
    summary = staged(set_summaries(docs, width), "jaccard-sets")
    usable = summary.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    copies = (usable.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").cast("long").alias("rep"), F.count("*").alias("c"))
              .where("c > 1").drop("c"))
    copies = staged(copies, "jaccard-groups")                         # groups of equal sets only
    of_row = (usable.select("doc_id", "f1", "f2", "n_shingles").join(small_side(copies), ["f1", "f2", "n_shingles"], "left")
              .select(F.col("doc_id").cast("long").alias("id"), F.coalesce("rep", F.col("doc_id").cast("long")).alias("rep")))
    of_row = staged(of_row, "jaccard-copies")
    release(copies)
    one = of_row.groupBy("id").agg(F.min("rep").alias("rep"))        # rows that share an id are one document
    facts = (usable.select(F.col("doc_id").cast("long").alias("rep"), F.col("n_shingles").alias("n"), "sketch", "wide")
             .join(of_row.where("id = rep").select("rep"), "rep", "left_semi").dropDuplicates(["rep"]))
    facts = staged(facts, "jaccard-facts")
    star = staged(star_pairs(band_rows(docs, width, percent, ratio)), "jaccard-star")

    # The leader of a key against its other documents.
    met = (star.select("leader", "doc_id").distinct()
           .join(one.select(F.col("id").alias("leader"), F.col("rep").alias("_x")), "leader")
           .join(one.select(F.col("id").alias("doc_id"), F.col("rep").alias("_y")), "doc_id")
           .where("_x <> _y").select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b")).distinct())
    sized = (met.join(facts.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
             .join(facts.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
             .where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))
    first = staged(near_sketches(sized, percent), "jaccard-pairs")

    def links_of(pairs: DataFrame) -> DataFrame:
        ids = staged(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "id"), "jaccard-ids")
        sets = staged(token_sets(docs, small_side(ids), width), "jaccard-tokens")
        out = staged(verified(pairs, sets, percent), "jaccard-links")
        release(ids, sets)
        return out

    links = links_of(first)
    same_id = of_row.select(F.col("id").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct()
    labels = components(links.unionByName(same_id))

    # Keys whose documents are in more than one component: all their pairs across components.
    member = (star.select("key", F.col("leader").alias("id")).distinct()
              .unionByName(star.select("key", F.col("doc_id").alias("id"))).join(one, "id").select("key", "rep").distinct())
    member = staged(member, "jaccard-members")
    release(star)
    second = staged(cross_pairs(_mixed_tiles(member, labels, facts), percent).distinct().join(first, ["a", "b"], "left_anti"),
                    "jaccard-pairs")
    release(member, facts, first)
    if not second.isEmpty():
        labels = components(links.unionByName(links_of(second)).unionByName(same_id))
    return (summary.join(labels.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", F.col("doc_id").cast("long")).alias("component_id")))


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One document of each component, all columns: the one with the smallest
    doc_id. Of rows that share a doc_id one stays; rows without doc_id stay.
    Only ids are joined to the documents, never texts to texts."""
    found = staged(jaccard_components(docs, width, percent), "jaccard-components")
    dropped = staged(found.where("doc_id <> component_id").select("doc_id").distinct(), "jaccard-dropped")
    kept = docs.join(small_side(dropped), "doc_id", "left_anti").select(*docs.columns)
    again = staged(found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id"),
                   "jaccard-repeated")
    if again.isEmpty():
        return kept
    again = small_side(again)
    return (kept.join(again, "doc_id", "left_anti").select(*docs.columns)
            .unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)))
