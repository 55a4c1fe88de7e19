"""Embedding near-duplicates by collision counting over 1-D projections.

Two unit vectors at cosine c lie at distance sqrt(2 - 2c); along a random
direction their coordinates differ by a normal variable of that deviation. So a
pair above the threshold falls into a *query-centred window* (one vector's
coordinate plus or minus ``WINDOW``) on nearly every one of many sorted
projections, a pair of strangers only on some.

* Grouping: the projections are sorted and cut into slots of width ``SLOT``
  with a random offset; a table is the combination of ``per_table`` projections,
  and vectors that share all slots of a table meet. The number of projections
  per table grows with the logarithm of the rows, so the vectors that meet by
  chance stay few; the number of tables follows from the wanted recall at
  exactly the threshold (pairs above it are found more surely).
* Counting: of two vectors that meet, the collisions over ``COUNTED`` projections
  are counted; the count that a pair at the threshold reaches with probability
  ``COUNT_RECALL`` (binomial) must be passed. Then the cosine is computed in
  double precision.
* A pair is used in the first table only in which it meets, so link counts add
  up without gathering pairs: every cell emits, per vector, a number of links
  and one edge to the smallest id of its connected part of the cell.

Equal vectors are collapsed first and counted with their multiplicity. A cell
with many vectors is cut into chunks, and the pairs of chunks are separate
tiles, so no task holds more than two chunks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatsift.llm import textbuf
from threatsift.llm.common import staged, tile_of
from threatsift.llm.components import components

THRESHOLD = 0.95
SLOT = 2.0
WINDOW = 0.8
TABLE_RECALL = 0.985
COUNT_RECALL = 0.999
MEET = 8                # vectors that may meet by chance in one cell
COUNTED = 48            # projections whose collisions are counted
CHUNK = 512
SEED = 5


def plan(rows: int, threshold: float = THRESHOLD) -> tuple[int, int, int]:
    """(tables, projections per table, collisions a pair must reach)."""
    sigma = math.sqrt(2 - 2 * threshold)

    def same_slot(deviation: float) -> float:
        """Chance that two coordinates at a normal distance share a slot."""
        z = np.linspace(-8, 8, 4001) * deviation
        density = np.exp(-0.5 * (z / deviation) ** 2)
        return float((np.clip(1 - np.abs(z) / SLOT, 0, 1) * density).sum() / density.sum())

    near, far = same_slot(sigma), same_slot(math.sqrt(2))
    per_table = max(2, math.ceil(math.log(max(rows / MEET, 2)) / -math.log(far)))
    tables = max(2, math.ceil(math.log(1 - TABLE_RECALL) / math.log(1 - near ** per_table)))
    n = min(COUNTED, tables * per_table)
    p = math.erf(WINDOW / sigma / math.sqrt(2))
    cumulative, need = 0.0, 0
    for k in range(n + 1):          # largest count below which at most 1 - COUNT_RECALL of such pairs fall
        cumulative += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
                               + k * math.log(p) + (n - k) * math.log1p(-p))
        if cumulative > 1 - COUNT_RECALL:
            need = k
            break
    return tables, per_table, need


def directions(dims: int, tables: int, per_table: int) -> tuple[np.ndarray, np.ndarray]:
    """(dims, projections) normal directions and slot offsets; fixed seed."""
    rng = np.random.default_rng([SEED, dims])
    return rng.normal(size=(dims, tables * per_table)), rng.uniform(0, SLOT, size=tables * per_table)


def unit_rows(cells: pa.Array) -> np.ndarray:
    x = cells.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(cells), -1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def slots_of(h: np.ndarray, offset: np.ndarray, tables: int) -> np.ndarray:
    """(rows, tables) 64-bit cell of every table."""
    slot = np.floor((h + offset) / SLOT).astype(np.int64).astype(np.uint64).reshape(len(h), tables, -1)
    key = np.broadcast_to(textbuf.mix64(np.arange(1, tables + 1, dtype=np.uint64)), slot.shape[:2]).copy()
    for j in range(slot.shape[2]):
        key = textbuf.mix64(key * np.uint64(0x9FB21C651E98DF25) + slot[:, :, j])
    return key


def sound_vectors(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a non-zero vector of finite components, as doubles."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    norm = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)
    return (vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
            .where((norm > 0) & (norm < F.lit(float("inf"))))
            .select(F.col("vec_id").cast("long").alias("id"), "embedding", F.size("embedding").alias("dims"),
                    F.xxhash64(F.lit(1), x).alias("f1"), F.xxhash64(F.lit(2), x).alias("f2")))


def _cell_links(x: np.ndarray, h: np.ndarray, cells: np.ndarray, ids: np.ndarray, many: np.ndarray, side: np.ndarray,
                table: int, need: int, threshold: float):
    """Links of one cell: (weight of links per row, smallest id of each row's
    connected part). ``side`` 1 and 2 mark the two chunks of a tile, whose rows
    meet each other only; the tile of one chunk with itself is all 0."""
    n = len(ids)
    count = np.zeros((n, n), dtype=np.int16)
    for column in h[:, :COUNTED].T:                      # query-centred windows, one projection at a time
        count += np.abs(column[:, None] - column[None, :]) <= WINDOW
    pair = count >= need
    if side[0]:
        pair &= side[:, None] != side[None, :]
    np.fill_diagonal(pair, False)
    a, b = np.nonzero(np.triu(pair))
    if not len(a):
        return None
    keep = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
    a, b = a[keep], b[keep]
    if table:                                            # met in an earlier table already
        fresh = ~(cells[a, :table] == cells[b, :table]).any(1)
        a, b = a[fresh], b[fresh]
    if not len(a):
        return None
    weight = np.bincount(a, weights=many[b], minlength=n) + np.bincount(b, weights=many[a], minlength=n)
    label = ids.copy()
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == label).all():
            return weight.astype(np.int64), label
        label = new


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors link when their cosine in double precision reaches ``threshold``.
    Null vectors, zero vectors and vectors with null or non-finite components
    link with nothing and form a component alone; vectors of different lengths
    do not link. Equal vectors link with each other. Rows with one vec_id and
    different vectors are one node of the components, each with its own links;
    a null vec_id links with nothing and has a null component. ``kept`` marks
    the smallest id of a component. Other columns are ignored; an empty table
    gives an empty result.
    """
    sound = staged(sound_vectors(vectors), "vectors")
    groups = sound.groupBy("dims", "f1", "f2").agg(F.min_by("embedding", "id").alias("embedding"), F.min("id").alias("rep"),
                                                   F.count("*").alias("many"))
    groups = staged(groups, "vector-groups")
    sizes = {r["dims"]: r["n"] for r in groups.groupBy("dims").agg(F.count("*").alias("n")).collect()}
    found = None
    for dims, rows in sorted(sizes.items()):
        part = _links(groups.where(F.col("dims") == dims).select("rep", "many", "embedding"), dims, rows, threshold)
        found = part if found is None else found.unionByName(part)
    members = sound.join(groups.select("dims", "f1", "f2", "rep", "many"), ["dims", "f1", "f2"]).select("id", "rep", "many")
    if found is None:
        linked = members.select("id", "rep", F.lit(0).cast("long").alias("n_links"))
        edges = members.select(F.col("id").alias("a"), F.col("rep").alias("b"))
    else:
        found = staged(found, "vector-links")
        weights = found.groupBy("rep").agg(F.sum("weight").alias("w"))
        linked = members.join(weights, "rep", "left").select(
            "id", "rep", (F.coalesce("w", F.lit(0)) + F.col("many") - 1).alias("n_links"))
        edges = (found.select(F.col("rep").alias("a"), F.col("leader").alias("b"))
                 .unionByName(members.select(F.col("id").alias("a"), F.col("rep").alias("b"))))
    labels = components(edges)
    per_id = linked.groupBy("id").agg(F.max("n_links").cast("long").alias("n_links"))
    out = (vectors.select("vec_id").join(per_id, F.col("vec_id") == F.col("id"), "left").drop("id")
           .join(labels.withColumnRenamed("id", "_l"), F.col("vec_id") == F.col("_l"), "left"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component", F.col("vec_id").cast("long")).alias("component_id")) \
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _links(reps: DataFrame, dims: int, rows: int, threshold: float) -> DataFrame:
    """(rep, weight, leader): links of the distinct vectors of one length."""
    tables, per_table, need = plan(rows, threshold)

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        towards, offset = directions(dims, tables, per_table)
        for b in batches:
            if not b.num_rows:
                continue
            cell = slots_of(unit_rows(b.column("embedding")) @ towards, offset, tables)
            row = np.repeat(np.arange(b.num_rows), tables)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell.ravel().view(np.int64)), pa.array(np.tile(np.arange(tables, dtype=np.int32), b.num_rows)),
                 b.column("rep").take(pa.array(row))], names=["cell", "t", "rep"])

    places = staged(reps.mapInArrow(cells_of, "cell long, t int, rep long"), "vector-cells")
    counted = places.groupBy("cell").count().where("count > 1")
    placed = (places.join(counted, "cell").join(reps, "rep")
              .withColumn("_k", F.ceil(F.col("count") / CHUNK).cast("int"))
              .withColumn("_c", F.pmod(F.xxhash64(F.lit(SEED), "rep"), F.col("_k")).cast("int"))
              .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
              .withColumn("tile", tile_of(F.col("_c"), F.col("_o")))
              .withColumn("side", F.when(F.col("_o") == F.col("_c"), 0).when(F.col("_o") > F.col("_c"), 1).otherwise(2)))
    tiled = (placed.select("cell", "tile", "side", "t", "rep", "many", "embedding")
             .repartition(F.col("cell"), F.col("tile")).sortWithinPartitions("cell", "tile"))

    def tile_links(ids, many, x, h, cells, side, t):
        got = _cell_links(x, h, cells, ids, many, side, t, need, threshold)
        if got is None:
            return None
        weight, label = got
        use = weight > 0
        return ids[use], weight[use], label[use]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        towards, offset = directions(dims, tables, per_table)
        held: pa.Table | None = None

        def links(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.combine_chunks()
            col = {c: table.column(c).to_numpy() for c in ("cell", "tile", "side", "t", "rep", "many")}
            x = unit_rows(table.column("embedding").chunk(0))
            h = x @ towards
            cells = slots_of(h, offset, tables)
            begin = np.flatnonzero(np.concatenate([[True], (np.diff(col["cell"]) != 0) | (np.diff(col["tile"]) != 0)]))
            out = []
            for i, j in zip(begin, np.append(begin[1:], len(x))):
                if j - i > 1:
                    s = slice(i, j)
                    got = tile_links(col["rep"][s], col["many"][s], x[s], h[s], cells[s], col["side"][s], int(col["t"][i]))
                    if got is not None:
                        out.append(got)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["rep", "weight", "leader"])

        for b in batches:
            if not b.num_rows:
                continue
            table = pa.Table.from_batches([b])
            if held is not None:
                table = pa.concat_tables([held, table])
            cell, tile = table.column("cell").to_numpy(), table.column("tile").to_numpy()
            last = np.flatnonzero((cell != cell[-1]) | (tile != tile[-1]))     # the last tile may go on in the next batch
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from links(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None and held.num_rows:
            yield from links(held)

    return tiled.mapInArrow(run, "rep long, weight long, leader long")
