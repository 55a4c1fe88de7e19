"""Seeded, exact sampling and splitting at scale (hash_rank, C10-C12).

``hash_rank`` gives every row a 1-based rank inside its class in the order of
``md5(key|seed)``, without any window spanning a whole class:

1. ``h = md5(key|seed)``, bucket ``b`` = first ``k`` hex digits, k from the
   number of rows;
2. per-(class, bucket) counts (at most classes x 16^k rows) and their
   running offsets, computed on that small table;
3. rank = offset(class, b) + row_number() over (class, b ordered by h, key).

The offsets table is joined with a size-checked broadcast. Counts match
pandas / sklearn exactly; row membership differs (different RNG), by design.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatsift.operators.joins import checked_broadcast
from threatsift.settings import DEFAULT, Settings


def seeded_hash(key, seed: int = DEFAULT.seed) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(k.cast("string"), F.lit(f"|{seed}")))


BUCKET_ROWS = 50_000
MAX_BUCKET_DIGITS = 8


def bucket_digits_for(rows: int) -> int:
    """Hex digits of the bucket, so that a bucket holds about ``BUCKET_ROWS``."""
    return min(MAX_BUCKET_DIGITS, max(2, math.ceil(math.log(max(rows / BUCKET_ROWS, 1), 16))))


def hash_rank(df: DataFrame, key: str, class_col: str | None = "label", seed: int = DEFAULT.seed,
              bucket_digits: int | None = None, settings: Settings = DEFAULT, out: str = "rank",
              below: int | None = None) -> DataFrame:
    """Adds ``out`` (1-based rank within class) and ``_h`` (the hash). The number
    of buckets follows the row count. With ``below``, only rows of at most that
    rank are returned, and buckets that start beyond it are dropped before any
    row is shuffled or sorted."""
    cls = [class_col] if class_col else []
    digits = bucket_digits or bucket_digits_for(df.count())
    h = df.withColumn("_h", seeded_hash(key, seed)).withColumn("_b", F.substring("_h", 1, digits))
    counts = h.groupBy(*cls, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w_off = Window.partitionBy(*cls).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w_off), F.lit(0))).drop("_n")
    if below is not None:
        offsets = offsets.filter(F.col("_off") < below)
    offsets = checked_broadcast(offsets, min(16 ** digits * 64, settings.broadcast_row_limit))
    j = h.join(offsets, [*cls, "_b"], "inner")
    w = Window.partitionBy(*cls, "_b").orderBy("_h", key)
    if below is not None:
        return (j.withColumn(out, F.col("_off") + F.row_number().over(w)).filter(F.col(out) <= below).drop("_b", "_off"))
    return j.withColumn(out, F.col("_off") + F.row_number().over(w)).drop("_b", "_off")


def seeded_shuffle(df: DataFrame, key: str, seed: int = DEFAULT.seed) -> DataFrame:
    """Whole-table deterministic order (a distributed range sort) plus
    the 1-based position of each row."""
    r = hash_rank(df, key, None, seed, out="shuffle_pos")
    return r.orderBy("_h", key)


MAX_CLASSES = 10_000


def class_counts(df: DataFrame, class_col: str = "label") -> dict:
    """Per-class row counts, returned to the driver; a column with more than
    ``MAX_CLASSES`` values is no class column and an error."""
    rows = df.groupBy(class_col).count().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{class_col} has more than {MAX_CLASSES} values")
    return {r[0]: r[1] for r in rows}


def balance_undersample(df: DataFrame, key: str, class_col: str = "label", seed: int = DEFAULT.seed) -> DataFrame:
    """C11: exactly n = min class count rows per class."""
    counts = class_counts(df, class_col)
    n = min(counts.values()) if counts else 0
    digits = bucket_digits_for(sum(counts.values()))
    return hash_rank(df, key, class_col, seed, digits, below=n).drop("_h")


def approximate_mode(counts: dict, n_draws: int) -> dict:
    """Per-class allocation of ``n_draws`` proportional to ``counts``:
    floors first, the remainder to the largest fractional parts (ties:
    lowest class)."""
    total = sum(counts.values())
    if total == 0:
        return {k: 0 for k in counts}
    exact = {k: counts[k] * n_draws / total for k in counts}
    out = {k: math.floor(v) for k, v in exact.items()}
    need = n_draws - sum(out.values())
    for k in sorted(counts, key=lambda k: (-(exact[k] - out[k]), k))[:max(need, 0)]:
        out[k] += 1
    return out


def split_quotas(counts: dict, test_size: float = 0.30, second_test_size: float = 0.50) -> dict:
    """C12 quotas per class: {class: (train, validation, test)}."""
    if any(v < 2 for v in counts.values()):
        raise ValueError("every class needs at least 2 rows to stratify")
    n = sum(counts.values())
    n_temp = math.ceil(test_size * n)
    train = approximate_mode(counts, n - n_temp)
    temp = {k: counts[k] - train[k] for k in counts}
    n_test2 = math.ceil(second_test_size * n_temp)
    val = approximate_mode(temp, n_temp - n_test2)
    return {k: (train[k], val[k], temp[k] - val[k]) for k in counts}


def stratified_split(df: DataFrame, key: str, class_col: str = "label", seed: int = DEFAULT.seed) -> DataFrame:
    """70/15/15 with exact label-proportional counts; adds ``split``."""
    counts = class_counts(df, class_col)
    quotas = split_quotas(counts)
    tr = F.create_map(*[x for k, q in quotas.items() for x in (F.lit(k), F.lit(q[0]))])
    va = F.create_map(*[x for k, q in quotas.items() for x in (F.lit(k), F.lit(q[0] + q[1]))])
    r = hash_rank(df, key, class_col, seed, bucket_digits_for(sum(counts.values())))
    split = (F.when(F.col("rank") <= tr[F.col(class_col)], F.lit("train"))
             .when(F.col("rank") <= va[F.col(class_col)], F.lit("validation"))
             .otherwise(F.lit("test")))
    return r.withColumn("split", split).drop("_h")


def split_leakage(splits: DataFrame, key: str, split_col: str = "split") -> DataFrame:
    """Rows of the training split whose key also occurs in another split
    (left-semi join by key); empty when the splits are disjoint."""
    train = splits.filter(F.col(split_col) == "train")
    other = splits.filter(F.col(split_col) != "train").select(key)
    return train.join(other, key, "left_semi")


def class_weights(df: DataFrame, class_col: str = "label") -> DataFrame:
    """M6: inverse-frequency weights n / (k * count)."""
    counts = df.groupBy(class_col).agg(F.count(F.lit(1)).alias("n_rows"))
    w = Window.partitionBy()
    return counts.select(class_col, "n_rows",
                         (F.sum("n_rows").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_rows"))).alias("weight"))
