"""Mixing sources to target weights by pivotal dependent rounding.

Sources take target shares of a budget (a multiple of all words), capped at a
multiple of their own size; the excess is reshared by weight until no source
is above its cap. Every document of a source starts with the same expected
number of copies, ``target / source size``; its whole part is certain and its
fraction is rounded together with the others:

* two fractional documents of one source meet; words are moved from one to the
  other, in a randomly chosen direction with probabilities that keep both
  expectations, until one of the fractions is 0 or 1. Moving *words* (fraction
  times size) keeps the total of the source exactly;
* inside a bucket of a source the survivor meets the next document, which
  leaves one fractional document per bucket. The survivors of ``FAN`` buckets
  meet on the next level of a tree, and so on up to one per source.

The last survivor of a source has nobody to meet: it takes its fraction in
whole words (``whole_copies=False``), so a source misses its target by half a
word at most, or is rounded to a copy or none (``whole_copies=True``).

Buckets are hashes of the document, never whole sources, so a source that
holds a third of all rows is as many tasks as its rows need. Only doc_id, size
and source cross a shuffle. Random numbers are hashes of (seed, doc_id,
repetition), so reruns agree whatever the partitioning.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatsift.llm.common import small_side, staged, task_count

WORD_RX = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BUDGET_SHARE = 1.5
MAX_COPIES = 2.0
BUCKET_ROWS = 2_000
FAN = 64
EPS = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RX)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = BUDGET_SHARE,
                   max_copies: float = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) from a table with ``source`` and ``size``.

    Water filling: sources sorted by cap / weight; the level at which the
    uncapped ones share what is left follows from running sums. The table has
    one row per source name, so it is sorted in one task.
    """
    total = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
             .withColumn("_k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
             .withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                            (F.col("_k") % len(weights) + 1).cast("int")))
             .withColumn("_cap", F.col("source_size") * F.lit(float(max_copies))))
    order = Window.orderBy((F.col("_cap") / F.col("_w")), "_k")
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (total
             .withColumn("_budget", F.least(F.sum("source_size").over(everything) * F.lit(float(share)),
                                            F.sum("_cap").over(everything)))
             .withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
             .withColumn("_open", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
             .withColumn("_level", (F.col("_budget") - F.col("_capped")) / F.col("_open"))
             .withColumn("_fits", F.col("_level") <= F.col("_cap") / F.col("_w")))
    line = F.min_by(F.col("_level"), F.when(F.col("_fits"), F.col("_cap") / F.col("_w")))
    level = level.withColumn("_line", line.over(everything))
    return level.select("source", "source_size",
                        F.least(F.col("_cap"), F.coalesce(F.col("_line") * F.col("_w"), F.col("_cap"))).alias("target"))


def pivot_bucket(size: np.ndarray, frac: np.ndarray, dice: np.ndarray) -> tuple[np.ndarray, int]:
    """Round the fractions of one bucket; returns (fractions, index of the one
    still fractional or -1). Documents meet in the given order."""
    out = frac.copy()
    held = -1
    for j in range(len(out)):
        if out[j] <= EPS or out[j] >= 1 - EPS:
            out[j] = round(out[j])
            continue
        if held < 0:
            held = j
            continue
        i = held
        si, sj = size[i], size[j]
        up = min((1 - out[i]) * si, out[j] * sj)       # words from j to i
        down = min(out[i] * si, (1 - out[j]) * sj)     # words from i to j
        move = up if dice[j] * (up + down) < down else -down
        out[i] += move / si
        out[j] -= move / sj
        if EPS < out[j] < 1 - EPS:
            out[i] = round(out[i])
            held = j
        else:
            out[j] = round(out[j])
            if not EPS < out[i] < 1 - EPS:
                out[i] = round(out[i])
                held = -1
    return out, held


def _reduce(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["_dice", "_copy"], kind="stable").reset_index(drop=True)
    frac, held = pivot_bucket(pdf["size"].to_numpy(float), pdf["_frac"].to_numpy(float), pdf["_dice"].to_numpy(float))
    pdf["_frac"] = frac
    pdf["_open"] = np.arange(len(pdf)) == held
    return pdf


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = BUDGET_SHARE,
        max_copies: float = MAX_COPIES, seed: int = 17, whole_copies: bool = False,
        bucket_rows: int = BUCKET_ROWS, fan: int = FAN) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row.

    ``docs`` needs doc_id, source and text; other columns are ignored. A null
    or empty text has size 0, no copies and takes nothing. The null source is
    a source of its own, sorted last. Rows that repeat (same doc_id, source,
    size) are rounded one by one; an empty table gives an empty result.
    ``copies`` are whole copies; ``taken`` = copies * size plus, for at most
    one document per source, the words of its last fraction.
    """
    base = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    base = staged(base, "mix-sizes")
    targets = small_side(staged(source_targets(base, weights, share, max_copies), "mix-targets"))
    keyed = base.groupBy("doc_id", "source", "size").agg(F.count("*").alias("_n"))
    keyed = keyed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).drop("_n")
    rated = (keyed.join(targets, keyed["source"].eqNullSafe(targets["source"]), "left")
             .select(keyed["doc_id"], keyed["source"], "size", "_copy", "source_size", "target",
                     F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("_rate")))
    rated = rated.select("*", F.floor("_rate").cast("long").alias("_whole")).withColumn(
        "_frac", F.when(F.col("size") > 0, F.col("_rate") - F.col("_whole")).otherwise(F.lit(0.0)))
    h = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.col("source"), F.col("size"), F.col("_copy"))
    rated = rated.withColumn("_dice", F.pmod(h, F.lit(1 << 52)).cast("double") / float(1 << 52))
    rows = base.count()
    buckets = max(1, math.ceil(rows / bucket_rows))
    if buckets == 1:
        buckets = min(task_count(docs), 64)
    rated = rated.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed + 1), h), F.lit(buckets)))
    schema = rated.withColumn("_open", F.lit(False)).schema
    done = []
    level, parts = rated, buckets
    while True:
        level = staged(level.groupBy("source", "_bucket").applyInPandas(_reduce, schema), "mix-level")
        if parts == 1:
            done.append(level)
            break
        done.append(level.where(~F.col("_open")))
        parts = math.ceil(parts / fan)
        level = level.where("_open").drop("_open").withColumn("_bucket", F.col("_bucket") % parts)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    last = F.when(~F.col("_open"), F.round("_frac") * F.col("size"))
    if whole_copies:
        dice = F.pmod(F.xxhash64(F.lit(seed + 2), F.col("_dice")), F.lit(1 << 52)).cast("double") / float(1 << 52)
        last = last.otherwise(F.when(dice < F.col("_frac"), F.col("size")).otherwise(F.lit(0)))
    else:
        last = last.otherwise(F.round(F.col("_frac") * F.col("size")))
    return out.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("_whole") + F.when(F.col("_open") & F.lit(not whole_copies), F.lit(0))
         .otherwise((last / F.greatest(F.col("size"), F.lit(1))).cast("long"))).alias("copies"),
        (F.col("_whole") * F.col("size") + last.cast("long")).alias("taken"))


def repeat_rows(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = BUDGET_SHARE,
                max_copies: float = MAX_COPIES, seed: int = 17) -> DataFrame:
    """Every row of ``docs``, all columns, as often as the mix takes it (whole
    copies). Rows are matched by a hash of id, source and text; of m equal rows
    each gets its share of their copies."""
    keyed = docs.withColumn("__mix_row", F.xxhash64("doc_id", "source", "text"))
    mixed = mix(keyed.select(F.col("__mix_row").alias("doc_id"), "source", "text"), weights, share, max_copies, seed, whole_copies=True)
    copies = staged(mixed.groupBy(F.col("doc_id").alias("__mix_row")).agg(F.sum("copies").alias("__mix_c"), F.count("*").alias("__mix_m")), "mix-copies")
    ranked = keyed.join(copies, "__mix_row")          # broadcast only if Spark measures it as small
    if not copies.where("__mix_m > 1").isEmpty():
        ranked = ranked.withColumn("__mix_r", F.row_number().over(Window.partitionBy("__mix_row").orderBy("__mix_c")))
    else:
        ranked = ranked.withColumn("__mix_r", F.lit(1))
    n = F.floor(F.col("__mix_c") / F.col("__mix_m")) + (F.col("__mix_r") <= F.col("__mix_c") % F.col("__mix_m")).cast("long")
    return (ranked.withColumn("__mix_n", n.cast("int")).where("__mix_n > 0")
            .withColumn("__mix_i", F.explode(F.sequence(F.lit(1), F.col("__mix_n")))).select(*docs.columns))
