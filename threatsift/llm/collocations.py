"""Phrase collocation mining by top-order marginalisation.

Only the longest windows are counted: each word with the words that lead it
(``SPAN`` in all), padded at the end of its piece. Every shorter phrase is a
prefix of windows, so a Spark ROLLUP over (lang, first word, second, third) sums
all counts from the one table.

Windows that cannot matter are shortened before: a window of k words whose count
stays below the least count gives its occurrences to its first k - 1 words. That
keeps every prefix sum and every count of ``least`` or more, and leaves few rows
for the ROLLUP. A shortening needs the complete count of a window, so windows
are dealt by a hash of all their words, once per length; they travel in compact
batches (``windows``). Counted in each task first and dealt by the whole window,
no word, pair or language gathers anywhere.

Scores are exact: products are decimals, quotients integer divisions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatsift.llm import windows as W
from threatsift.llm.common import small_side, staged

LEAST = 10                     # least count of a candidate
TOP = 2_000
COVERED_PERCENT = 50           # a longer candidate with this share covers a shorter one
BUCKET_CHARS = 8_000_000       # characters whose windows one bucket may hold
TASK_WINDOWS = 2_000_000       # distinct windows a task holds before it passes them on
COLUMNS = [f"w{i + 1}" for i in range(W.SPAN)]
_SCHEMA = "lang string, bucket int, size int, batch binary, " + ", ".join(f"{c} string" for c in COLUMNS) + ", n long"
_ARROW = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("size", pa.int32()), ("batch", pa.binary()),
                    *[(c, pa.string()) for c in COLUMNS], ("n", pa.int64())])


def _batch_rows(lang: str, batches: Iterator[tuple[int, bytes, int]]) -> Iterator[pa.RecordBatch]:
    for bucket, data, size in batches:
        cells = {"lang": lang, "bucket": bucket, "size": size, "batch": data}
        yield pa.RecordBatch.from_pylist([cells], schema=_ARROW)


def _plain_rows(lang: str, words: list[bytes], columns: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
    text = pa.array(words, pa.binary()).cast(pa.string())
    rows = len(n)
    none = [pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())]
    cells = [text.take(pa.array(c)) for c in columns] + [pa.array([""] * rows, pa.string())] * (W.SPAN - len(columns))
    return pa.RecordBatch.from_arrays([pa.array([lang] * rows, pa.string()), *none, *cells, pa.array(n)], schema=_ARROW)


def counted_windows(docs: DataFrame, buckets: int, limit: int = TASK_WINDOWS) -> DataFrame:
    """Batches of the windows counted in each task, by bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, W.Windows] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                for words in W.word_lists(text.as_py()):
                    held.setdefault(lang, W.Windows(limit)).add(words)
                    if held[lang].full():
                        yield from _batch_rows(lang, held[lang].batches(buckets))
            if sum(w.rows + len(w.words) for w in held.values()) > 2 * limit:     # many languages
                for lang, w in held.items():
                    yield from _batch_rows(lang, w.batches(buckets))
                held = {}
        for lang, w in held.items():
            yield from _batch_rows(lang, w.batches(buckets))

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, _SCHEMA)


def shortened(rows: DataFrame, span: int, buckets: int, least: int) -> DataFrame:
    """Windows of ``span`` words, complete per bucket: those counted ``least``
    times stay as plain rows, the occurrences of the others go to their first
    words, in batches of the next shorter span (span 1: to their language).
    Plain rows of earlier steps pass through."""
    def step(lang: str, batches: list[tuple[bytes, int]]) -> Iterator[pa.RecordBatch]:
        words, columns, (rest, total) = W.merged(batches, span, 2)
        stays = (columns[-1] > 0) & (total >= least)
        at = np.flatnonzero(stays & (rest > 0))
        for lo in range(0, len(at), 10_000):
            some = at[lo:lo + 10_000]
            yield _plain_rows(lang, words, [c[some] for c in columns], rest[some])
        rest = np.where(stays, 0, rest)
        if span == 1:
            if rest.sum():
                yield _plain_rows(lang, [W.PAD], [np.zeros(1, np.int64)], np.array([rest.sum()]))
            return
        prefix, values = W.grouped(columns[:-1], len(words), [rest, total])
        yield from _batch_rows(lang, W.cut(words, prefix, values, buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for b in batches:
            is_plain = b.column("batch").is_null()
            plain = b.filter(is_plain)
            if plain.num_rows:
                yield plain.cast(_ARROW)
            b = b.filter(pc.invert(is_plain))
            for lang, bucket, size, data in zip(*(b.column(c) for c in ("lang", "bucket", "size", "batch"))):
                if key != (lang.as_py(), bucket.as_py()):
                    if held:
                        yield from step(key[0], held)
                    key, held = (lang.as_py(), bucket.as_py()), []
                held.append((data.as_py(), size.as_py()))
        if held:
            yield from step(key[0], held)

    spread = F.coalesce("bucket", F.pmod(F.xxhash64(*COLUMNS), F.lit(buckets)).cast("int"))
    return (rows.withColumn("_at", spread).repartition("lang", "_at").sortWithinPartitions("lang", "bucket").drop("_at")
            .mapInArrow(run, _SCHEMA))


def phrase_counts(docs: DataFrame, least: int = LEAST, bucket_chars: int = BUCKET_CHARS,
                  limit: int = TASK_WINDOWS) -> tuple[DataFrame, DataFrame]:
    """((lang, k, phrase, f) of all phrases of up to ``SPAN`` words that occur
    ``least`` times, (lang, n) of all words)."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(1, -(-chars // bucket_chars))
    rows = counted_windows(docs, buckets, limit)
    for span in range(W.SPAN, 0, -1):
        rows = shortened(rows, span, buckets, least)
    rows = staged(rows.select("lang", *COLUMNS, "n"), "collocation-windows")
    sums = rows.rollup("lang", *COLUMNS).agg(F.sum("n").alias("f"))
    k = sum((F.col(c).isNotNull().cast("int") for c in COLUMNS), F.lit(0))
    sums = sums.where("lang IS NOT NULL").select(
        "lang", k.alias("k"), F.concat_ws(" ", *COLUMNS).alias("phrase"), F.col("f").cast("long").alias("f"),
        F.greatest(F.lit(False), *[F.coalesce(F.col(c) == "", F.lit(False)) for c in COLUMNS]).alias("_padded"))
    sums = staged(sums.where(f"NOT _padded AND (k = 0 OR f >= {least})").drop("_padded"), "collocation-counts")
    return sums.where("k > 0"), sums.where("k = 0").select("lang", F.col("f").alias("n"))


def _part(lo: Column, size: Column) -> Column:
    """Words lo .. lo + size - 1 (from 1) of the phrase in ``_w``."""
    return F.array_join(F.slice("_w", lo, size), " ")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, bucket_chars: int = BUCKET_CHARS,
                 limit: int = TASK_WINDOWS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of
    two or more words.

    A phrase occurs within pieces of a text (split at ``.,;:!?`` and line breaks),
    overlaps included; words are runs without space and tab, A-Z lowered. Cut after
    k words, l and r are the counts of its parts; the cut of the lowest score
    floor(10**6 a a / (l r)) counts, the smallest k on ties. Phrases inside a longer
    candidate of at least half their count are left out. Order: score and a
    descending, phrase in byte order. A null text is empty, a null lang is ``und``;
    repeated rows count as often, texts may be of any length, other columns are
    ignored and an empty table gives an empty result.
    """
    counts, totals = phrase_counts(docs, least, bucket_chars, limit)
    phrases = counts.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("_w"))
    cuts = (phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
            .select("lang", "phrase", "a", "cut", _part(F.lit(1), F.col("cut")).alias("_left"),
                    _part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("_right")))
    part = counts.select("lang", "phrase", "f")
    scored = (cuts.join(part.select("lang", F.col("phrase").alias("_left"), F.col("f").alias("l")), ["lang", "_left"])
              .join(part.select("lang", F.col("phrase").alias("_right"), F.col("f").alias("r")), ["lang", "_right"])
              .withColumn("score", F.expr("(CAST(1000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)))"
                                          " div (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))")))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r")).alias("_b")).select("lang", "phrase", "_b.*")
    inner = (phrases.where("k > 2").select("lang", "a", "k", "_w", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("_size"))
             .select("lang", "a", "_w", "_size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("_size") + 1)).alias("_lo"))
             .select("lang", "a", _part(F.col("_lo"), F.col("_size")).alias("phrase")))
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    kept = (best.join(longer, ["lang", "phrase"], "left")
            .where(F.col("_longer").isNull() | (100 * F.col("_longer") < COVERED_PERCENT * F.col("a"))))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return (ranked.join(small_side(totals), "lang")
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
