"""Tokenizers behind one interface (F9, K3) and the ranked word vocabulary.

A tokenizer has ``encode(df, key, text_col, max_len)``: one row per key with

- ``n_tokens``: the number of tokens of the whole text (NULL text: 0),
- ``input_ids``: start, at most ``max_len - 2`` token ids, end, padding,
- ``attention_mask``: 1 for start, tokens and end, 0 for padding.

``key`` names the columns that identify a row; whatever else should come along
(label, split) is named there too.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatsift.functions.text import all_words
from threatsift.operators import model as MD
from threatsift.operators.joins import checked_broadcast
from threatsift.session import bound_arrow_batches, cut_lineage

# Fixed values of the layout: start 0, padding 1, end 2 (see ``model``), then
# the id of every word outside the vocabulary.
UNK_ID = 3
FIRST_WORD_ID = 4


def word_tokens(text) -> Column:
    """The words of a text, in order (NULL: none)."""
    return F.filter(all_words(text), lambda w: w != "")


def token_counts(df: DataFrame, tokens: Column) -> DataFrame:
    """(token, n): occurrences over all rows, summed in every task first, so a
    frequent word crosses the shuffle once a task."""
    return df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def exact_rank(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """Adds the 1-based position of every row in the total order ``order``.

    Rows are dealt into ranges of the order and written; each range is counted
    and numbered on its own, from the sum of the ranges before it. No task sees
    more than one range, and the table of offsets has one row a range. ``order``
    must tell all rows apart, or equal rows are numbered in any order."""
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    numbered = placed.withColumn("_i", inside).join(checked_broadcast(offsets, ranges), "_range")
    return numbered.withColumn(out, F.col("_off") + F.col("_i")).drop("_range", "_off", "_i")


def ranked_vocabulary(counts: DataFrame, size: int | None = MD.VOCAB_SIZE) -> DataFrame:
    """(token, n, id) of the most frequent tokens of a (token, n) table: ids
    follow the count, ties the token's bytes, and start after the special ids.
    ``size`` is the model's vocabulary size, special ids included (None: every
    token gets an id); it never depends on the data."""
    ranked = exact_rank(counts, [F.col("n").desc(), F.col("token").asc()])
    v = ranked.select("token", "n", (F.col("rank") + (FIRST_WORD_ID - 1)).alias("id"))
    return v if size is None else v.filter(F.col("id") < size)


def _laid_out(df: DataFrame, key: list[str], ids: Column, max_len: int) -> DataFrame:
    input_ids, mask = MD.fixed_length(ids, max_len)
    return df.select(*key, "n_tokens", input_ids.alias("input_ids"), mask.alias("attention_mask"))


class HashedTokenizer:
    """Ids by hashing words (``model.token_ids``): no vocabulary, no shuffle."""

    def encode(self, df: DataFrame, key: list[str], text_col: str, max_len: int) -> DataFrame:
        t = df.select(*key, MD.token_ids(F.col(text_col)).alias("_ids"))
        return _laid_out(t.withColumn("n_tokens", F.size("_ids")), key, F.col("_ids"), max_len)


class RankedTokenizer:
    """Ids from a (token, id) table, ``UNK_ID`` for words outside it. The table
    is joined by word: broadcast only behind a check of its size, else both sides
    are shuffled and Spark splits a frequent word's rows. A row contributes at
    most ``max_len - 2`` words, the ones its sequence keeps; texts do not move,
    and the sequence of a key comes together from (position, id) pairs."""

    def __init__(self, vocabulary: DataFrame, size: int = MD.VOCAB_SIZE, tokens: Callable = word_tokens):
        self.vocabulary = vocabulary.select(F.col("token").alias("_token"), F.col("id").alias("_id"))
        self.size = size
        self.tokens = tokens

    def encode(self, df: DataFrame, key: list[str], text_col: str, max_len: int) -> DataFrame:
        kept = F.slice("_tokens", 1, max_len - 2)
        t = df.select(*key, self.tokens(F.col(text_col)).alias("_tokens"))
        t = t.select(*key, F.size("_tokens").alias("n_tokens"), F.posexplode_outer(kept).alias("_pos", "_token"))
        j = t.join(checked_broadcast(self.vocabulary, self.size), "_token", "left")
        pair = F.struct("_pos", F.coalesce("_id", F.lit(UNK_ID)).cast("long").alias("_id"))
        # a key without words has one row, whose position is NULL
        pairs = F.sort_array(F.collect_list(F.when(F.col("_pos").isNotNull(), pair)))
        g = j.groupBy(*key, "n_tokens").agg(pairs.alias("_pairs"))
        return _laid_out(g, key, F.col("_pairs")["_id"], max_len)


class PandasTokenizer:
    """Any Python tokenizer: ``factory()`` builds ``fn(str) -> list[int]`` once a
    task. Ids are moved up by the number of special ids. Only counts and the
    kept ids come back from Python; texts are encoded one at a time, and a task
    holds the ids of ``CHUNK`` texts and one Arrow batch of texts."""

    CHUNK = 100

    def __init__(self, factory: Callable[[], Callable[[str], list[int]]], shift: int = MD.N_SPECIAL):
        self.factory = factory
        self.shift = shift

    def encode(self, df: DataFrame, key: list[str], text_col: str, max_len: int) -> DataFrame:
        factory, shift, room, chunk = self.factory, self.shift, max_len - 2, self.CHUNK

        @F.pandas_udf("n int, ids array<long>")
        def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            fn = factory()
            for texts in batches:
                for lo in range(0, len(texts), chunk):
                    counts, kept = [], []
                    for t in texts.iloc[lo:lo + chunk]:
                        ids = fn(t) if isinstance(t, str) else []
                        counts.append(len(ids))
                        kept.append(np.asarray(ids[:room], dtype=np.int64) + shift)
                    yield pd.DataFrame({"n": counts, "ids": kept})

        bound_arrow_batches(df.sparkSession)
        t = df.select(*key, encoded(F.col(text_col)).alias("_e"))
        t = t.select(*key, F.col("_e.n").alias("n_tokens"), F.col("_e.ids").alias("_ids"))
        return _laid_out(t, key, F.col("_ids"), max_len)


def file_tokenizer(path: str) -> Callable[[], Callable[[str], list[int]]]:
    """Factory for ``PandasTokenizer``: a tokenizer file of the ``tokenizers``
    library, read in every task from a path that all executors see. Special
    strings inside a text are treated as the library's default has it; none
    are added."""
    def build():
        tok = _loaded(path, os.stat(path).st_mtime_ns)
        return lambda text: tok.encode(text, add_special_tokens=False).ids
    return build


@functools.lru_cache(maxsize=1)
def _loaded(path: str, changed: int):
    """One tokenizer a Python worker, whatever the number of its tasks."""
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def token_sink(df: DataFrame, tokenizer, key: list[str], text_col: str, max_len: int, path: str,
               partition_by: str = "split") -> DataFrame:
    """K3: sequences of any tokenizer written as Parquet, partitioned by the
    split; returns the written table."""
    out = tokenizer.encode(df, key, text_col, max_len)
    out.write.mode("overwrite").partitionBy(partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)
