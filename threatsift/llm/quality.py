"""Quality classifier: boosted trees over document statistics.

One narrow pass turns every whole text into some thirty numbers (no shuffle,
texts never move); the numbers are written once. A bounded sample of labelled
rows is joined to them to fit the trees on the driver, and a second narrow pass
over the numbers scores every document by vectorised traversal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatsift.llm import gbdt, textbuf
from threatsift.llm.common import hash_sample, held_out, staged

SAMPLE_ROWS = 20_000
THRESHOLD = 0.7
FEATURES = (
    "log_chars", "log_words", "log_lines", "letters", "digits", "spaces", "upper", "non_ascii", "bang", "pipe",
    "hash_sym", "dollar", "percent", "amp", "star", "other_sym", "sentence_marks", "commas", "word_len", "long_words",
    "short_words", "upper_words", "sym_end_words", "distinct_words", "repeat_adjacent", "top_run", "line_len",
    "distinct_lines", "short_lines", "closed_lines",
)


def _sums(mask: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return (total[end] - total[start]).astype(float)


def _distinct(doc: np.ndarray, key: np.ndarray, docs: int) -> np.ndarray:
    if not len(doc):
        return np.zeros(docs)
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (k[1:] != k[:-1])])
    return np.bincount(d[new], minlength=docs).astype(float)


def statistics(texts: list[str]) -> np.ndarray:
    """(texts, FEATURES) numbers; an empty text has zeros."""
    out = np.zeros((len(texts), len(FEATURES)), dtype=np.float32)
    for first, held in textbuf.blocks(texts):
        out[first:first + len(held)] = _block(held)
    return out


def _block(texts: list[str]) -> np.ndarray:
    cp, start, end = textbuf.code_points(texts)
    docs = len(texts)
    n = (end - start).astype(float)
    chars = np.maximum(n, 1)
    space = (cp == 32) | ((cp >= 9) & (cp <= 13))
    letter = textbuf.is_word_char(cp)
    digit = (cp >= 48) & (cp <= 57)
    upper = ((cp >= 65) & (cp <= 90)) | ((cp >= 0xC0) & (cp <= 0xDE) & (cp != 0xD7))
    def share(mask):
        return _sums(mask, start, end) / chars
    def count(c):
        return _sums(cp == ord(c), start, end)
    end_mark = (cp == 46) | (cp == 63)
    other = ~(letter | space | end_mark | (cp == 44) | (cp == 0))
    ws, we = textbuf.runs(~space & (cp != 0))
    doc = np.searchsorted(start, ws, side="right") - 1
    words = np.bincount(doc, minlength=docs).astype(float)
    per_word = np.maximum(words, 1)
    size = (we - ws).astype(float)
    hashes = textbuf.span_hashes(cp, ws, we)
    last = cp[we - 1] if len(we) else cp[:0]
    upper_total = np.concatenate([[0], np.cumsum(upper)])
    letter_total = np.concatenate([[0], np.cumsum(letter & ~digit)])
    shouted = ((upper_total[we] - upper_total[ws]) == (letter_total[we] - letter_total[ws])) & (size > 1) \
        & ((letter_total[we] - letter_total[ws]) > 1)
    sym_end = (last < 128) & ~((last >= 48) & (last <= 57)) & ~((last >= 65) & (last <= 90)) \
        & ~((last >= 97) & (last <= 122)) & (last != 46) & (last != 44) & (last != 63)
    def of_words(mask):
        return np.bincount(doc[mask], minlength=docs) / per_word
    same = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])]) if len(doc) else np.zeros(0, bool)
    rs, re_ = textbuf.runs(same)
    longest = np.zeros(docs)
    if len(rs):
        np.maximum.at(longest, doc[rs], (re_ - rs + 1).astype(float))
    ls, le = textbuf.runs((cp != 10) & (cp != 13) & (cp != 0))
    line_doc = np.searchsorted(start, ls, side="right") - 1
    lines = np.bincount(line_doc, minlength=docs).astype(float)
    per_line = np.maximum(lines, 1)
    line_size = (le - ls).astype(float)
    line_last = cp[le - 1] if len(le) else cp[:0]
    closed = (line_last == 46) | (line_last == 63) | (line_last == 33)
    columns = [
        np.log1p(n), np.log1p(words), np.log1p(lines), share(letter), share(digit), share(space),
        _sums(upper, start, end) / np.maximum(_sums(letter, start, end), 1), share(cp >= 128),
        count("!") / per_word, count("|") / per_word, count("#") / per_word, count("$") / per_word,
        count("%") / per_word, count("&") / per_word, count("*") / per_word, share(other),
        _sums(end_mark, start, end) / per_word, count(",") / per_word,
        np.bincount(doc, weights=size, minlength=docs) / per_word,
        of_words(size > 12), of_words(size <= 3), of_words(shouted), of_words(sym_end),
        _distinct(doc, hashes, docs) / per_word, np.bincount(doc[same], minlength=docs) / per_word,
        longest, np.bincount(line_doc, weights=line_size, minlength=docs) / per_line,
        _distinct(line_doc, textbuf.span_hashes(cp, ls, le), docs) / per_line,
        np.bincount(line_doc[line_size < 20], minlength=docs) / per_line,
        np.bincount(line_doc[closed], minlength=docs) / per_line,
    ]
    return np.stack(columns, axis=1).astype(np.float32)


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and ``_x``, the statistics of the whole text (null: empty)."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("_x", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column(1).to_pylist())
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]),
                                             pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), cells], names=schema.names)

    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_text")).mapInArrow(run, schema)


def label_sample(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, y): about ``rows`` labelled rows outside the held-out fold, taken
    by a hash of the id; a document labelled twice counts once, with its larger
    label."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    return hash_sample(usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")), rows, "doc_id")


def fit_quality(stats: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> gbdt.Trees:
    sample = (stats.join(F.broadcast(label_sample(labels, "quality", sample_rows)), "doc_id")
              .select("doc_id", "y", "_x").dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id"))
    x = np.array(sample["_x"].tolist(), dtype=float).reshape(len(sample), len(FEATURES))
    return gbdt.fit(x, sample["y"].to_numpy(dtype=float))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
              sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches ``threshold``:
    ``score_quality``'s decisions taken in one narrow pass over the whole rows,
    after a fit on the sampled rows only."""
    ids = label_sample(labels, "quality", sample_rows).select("doc_id")
    trees = fit_quality(document_statistics(docs.join(F.broadcast(ids), "doc_id", "left_semi")), labels, sample_rows)
    held = docs.sparkSession.sparkContext.broadcast(trees)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics([t or "" for t in b.column(at).to_pylist()])
            yield b.filter(pa.array(held.value.probability(x.astype(float)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
                  sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted); score: probability of quality 1.

    ``docs`` needs doc_id and text, ``labels`` doc_id and quality; other
    columns are not read. A null text counts as empty; an empty text is scored
    by its (zero) statistics. Rows that repeat are scored one by one. The fit
    uses at most ``sample_rows`` labelled rows outside the held-out fold;
    without labels, or with one class only, every score is the smoothed share
    of good rows. An empty table gives an empty result.
    """
    stats = staged(document_statistics(docs), "quality-stats")
    trees = fit_quality(stats, labels, sample_rows)
    held = docs.sparkSession.sparkContext.broadcast(trees)
    schema = T.StructType([stats.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("_x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(held.value.probability(x))],
                                             names=schema.names)

    scored = stats.mapInArrow(run, schema)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
