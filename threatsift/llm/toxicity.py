"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its character n-grams (hashed into a
fixed table, with word borders); a document is the mean of its words; a linear
softmax over that mean gives the classes. Vectors and softmax are trained
jointly in numpy on a bounded sample of labelled rows. Since everything before
the softmax is an average, the trained model folds into one number per n-gram,
so an unseen misspelling is scored by the n-grams it shares with known words.

Documents are long and hold few toxic words, which a mean over the whole text
dilutes. A document is therefore judged by the averages of several bags of it:
its strongest single word, its five strongest words and the whole text; a
logistic calibration, cross-fitted on the labelled rows, turns the three into
one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatsift.llm import textbuf
from threatsift.llm.common import hash_sample, held_out
from threatsift.llm.gbdt import sigmoid

TABLE = 1 << 17
GRAMS = (3, 4, 5)
DIM = 8
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 1_000, 3_000, 10_000
THRESHOLD = 0.3
SCALE = 20.0
TOP = 5
FOCUS = 8


@dataclass(frozen=True)
class Words:
    """Words of a block of texts: ``doc`` and distinct-word index per word;
    n-gram buckets of the distinct words, grouped by word."""

    doc: np.ndarray
    word: np.ndarray
    grams: np.ndarray
    first: np.ndarray      # (distinct + 1) offsets into grams


def _grams(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words cp[start:end] with a border mark on
    both sides, grouped by word."""
    size = end - start
    padded = size + 2
    first = np.concatenate([[0], np.cumsum(padded)])
    buf = np.full(int(first[-1]), 1, dtype=np.uint64)                # 1: border
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    buf[np.repeat(first[:-1] + 1, size) + inside] = textbuf.mix64(cp[np.repeat(start, size) + inside].astype(np.uint64))
    word = np.repeat(np.arange(len(size)), padded)
    left = first[1:][word] - np.arange(len(buf))
    owners, buckets = [], []
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        h = np.zeros(len(at), dtype=np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + buf[at + j]
        owners.append(word[at])
        buckets.append((textbuf.mix64(h + np.uint64(n)) % np.uint64(TABLE)).astype(np.int32))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(size))
    return np.concatenate(buckets)[order], np.concatenate([[0], np.cumsum(counts)])


def words_of(texts: list[str]) -> Words:
    cp, start, _ = textbuf.code_points([t.lower() for t in texts])
    ws, we = textbuf.runs(textbuf.is_word_char(cp))
    _, at, word = np.unique(textbuf.span_hashes(cp, ws, we), return_index=True, return_inverse=True)
    grams, first = _grams(cp, ws[at], we[at])
    return Words(np.searchsorted(start, ws, side="right") - 1, word, grams, first)


def word_scores(w: Words, table: np.ndarray) -> np.ndarray:
    """Mean contribution of the n-grams of every distinct word."""
    total = np.concatenate([[0.0], np.cumsum(table[w.grams], dtype=float)])
    return (total[w.first[1:]] - total[w.first[:-1]]) / np.maximum(np.diff(w.first), 1)


def bag(w: Words, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights) of the mean of one text's words; with a ``table``,
    of its ``FOCUS`` distinct words that score highest under it."""
    if not len(w.word):
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    size = np.diff(w.first)
    if table is None:
        share = np.bincount(w.word, minlength=len(size)) / len(w.word)
    else:
        best = np.argsort(-word_scores(w, table), kind="stable")[:FOCUS]
        share = np.bincount(best, minlength=len(size)) / len(best)
    share = np.repeat(share / np.maximum(size, 1), size)
    kept = share > 0
    buckets, inverse = np.unique(w.grams[kept], return_inverse=True)
    return buckets, np.bincount(inverse, weights=share[kept], minlength=len(buckets)).astype(np.float32)


def train(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, epochs: int = 8,
          batch: int = 64, rate: float = 0.05, seed: int = 3) -> np.ndarray:
    """Joint fit of n-gram vectors and softmax (adaptive gradient steps);
    returns the log-odds contribution of every n-gram. The intercept is left to
    the calibration."""
    rng = np.random.default_rng(seed)
    vectors = (rng.normal(size=(TABLE, DIM)) * 0.1 / np.sqrt(DIM)).astype(np.float32)
    soft = (rng.normal(size=(DIM, 2)) * 0.1).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen_v = np.full((TABLE, 1), 1e-8, np.float32)
    seen_s, seen_b = np.full(soft.shape, 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    usable = np.array([i for i, b in enumerate(bags) if len(b[0])], dtype=np.int64)
    for _ in range(epochs):
        order = rng.permutation(usable)
        for k in range(0, len(order), batch):
            rows = order[k:k + batch]
            count = np.array([len(bags[r][0]) for r in rows])
            gram = np.concatenate([bags[r][0] for r in rows])
            share = np.concatenate([bags[r][1] for r in rows]) * np.float32(SCALE)
            first = np.cumsum(count) - count
            mean = np.add.reduceat(vectors[gram] * share[:, None], first, axis=0)
            z = mean @ soft + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= (weight[rows] / weight[rows].sum())[:, None].astype(np.float32)
            back = np.repeat(p @ soft.T, count, axis=0) * share[:, None]
            distinct, inverse = np.unique(gram, return_inverse=True)
            step = np.stack([np.bincount(inverse, weights=back[:, c], minlength=len(distinct)) for c in range(DIM)],
                            axis=1).astype(np.float32)
            seen_v[distinct, 0] += (step ** 2).mean(1)
            vectors[distinct] -= rate * step / np.sqrt(seen_v[distinct])
            step_s, step_b = mean.T @ p, p.sum(0)
            seen_s += step_s ** 2
            seen_b += step_b ** 2
            soft -= rate * step_s / np.sqrt(seen_s)
            bias -= rate * step_b / np.sqrt(seen_b)
    return (vectors @ (soft[:, 1] - soft[:, 0]) * SCALE).astype(np.float32)


def _pool(w: Words, docs: int, table: np.ndarray) -> np.ndarray:
    out = np.zeros((docs, 3))
    if not len(w.word):
        return out
    score = word_scores(w, table)[w.word]
    count = np.bincount(w.doc, minlength=docs)
    order = np.lexsort((-score, w.doc))
    doc, ranked = w.doc[order], score[order]
    rank = np.arange(len(doc)) - (np.cumsum(count) - count)[doc]
    top = rank < TOP
    out[doc[rank == 0], 0] = ranked[rank == 0]
    out[:, 1] = np.bincount(doc[top], weights=ranked[top], minlength=docs) / TOP
    out[:, 2] = np.bincount(w.doc, weights=score, minlength=docs) / np.maximum(count, 1)
    return out


def pooled(texts: list[str], table: np.ndarray) -> np.ndarray:
    """(texts, 3) log odds of the strongest word, the mean of the strongest
    ``TOP`` words (counted with repetitions) and the whole text. No words: zeros."""
    parts = [_pool(words_of(held), len(held), table) for _, held in textbuf.blocks(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, 3))


def train_focused(words: list[Words], y: np.ndarray) -> np.ndarray:
    """Two joint fits: on the means of whole texts, then on the means of each
    text's strongest words under the first fit, which the few toxic words of a
    long text are no longer diluted in."""
    even = np.ones(len(y))
    first = train([bag(w) for w in words], y, even)
    return train([bag(w, first) for w in words], y, even)


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50, l2: float = 1.0) -> np.ndarray:
    """Logistic regression on standardised columns (Newton steps); returns raw
    coefficients and the intercept."""
    mean, std = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / std, np.ones(len(x))])
    beta = np.zeros(z.shape[1])
    ridge = np.diag([l2] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = sigmoid(z @ beta)
        grad = z.T @ (weight * (p - y)) + ridge @ beta
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge + 1e-6 * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    raw = beta[:-1] / std
    return np.append(raw, beta[-1] - (raw * mean).sum())


@dataclass(frozen=True)
class Model:
    table: np.ndarray
    beta: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        x = pooled(texts, self.table)
        return sigmoid(x @ self.beta[:-1] + self.beta[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN,
                 chars: int = SAMPLE_CHARS) -> Model:
    """Fit on about ``toxic`` + ``clean`` labelled rows outside the held-out
    fold whose text has at most ``chars`` characters, taken by a hash of the id. The calibration sees each half of them through vectors fitted
    on the other half; the vectors of the model are fitted on all. Weights restore the class shares of all labelled rows."""
    usable = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y")))
    shares = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}
    ids = (hash_sample(usable.where("y = 1"), toxic, "doc_id")
           .unionByName(hash_sample(usable.where("y = 0"), clean, "doc_id")))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = (docs.where(F.length(text) <= chars).select("doc_id", text.alias("text")).join(F.broadcast(ids), "doc_id")
            .dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id"))
    y = rows["y"].to_numpy(dtype=np.int64)
    have = np.bincount(y, minlength=2)
    if len(y) == 0 or have.min() < 4:
        n1, n = shares.get(1, 0), sum(shares.values())
        rate = (n1 + 0.5) / (n + 1.0)
        return Model(np.zeros(TABLE, np.float32), np.array([0.0, 0.0, 0.0, np.log(rate / (1 - rate))]))
    weight = np.array([shares.get(c, 0) / max(have[c], 1) for c in (0, 1)])[y]
    words = [words_of([t]) for t in rows["text"]]
    half = np.zeros(len(y), dtype=np.int64)
    for c in (0, 1):                       # halves with both classes
        half[np.flatnonzero(y == c)[1::2]] = 1
    x = np.zeros((len(y), 3))
    for other in (0, 1):                   # each half is pooled by the other's fit
        mine, rest = np.flatnonzero(half == other), np.flatnonzero(half != other)
        table = train_focused([words[i] for i in rest], y[rest])
        x[mine] = np.concatenate([_pool(words[i], 1, table) for i in mine])
    beta = calibrate(x, y.astype(float), weight)
    return Model(train_focused(words, y), beta)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    ``docs`` needs doc_id and text, ``labels`` doc_id and toxic; other columns
    are not read. A null or empty text has no words and gets the intercept.
    Repeated rows are scored one by one. Without both classes among the labels
    every score is the smoothed share of toxic rows. An empty table gives an
    empty result. Scoring is one narrow pass over whole texts.
    """
    held = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held.value.score(b.column(1).to_pylist()))],
                                             names=["doc_id", "score"])

    scored = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(run, schema)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
