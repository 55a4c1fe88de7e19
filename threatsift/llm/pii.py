"""PII: candidate spans, boosted trees over format and context, calibrated thresholds.

*Base spans* are exact: four patterns with their checks (address parts, Luhn
digit, digit counts). They are found by a linear scan over the runs of
characters a pattern can consist of, so a hostile text (a million digits, a
million letters before one ``@``) costs no more than its length.

*Added spans* come from high-recall generators whose candidates overlap:
written-out addresses (``name at host dot org``), numbers without the ``+``,
short cards, long network addresses. Boosted trees judge each candidate by its
format and its context; a threshold per run, calibrated on the half of the
rows the trees have not seen, selects the redactions. Candidates that overlap
a base span or a better candidate are dropped.

The trees learn from the corpus itself: base spans of all documents, rewritten
in the forms the generators look for, are the positives; numbers the checks
reject, and base spans broken so that they fail their check, are the negatives.
These rows stay on the cluster, equal ones once with their number: the bins of
the features, every level of a tree and the threshold come from Spark jobs over
all of them.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatsift.llm import gbdt
from threatsift.llm.common import hash_sample, release, staged

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98
BINS = 64
BLOCK_ROWS, MAX_BLOCKS = 20_000, 64      # rows of a task of the fit, up to this many tasks
SCORE_BUCKETS = 4096
Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMERIC = re.compile(r"[+0-9][0-9 ().+-]*")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches: all characters before an ``@`` that may stand there,
    if a dotted domain follows it. One pass over the ``@`` signs: a sign whose
    domain fails can belong to no other match."""
    out, floor = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            floor = m.end()
            at = text.find("@", m.end())
        else:
            floor = at + 1
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> dict[str, list[Span]]:
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    for run in _NUMERIC.finditer(text):
        lo, hi = run.span()
        if hi - lo < 7:
            continue
        for m in _IP.finditer(text, lo, hi):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out["ip"].append(m.span())
        for m in _CARD.finditer(text, lo, hi):
            d = digits_of(m.group())
            if 16 <= len(d) <= 19 and luhn(d):
                out["card"].append(m.span())
        for m in _PHONE.finditer(text, lo, hi):
            if 8 <= len(digits_of(m.group())) <= 15:
                out["phone"].append(m.span())
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (order[x[0]], x[1], x[2])))


# Candidate generators. Bounded repetitions keep each linear in the text.
_AT = r"(?: ?[\[({] ?at ?[\])}] ?| at |@)"
_DOT = r"(?: ?[\[({] ?dot ?[\])}] ?| dot |\.)"
_AT_SIGN = re.compile(r"[ @\[({](?:(?<=@)|(?<= )(?=at |[\[({] ?at ?[\])}])|(?<=[\[({])(?= ?at ?[\])}]))", re.I)   # where _AT matches
_AT_WHOLE = re.compile(_AT, re.I)
_HOST_OF = re.compile(rf"[\w-]{{1,63}}(?:{_DOT}[\w-]{{1,63}}){{1,4}}(?![\w-])", re.I)
_NAME_OF = re.compile(r"(?<![\w.+-])[\w.+-]{1,64}\Z")
_LOOSE_PHONE = re.compile(r"(?<![\w.+-])\(?[0-9]{2,5}\)?(?:[ .-]\(?[0-9]{2,5}\)?){1,5}(?![\w-])")
_LOOSE_CARD = re.compile(r"(?<![\w.+-])[0-9]{4}(?:[ .-]?[0-9]){9,15}(?![\w-])")
_LONG_IP = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])")


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Overlapping proposals beyond the base patterns."""
    out = []
    for sign in _AT_SIGN.finditer(text):             # every sign, with the name before it and the host behind it
        host = _HOST_OF.match(text, _AT_WHOLE.match(text, sign.start()).end())
        name = host and _NAME_OF.search(text, max(0, sign.start() - 65), sign.start())
        if name:
            out.append(("email", name.start(), host.end()))
    for run in re.finditer(r"[(0-9][0-9 ().-]{6,}", text):
        lo, hi = run.span()
        for kind, rx in (("phone", _LOOSE_PHONE), ("card", _LOOSE_CARD)):
            for m in rx.finditer(text, lo, hi):
                if 7 <= len(digits_of(m.group())):
                    out.append((kind, *m.span()))
    if text.count(":") >= 7:
        out += [("ip", *m.span()) for m in _LONG_IP.finditer(text)]
    return list(dict.fromkeys(out))


# Words near a span that speak for or against personal data.
_FOR = frozenset("call phone tel telephone mobile cell fax contact reach mail email e-mail write card visa credit ip address host "
                 "tel. telefon appel telefono correo anruf".split())
_AGAINST = frozenset("version v release license licence isbn issn order page section figure table id invoice no nr part model "
                     "sha md5 commit doi port error code total sum year".split())


def features(text: str, kind: str, start: int, end: int, own: str | None = None) -> list[float]:
    """Format of the span (``own`` replaces its text) and its context."""
    s = text[start:end] if own is None else own
    before, after = text[max(0, start - 40):start], text[end:end + 40]
    digits = digits_of(s)
    groups = [len(g) for g in re.findall(r"[0-9]+", s)] or [0]
    words = re.findall(r"[\w.-]+", before.lower())[-3:]
    letters = sum(c.isalpha() for c in s)
    return [
        *[float(kind == k) for k in KINDS], float(len(s)), float(len(digits)), float(letters), float(len(groups)),
        float(min(groups)), float(max(groups)), float(groups[0]), float(groups[-1]),
        float(s.count(" ")), float(s.count("-")), float(s.count(".")), float(s.count("(") + s.count(")")),
        float(s.count(":")), float(s.count("@")), float(bool(re.search(r"\bat\b", s, re.I))),
        float(len(re.findall(r"\bdot\b", s, re.I))), float(13 <= len(digits) <= 19 and luhn(digits)),
        float(len(set(digits))), float(any(w in _FOR for w in words)), float(any(w.rstrip(":=#") in _AGAINST for w in words)),
        float(before[-1:].isspace() or not before), float(after[:1].isspace() or not after or after[0] in ".,;"),
        float(before[-1:] in "#$€£%="), float(sum(c.isdigit() for c in before + after)),
        float(len(s.split(".")[-1]) if "." in s else 0), float(s[:1] == "0"),
    ]


def _training_rows(text: str) -> Iterator[tuple[list[float], int]]:
    """Rewritten base spans (1); rejected numbers and broken base spans (0)."""
    found = base_spans(text)
    taken = sorted(sp for spans in found.values() for sp in spans)
    starts, ends = [a for a, _ in taken], np.maximum.accumulate([b for _, b in taken] or [0])
    def row(kind, s, e, label, own=None):
        return features(text, kind, s, e, own), label
    for s, e in found["email"]:
        name, _, host = text[s:e].partition("@")
        for at, dot in ((" at ", " dot "), ("[at]", "[dot]"), (" (at) ", "."), (" [at] ", " [dot] "), ("(at)", "(dot)")):
            yield row("email", s, e, 1, name + at + host.replace(".", dot))
        yield row("email", s, e, 0, name + " at " + host.split(".")[0])
        yield row("email", s, e, 0, name + "@" + host.split(".")[0])
    for s, e in found["phone"]:
        d = digits_of(text[s:e])
        tail = d[-10:].rjust(10, "2")
        for own in (f"({tail[:3]}) {tail[3:6]}-{tail[6:]}", f"{tail[:3]}-{tail[3:6]}-{tail[6:]}",
                    f"{tail[:3]}.{tail[3:6]}.{tail[6:]}", f"{tail[:3]} {tail[3:6]} {tail[6:]}"):
            yield row("phone", s, e, 1, own)
        yield row("phone", s, e, 0, f"{tail[:4]}-{tail[4:6]}-{tail[6:8]}")     # a date
        yield row("phone", s, e, 0, f"{tail[:2]}.{tail[2:4]}.{tail[4:7]}")     # a version
        yield row("phone", s, e, 0, " ".join(tail[i:i + 2] for i in range(0, 10, 2)))
        yield row("phone", s, e, 0, f"{tail[:4]}-{tail[4:8]}")                 # a span of years
    for s, e in found["card"]:
        d = digits_of(text[s:e])
        body = d[:14]
        check = next(c for c in "0123456789" if luhn(body + c))
        yield row("card", s, e, 1, body + check)
        yield row("card", s, e, 1, f"{body[:4]} {body[4:10]} {body[10:]}{check}")
        wrong = str((int(check) + 5) % 10)
        yield row("card", s, e, 0, body + wrong)
        yield row("card", s, e, 0, d[:-1] + str((int(d[-1]) + 3) % 10))
        yield row("phone", s, e, 0, f"{d[:4]} {d[4:8]} {d[8:12]} {d[12:16]}")
    for s, e in found["ip"]:
        parts = text[s:e].split(".")
        yield row("ip", s, e, 1, ":".join(f"{int(p.lstrip('0') or 0) * 257 % 65536:x}" for p in (parts * 2)[:8]))
        yield row("phone", s, e, 0, ".".join(parts))
        yield row("card", s, e, 0, "".join(p.zfill(4) for p in parts))
    for kind, s, e in candidates(text):
        if kind != "email" and not ((i := bisect_left(starts, e)) and ends[i - 1] > s):
            d = digits_of(text[s:e])
            if not (kind == "card" and luhn(d)) and len(d) != 10:
                yield row(kind, s, e, 0)


@dataclass(frozen=True)
class Model:
    trees: gbdt.Trees
    threshold: float

    def select(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Added spans: best first, none overlapping a base span or a better one."""
        proposed = [c for c in candidates(text) if not any(s < c[2] and c[1] < e for _, s, e in base)]
        if not proposed:
            return []
        score = self.trees.probability(np.array([features(text, *c) for c in proposed]))
        kept: list[tuple[str, int, int]] = []
        for i in sorted(range(len(proposed)), key=lambda i: (-score[i], proposed[i][1], -proposed[i][2], proposed[i][0])):
            if score[i] < self.threshold:
                break
            if not any(s < proposed[i][2] and proposed[i][1] < e for _, s, e in kept):
                kept.append(proposed[i])
        return kept


N_FEATURES = len(features("", KINDS[0], 0, 0))


def training_table(docs: DataFrame) -> DataFrame:
    """(x, y, half, n): the distinct training rows of all texts that hold a digit
    or ``@`` and their number; x: the features, all whole numbers, as
    little-endian int32. Equal documents (id and text) count once. Half 0 is for
    the trees, half 1 for the threshold."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("digest", T.BinaryType()), T.StructField("x", T.BinaryType()),
                           T.StructField("y", T.IntegerType()), T.StructField("half", T.IntegerType()),
                           T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, digest, x, y, half, n = [], [], [], [], [], []
            for i, cell in enumerate(b.column(1)):
                text = cell.as_py()
                counts = Counter((np.array(row).tobytes(), label) for row, label in _training_rows(text))
                if not counts:
                    continue
                own = hashlib.sha256(text.encode()).digest()
                for (row, label), count in counts.items():
                    doc.append(i)
                    digest.append(own)
                    x.append(np.frombuffer(row).astype("<i4").tobytes())
                    y.append(label)
                    half.append(int(hashlib.md5(row).hexdigest()[:8], 16) % 2)
                    n.append(count)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(doc, pa.int64())), pa.array(digest, pa.binary()), pa.array(x, pa.binary()),
                 pa.array(y, pa.int32()), pa.array(half, pa.int32()), pa.array(n, pa.int64())], names=schema.names)

    rows = docs.select("doc_id", "text").where(F.col("text").rlike("[0-9@]")).mapInArrow(run, schema)
    rows = rows.groupBy("doc_id", "digest", "x", "y", "half").agg(F.max("n").alias("n"))
    return rows.groupBy("x", "y", "half").agg(F.sum("n").alias("n"))


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), N_FEATURES)


def quantile_edges(rows: DataFrame, total: int, bins: int = BINS) -> list[np.ndarray]:
    """``gbdt.bin_edges`` of all ``total`` rows, from the number of rows of every
    value of a feature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n = b.column(1).to_numpy()
            for f, column in enumerate(_vectors(b.column(0)).T):
                values, at = np.unique(column, return_inverse=True)
                count = np.bincount(at, weights=n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), f)), pa.array(values.astype(np.int64)),
                                                  pa.array(count)], names=["f", "v", "n"])

    counts = rows.select("x", "n").mapInArrow(run, "f long, v long, n long").groupBy("f", "v").agg(F.sum("n").alias("n"))
    below = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("f").orderBy("v")))
    places = F.array(*[F.lit(p).cast("long") for p in sorted({(total - 1) * i // bins for i in range(1, bins)})])
    cut = F.exists(places, lambda p: (p >= F.col("upto") - F.col("n")) & (p < F.col("upto")))
    found: list[list[int]] = [[] for _ in range(N_FEATURES)]
    for r in below.where(cut).select("f", "v").collect():
        found[r["f"]].append(r["v"])
    return [np.array(sorted(v), dtype=float) for v in found]


def _blocks(rows: DataFrame, edges: list[np.ndarray], vectors: int) -> DataFrame:
    """(bins, zeros, ones): the distinct rows of bin numbers with the number of
    their labels, many rows in each."""
    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _vectors(b.column(0))
            at = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1).astype(np.uint8)
            y, n = b.column(1).to_numpy(), b.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in at], pa.binary()), pa.array(n * (1 - y)),
                                              pa.array(n * y)], names=["bins", "zeros", "ones"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            columns = [b"".join(v for b in held for v in b.column(0).to_pylist()),
                       *[np.concatenate([b.column(i).to_numpy() for b in held]).tobytes() for i in (1, 2)]]
            return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], names=["bins", "zeros", "ones"])

        for b in batches:
            held.append(b)
            if sum(h.num_rows for h in held) >= BLOCK_ROWS:
                yield block()
                held = []
        if any(h.num_rows for h in held):
            yield block()

    distinct = rows.select("x", "y", "n").mapInArrow(binned, "bins binary, zeros long, ones long") \
        .groupBy("bins").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
    tasks = min(MAX_BLOCKS, -(-vectors // BLOCK_ROWS))
    return distinct.repartition(tasks).mapInArrow(packed, "bins binary, zeros binary, ones binary")


def _unpacked(r) -> gbdt.Block:
    return (np.frombuffer(r["bins"], np.uint8).reshape(-1, N_FEATURES), np.frombuffer(r["zeros"], np.int64),
            np.frombuffer(r["ones"], np.int64))


def calibrated(rows: DataFrame, trees: gbdt.Trees, precision: float = PRECISION) -> float:
    """Smallest score, at least 0.5, from which upward a share of ``precision`` of
    all rows are positive; 2 if there is none. Rows of equal score count together."""
    held = rows.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score, y, n = held.value.probability(_vectors(b.column(0)).astype(float)), b.column(1).to_numpy(), b.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(score), pa.array(n * y), pa.array(n)], names=["score", "ones", "n"])

    scores = rows.select("x", "y", "n").mapInArrow(run, "score double, ones long, n long") \
        .groupBy("score").agg(F.sum("ones").alias("ones"), F.sum("n").alias("n")) \
        .withColumn("bucket", F.floor(F.col("score") * SCORE_BUCKETS))
    scores = staged(scores, "pii-scores")
    above = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)      # over SCORE_BUCKETS rows
    totals = scores.groupBy("bucket").agg(F.sum("ones").alias("ones"), F.sum("n").alias("n"))
    totals = totals.select("bucket", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("ones", "n")])
    inside = Window.partitionBy("bucket").orderBy(F.desc("score"))
    running = scores.join(F.broadcast(totals), "bucket")
    ones, n = (F.sum(c).over(inside) + F.col(f"{c}_above") for c in ("ones", "n"))
    best = running.select("score", (ones / n).alias("share")).where(F.col("share") >= precision).agg(F.min("score")).first()[0]
    release(scores)
    return 2.0 if best is None else max(0.5, best)


def fit_pii(docs: DataFrame, sample_docs: int | None = None, sample_chars: int | None = None) -> Model:
    """Fit on the rows of every text (``training_table``). Half of them fit the
    trees, the other half sets the smallest threshold of the wanted precision.
    Without both kinds of rows in both halves nothing is added (threshold above
    1). For a trial, ``sample_docs`` bounds the number of documents and
    ``sample_chars`` their length; no query does."""
    if sample_docs is not None:
        docs = hash_sample(docs.select("doc_id", "text"), sample_docs, "doc_id", "text")
    if sample_chars is not None:
        docs = docs.where(F.length("text") <= sample_chars)
    rows = staged(training_table(docs), "pii-rows")
    seen = {(r["half"], r["y"]): r for r in rows.groupBy("half", "y").agg(F.sum("n").alias("n"), F.count("x").alias("rows")).collect()}
    if len(seen) < 4:
        release(rows)
        return Model(gbdt.constant(0.5), 2.0)
    mine, other = rows.where("half = 0"), rows.where("half = 1")
    zeros, ones = seen[0, 0], seen[0, 1]
    edges = quantile_edges(mine, zeros["n"] + ones["n"])
    blocks = staged(_blocks(mine, edges, zeros["rows"] + ones["rows"]), "pii-blocks")
    trees = gbdt.fit_blocks(blocks.rdd.map(_unpacked), edges, zeros["n"], ones["n"], trees=40, depth=4, min_hessian=1.0)
    threshold = calibrated(other, trees)
    release(rows, blocks)
    return Model(trees, threshold)


def find_pii(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of
    every row, repeated rows included; the counts are those of the base spans.

    ``spans`` holds base and added spans as kind:start:end; positions are code
    points, the end exclusive. Needs doc_id and text; other columns are ignored.
    A null or empty text has no spans. An empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model or fit_pii(docs))
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS],
                           T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
                           T.StructField("n_added", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests, spans, added_n = [[] for _ in KINDS], [], [], []
            for cell in b.column(1):
                text = cell.as_py() or ""
                found = base_spans(text)
                base = [(k, s, e) for k in KINDS for s, e in found[k]]
                added = held.value.select(text, base)
                for c, k in zip(counts, KINDS):
                    c.append(len(found[k]))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(base + added))
                added_n.append(len(added))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()),
                 pa.array(spans, pa.string()), pa.array(added_n, pa.int64())], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with every selected span of ``text`` replaced by ``<KIND>``
    (spans that overlap become one mark, of the earliest) and ``n_chars``, if
    there is one, counted anew. Null texts and all other columns stay."""
    held = docs.sparkSession.sparkContext.broadcast(model or fit_pii(docs))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for cell in b.column(at):
                text = cell.as_py()
                base = [(k, s, e) for k, spans in base_spans(text or "").items() for s, e in spans]
                out.append(redacted(text, base + held.value.select(text or "", base)))
            yield pa.RecordBatch.from_arrays([pa.array(out, b.schema.field(at).type) if i == at else c
                                              for i, c in enumerate(b.columns)], names=b.schema.names)

    marked = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        marked = marked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                                   .otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return marked


def redacted(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    if text is None or not spans:
        return text
    out, done = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= done:
            out += [text[done:s], f"<{kind.upper()}>"]
        done = max(done, e)
    return "".join(out) + text[done:]
