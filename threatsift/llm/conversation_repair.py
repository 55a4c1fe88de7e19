"""Conversation structure repair: the cheapest edits, ties by their initials.

A repaired conversation reads ``(system? (user assistant)+)?``. Rows are kept,
get another role or are deleted, roles with empty text may be inserted; blank
and duplicate rows must go.

* Spark orders the rows of each conversation, marks faults (the first row of
  equal role and text by an aggregation on digests) and packs one code per row
  into segments of ``SEGMENT`` rows.
* Per segment, in parallel: the least cost between every entry and exit state.
  A pass over a conversation's segments, last first, turns these into the cost
  after each segment, holding four numbers.
* Per segment, in parallel: optimal arcs and their prefix-doubled path ranks
  (``path_ranks``), which give the audit of every entry state.
* A pass in order of rows follows the states and edits the texts as they stream
  by. It, and the ordering before it, are the only steps that see a whole
  conversation in one task (a digest of its text can be taken in no other way);
  they hold one Arrow batch, and Spark's sorts spill.

Tables that several steps read are written to the shared folder first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatsift.llm import path_ranks as P
from threatsift.llm.common import staged

SEGMENT = 4_096
CELLS = 1 << 18               # positions handled by one vectorised step
BLANK = r"\x20\x09-\x0D"
DAMAGES = 20


def conversation_key(conv_id: Column) -> Column:
    return F.coalesce(conv_id.cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) after the damage that the crc32 of
    ``conv_id:turn`` picks: 0 drops a row, 1 empties its text, 2 removes its
    sentence ends, 3 repeats it, 4 makes it the user's. Null ids and turns count
    as one space there, null roles and texts become one space."""
    h = F.crc32(F.concat(conversation_key(F.col("conv_id")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % DAMAGES
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), h.alias("_h")).where("_h <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("_h") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_h") == 1, "").when(F.col("_h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("_h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def ordered_rows(rows: DataFrame) -> DataFrame:
    """(key, pos, turn, role, text, initial, illegal, blank, truncated, digest):
    rows in order of turn (nulls first, then role and text), with what each row
    shows by itself and its place behind the row before."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    facts = rows.select(
        conversation_key(F.col("conv_id")).alias("key"), "turn", role.alias("role"), text.alias("text"),
        F.substring(role, 1, 1).alias("initial"), (~text.rlike(f"[^{BLANK}]")).alias("blank"),
        (~text.rlike(rf"[.!?][{BLANK}]*\z")).alias("truncated"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"))
    order = Window.partitionBy("key").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = F.lag("initial").over(order)
    legal = F.concat(before, F.col("initial")).isin("su", "ua", "au")
    return facts.select("*", F.row_number().over(order).cast("long").alias("pos"),
                        F.coalesce(~legal, F.lit(False)).alias("illegal"))


def row_codes(ordered: DataFrame) -> DataFrame:
    """(key, pos, turn, illegal, fault, code): the first fault of each row, and
    its code for the cost DP. A row is a duplicate unless it is the first of its
    conversation with that role and text."""
    firsts = (ordered.groupBy("key", "digest").agg(F.min("pos").alias("pos"))
              .select("key", "pos", F.lit(True).alias("_first")))
    fault = (F.when(F.col("blank"), "blank").when(F.col("_first").isNull(), "duplicate").when(F.col("truncated"), "truncated"))
    initial = F.coalesce(*[F.when(F.col("initial") == c, n) for c, n in P.INITIALS.items()], F.lit(3))
    code = (initial + F.when(F.col("fault").isin("blank", "duplicate"), P.MUST_GO)
            .when(F.col("fault") == "truncated", P.TRUNCATED).otherwise(0))
    return (ordered.drop("role", "text").join(firsts, ["key", "pos"], "left").withColumn("fault", fault)
            .select("key", "pos", "turn", "illegal", "fault", code.cast("int").alias("code")))


def conversation_counts(codes: DataFrame) -> DataFrame:
    """(key, rows, gaps, blank, duplicate, truncated, illegal) of the rows."""
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long")
    return codes.groupBy("key").agg(
        F.count("*").alias("rows"), gaps.alias("gaps"), *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        F.count_if("illegal").alias("illegal"))


def _stretches(codes: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Row numbers in groups of similar length and bounded size together."""
    size = np.array([len(c) for c in codes])
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end - at + 1) * (size[order[end]] + 1) <= CELLS:
            end += 1
        yield order[at:end]
        at = end


def _lists(column: pa.Array) -> list[np.ndarray]:
    return [np.asarray(x.values.to_numpy(zero_copy_only=False), dtype=np.int64) for x in column]


def _with_matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        codes, last = _lists(b.column("codes")), b.column("last").to_numpy(zero_copy_only=False).astype(bool)
        out = np.empty((b.num_rows, P.STATES * P.STATES), dtype=np.int64)
        for at in _stretches(codes):
            out[at] = P.matrices(P.padded([codes[i] for i in at])[0], last[at]).reshape(len(at), -1)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(out), pa.list_(pa.int64()))], names=[*b.schema.names, "through"])


def _with_exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of a conversation, last first: the cost behind each of them, and
    that of the whole conversation at its first segment."""
    behind = P.end_costs()
    for b in batches:
        exits, cost = [], []
        for last, seg, through in zip(b.column("last").to_pylist(), b.column("seg").to_pylist(), _lists(b.column("through"))):
            if last:
                behind = P.end_costs()
            exits.append(behind)
            behind = np.minimum((through.reshape(P.STATES, P.STATES) + behind).min(1), P.FAR)
            cost.append(int(behind[0]) if seg == 0 else None)
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c) for c in ("key", "seg", "last", "codes")), pa.array(exits, pa.list_(pa.int64())), pa.array(cost, pa.int64())],
            names=["key", "seg", "last", "codes", "exits", "cost"])


def _with_audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        codes, last = _lists(b.column("codes")), b.column("last").to_numpy(zero_copy_only=False).astype(bool)
        exits = np.array(_lists(b.column("exits")))
        audits, states = [None] * b.num_rows, [None] * b.num_rows
        for at in _stretches(codes):
            rows, size = P.padded([codes[i] for i in at])
            found, state = P.ranked_paths(rows, size, exits[at], last[at])
            for i, a, s in zip(at.tolist(), found, state.tolist()):
                audits[i], states[i] = a, s
        yield pa.RecordBatch.from_arrays(
            [b.column("key"), b.column("seg"), b.column("cost"), pa.array(audits, pa.list_(pa.string())),
             pa.array(states, pa.list_(pa.int32()))], names=["key", "seg", "cost", "audits", "states"])


def segment_audits(codes: DataFrame, counts: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(key, seg, cost, audits, states) of every segment: the audit and the exit
    state for each of the four entry states; cost on the first segment only."""
    seg = F.floor((F.col("pos") - 1) / segment).cast("long")
    packed = (codes.groupBy("key", seg.alias("seg")).agg(F.sort_array(F.collect_list(F.struct("pos", "code"))).alias("_c"))
              .join(counts.select("key", "rows"), "key")
              .select("key", "seg", (F.col("seg") == F.floor((F.col("rows") - 1) / segment)).alias("last"), F.col("_c.code").alias("codes")))
    layout = "key string, seg long, last boolean, codes array<int>"
    through = packed.mapInArrow(_with_matrices, layout + ", through array<long>")
    exits = (through.repartition("key").sortWithinPartitions("key", F.col("seg").desc())
             .mapInArrow(_with_exits, layout + ", exits array<long>, cost long"))
    return exits.repartition("key", "seg").mapInArrow(_with_audits, "key string, seg long, cost long, audits array<string>, states array<int>")


ROLES = {2: "user", 3: "assistant"}


class _Editor:
    """Edits the rows of one conversation as they come, segment by segment."""

    def __init__(self, key: str):
        self.key, self.state, self.cost = key, 0, 0
        self.audit, self.at, self.parts = "", 0, []

    def open(self, audits: list[str], cost: int | None) -> Iterator[tuple[str, str]]:
        yield from self.close()
        self.audit, self.at = audits[self.state], 0
        self.parts.append(self.audit)
        self.cost = self.cost if cost is None else cost

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.close()                       # insertions before the row
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self.state = int(P.KEPT[self.state, P.INITIALS[role[0]]])
            yield role, text
        elif edit == "R":
            self.state = int(P.NEXT[self.state])
            yield ROLES[self.state], text

    def close(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            self.state = int(P.NEXT[self.state])
            yield ROLES[self.state], ""


class _Rows:
    """Sink that keeps the repaired rows: (key, at, role, text)."""

    schema = "key string, at long, role string, text string"

    def __init__(self, editor: _Editor):
        self.key, self.n, self.rows = editor.key, 0, []

    def add(self, role: str, text: str) -> None:
        self.rows.append((self.key, self.n, role, text))
        self.n += 1

    def taken(self, done: _Editor | None) -> list[tuple]:
        out, self.rows = self.rows, []
        return out


class _Digest:
    """Sink that keeps a digest: one row (key, cost, audit, repaired_sha256)."""

    schema = "key string, cost long, audit string, repaired_sha256 string"

    def __init__(self, editor: _Editor):
        self.hash, self.empty = hashlib.sha256(), True

    def add(self, role: str, text: str) -> None:
        self.hash.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
        self.empty = False

    def taken(self, done: _Editor | None) -> list[tuple]:
        return [(done.key, done.cost, "".join(done.parts), self.hash.hexdigest())] if done else []


def _edited(make: type, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Streams rows in order (a segment's audits come before its rows) through
    the edits into a sink."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        editor, sink = None, None

        def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        def finish() -> list[tuple]:
            if editor is None:
                return []
            for role, text in editor.close():
                sink.add(role, text)
            return sink.taken(editor)

        for b in batches:
            held: list[tuple] = []
            for key, role, text, audits, cost in zip(*(b.column(c) for c in ("key", "role", "text", "audits", "cost"))):
                if editor is None or key.as_py() != editor.key:
                    held += finish()
                    editor = _Editor(key.as_py())
                    sink = make(editor)
                edits = editor.open(audits.as_py(), cost.as_py()) if audits.is_valid else editor.row(role.as_py(), text.as_py())
                for r, t in edits:
                    sink.add(r, t)
            if editor is not None:
                held += sink.taken(None)
            yield from out(held)
        yield from out(finish())

    return run


def _apply(ordered: DataFrame, audits: DataFrame, make: type, segment: int) -> DataFrame:
    headers = audits.select("key", "seg", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("role"),
                            F.lit(None).cast("string").alias("text"), "audits", "cost")
    rows = ordered.select("key", F.floor((F.col("pos") - 1) / segment).cast("long").alias("seg"), "pos", "role", "text",
                          F.lit(None).cast("array<string>").alias("audits"), F.lit(None).cast("long").alias("cost"))
    fields = {"string": pa.string(), "long": pa.int64()}
    schema = pa.schema([pa.field(n, fields[t]) for n, t in (f.split() for f in make.schema.split(", "))])
    return (headers.unionByName(rows).repartition("key").sortWithinPartitions("key", "seg", "pos")
            .mapInArrow(_edited(make, schema), make.schema))


def _prepared(rows: DataFrame, segment: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    ordered = staged(ordered_rows(rows), "conversation-rows")
    codes = staged(row_codes(ordered), "conversation-codes")
    counts = staged(conversation_counts(codes), "conversation-counts")
    return ordered, counts, staged(segment_audits(codes, counts, segment), "conversation-audits")


def repair(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(key, at, role, text): the repaired conversations of ``rows`` (conv_id,
    turn, role, text); ``key`` is the id's text (a null id: one space), ``at``
    counts from 0. A conversation whose rows all go has none."""
    ordered, _, audits = _prepared(rows, segment)
    return _apply(ordered, audits, _Rows, segment)


def audit_conversations(originals: DataFrame, rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256) of every conv_id of ``originals``, judged by ``rows``.

    Rows of equal turn are taken by role, then text. Null roles and texts are one
    space, a null conv_id is a conversation of its own, null turns come first. A
    role's initial is its first character; one that is none of s, u, a (or an
    empty role) fits nowhere, so such a row gets a role or goes. Texts may be of
    any length. A conversation without rows has zeros, an empty audit and the
    digest of the empty string; an empty table gives an empty result. Other
    columns are ignored.
    """
    ids = originals.select(conversation_key(F.col("conv_id")).alias("key"), "conv_id").groupBy("key").agg(F.max("conv_id").alias("conv_id"))
    ordered, counts, audits = _prepared(rows, segment)
    digests = _apply(ordered, audits, _Digest, segment)
    zero = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return (ids.join(counts, "key", "left").join(digests, "key", "left")
            .select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in zero],
                    F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256")))
