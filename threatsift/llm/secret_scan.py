"""Secret scans by a trigram inverted index, in built-in functions only.

* Every rule is a regular expression. A Boolean query over trigrams is derived
  from it: which trigrams each matching text must hold.
* Index: postings (trigram, block, keys) of all rules' trigrams over the lowered
  texts, keys in blocks of rows so that no posting list grows with the table.
  A row's key is a hash of its id and text; equal rows share one.
* Queries: per block, postings are intersected and united as the query says.
  The keys that remain are candidates of the rule; they go into bitmaps of a
  fixed total size, which can always be broadcast, so texts never move.
* Verification: the expression of a rule runs on its candidates only (a bit hit
  by another key costs one needless run, never a result). Rules without a
  mandatory trigram (long hexadecimal runs) run on every text.

Texts are read twice, once for the index and once for the verification.
Positions are prefix sums over the lengths of matches and of the text between
them, code points, end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatsift.functions.text import let
from threatsift.llm.common import staged
from threatsift.llm.trigram_query import clauses, trigram_query

KINDS = ("assign", "access", "hex")
BLOCK_ROWS = 16_384          # rows whose keys one posting list may hold
BITMAPS = 1_024              # of 4 KB each: what is broadcast, at any table size
BITMAP_BITS = 32_768
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class SecretRule:
    """``pattern`` in the syntax Java and Python share. With ``value`` (a pattern
    with one group, matched against the match) the group must have ``least``
    characters, else the match is dropped without another try."""

    kind: str
    name: str
    pattern: str
    base: bool = False
    value: str | None = None
    least: int = 0

    @property
    def query(self) -> list[tuple[str, ...]] | None:
        """Alternatives of mandatory trigrams; None: the rule scans every text."""
        return clauses(trigram_query(self.pattern))


# The base patterns of the query. Minimum lengths that cannot change
# which characters a match takes are part of the pattern.
_KEY = r"(?i:password|passwd|secret|token|api_?key)"
_LEAD = _KEY + r"[\"']?\x20*[:=]\x20*[\"']?"
BASE_RULES = (
    SecretRule("assign", "assignment", _LEAD + r"[A-Za-z0-9+/_.=-]+", True, _LEAD + r"([A-Za-z0-9+/_.=-]+)", 6),
    SecretRule("access", "access key", r"AKIA[A-Z0-9]{16,}", True),
    SecretRule("hex", "lower-case hexadecimal", r"[0-9a-f]{24,}", True),
)
# Forms of common credentials that the base patterns do not take whole.
ADDED_RULES = (
    SecretRule("access", "repository token", r"gh[pousr]_[A-Za-z0-9]{30,}"),
    SecretRule("access", "chat token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("access", "payment key", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    SecretRule("access", "map key", r"AIza[A-Za-z0-9_-]{35,}"),
    SecretRule("access", "signed token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    SecretRule("access", "private key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    SecretRule("assign", "bearer", r"(?i:authorization)\x20*[:=]\x20*[\"']?(?i:bearer|basic)\x20+[A-Za-z0-9._~+/=-]{8,}"),
    SecretRule("assign", "address with password", r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[A-Za-z0-9._%+-]{1,64}:[^\s:@/]{6,128}@"),
    SecretRule("hex", "upper-case hexadecimal", r"[0-9A-F]{32,}"),
)
RULES = BASE_RULES + ADDED_RULES


def trigrams_of(queries: dict[int, list[tuple[str, ...]]]) -> list[str]:
    return sorted({t for alternatives in queries.values() for c in alternatives for t in c})


def row_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(F.lit(31), doc_id, text)


def build_index(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """(trigram, block, keys): which keys' texts hold each of the ``wanted``
    trigrams, of rows (key, text). A list holds the keys of one block only."""
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    low = F.translate("text", UPPER, LOWER)
    held = F.array_compact(F.array(*[F.when(F.col("_low").contains(t), F.lit(t)) for t in wanted]))
    return (rows.select("key", low.alias("_low")).select("key", F.explode(held).alias("trigram"))
            .withColumn("block", F.pmod(F.xxhash64(F.lit(5), "key"), F.lit(blocks)))
            .groupBy("trigram", "block").agg(F.collect_set("key").alias("keys")))


def rule_candidates(index: DataFrame, queries: dict[int, list[tuple[str, ...]]]) -> DataFrame:
    """(rule, key): rows that satisfy the query of a rule. Within each block the
    postings of an alternative's trigrams are intersected; alternatives are
    united (a key may come from several)."""
    per_block = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("_p"))
    literal = F.array(*[F.struct(F.lit(r).alias("rule"), F.array(*map(F.lit, c)).alias("need"))
                        for r, alternatives in queries.items() for c in alternatives])

    def postings(trigram: Column) -> Column:
        return F.coalesce(F.try_element_at(F.col("_p"), trigram), F.array().cast("array<bigint>"))

    def met(c: Column) -> Column:
        return F.struct(c["rule"].alias("rule"), F.aggregate(
            c["need"], postings(F.element_at(c["need"], 1)), lambda keys, t: F.array_intersect(keys, postings(t))).alias("keys"))

    return (per_block.select(F.explode(F.transform(literal, met)).alias("_e"))
            .select("_e.rule", F.explode("_e.keys").alias("key")).distinct())


def _bit(rule: Column, key: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(17), rule, key), F.lit(BITMAP_BITS))


def _bitmap_no(key: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(19), key), F.lit(BITMAPS)).cast("int")


def candidate_bitmaps(found: DataFrame) -> DataFrame:
    """(bitmap, bits): at most ``BITMAPS`` rows of 4 KB, whatever the table."""
    return (found.select(_bitmap_no(F.col("key")).alias("bitmap"), _bit(F.col("rule"), F.col("key")).alias("_at"))
            .groupBy("bitmap").agg(F.bitmap_construct_agg("_at").alias("bits")))


def _has_bit(bits: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v)


def _prefix_sums(lengths: Column) -> Column:
    """Sums of all elements before each one, in stretches of about the square
    root of the size, so no accumulator array is copied per element."""
    def summed(parts: Column) -> Column:
        return let(F.transform(parts, _total), lambda sums: F.flatten(F.transform(
            parts, lambda p, c: let(_total(F.slice(sums, F.lit(1), c)), lambda before: F.transform(
                p, lambda v, i: before + _total(F.slice(p, F.lit(1), i)))))))

    return let(F.greatest(F.ceil(F.sqrt(F.size(lengths))), F.lit(1)).cast("int"), lambda step: let(
        F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / step).cast("int")),
                    lambda c: F.slice(lengths, c * step + 1, step)), summed))


_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def _spans(text: Column, rule: SecretRule) -> Column:
    """Leftmost non-overlapping matches of a rule that pass its check."""
    def placed(matches: Column, gaps: Column, before: Column) -> Column:
        spans = F.transform(matches, lambda m, i: let(F.element_at(before, i + 1) + F.element_at(gaps, i + 1), lambda start: F.struct(
            start.alias("start"), F.lit(KINDS.index(rule.kind)).alias("kind"), (start + F.length(m)).alias("end"), m.alias("m"))))
        if rule.value:
            spans = F.filter(spans, lambda s: F.length(F.regexp_extract(s["m"], rule.value, 1)) >= rule.least)
        return F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"]))

    def located(matches: Column) -> Column:
        gaps = F.transform(F.split(text, rule.pattern, -1), lambda g: F.length(g).cast("long"))
        return let(gaps, lambda gaps: let(
            _prefix_sums(F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: g + F.length(m))),
            lambda before: placed(matches, gaps, before)))

    return let(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)),
                lambda matches: F.when(F.size(matches) > 0, located(matches)).otherwise(F.array().cast(_SPANS)))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added) of every
    row; the counts and the digest are those of the base rules.

    ``spans`` holds base and added spans as kind:start:end by start, then kind;
    added spans may overlap base ones, equal ones are listed once. Needs doc_id
    and text, other columns are ignored. A null or empty text has no spans; a
    null doc_id is a row like others, repeated rows come back as often, and an
    empty table gives an empty result. A text may be of any length.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "key", row_key(F.col("doc_id"), F.col("text")))
    queries = {i: q for i, q in ((i, r.query) for i, r in enumerate(rules)) if q is not None}
    wanted = trigrams_of(queries)
    if wanted:
        index = staged(build_index(rows.select("key", "text"), wanted), "secret-index")
        bitmaps = staged(candidate_bitmaps(rule_candidates(index, queries)), "secret-candidates")
        rows = rows.withColumn("_b", _bitmap_no(F.col("key"))).join(
            F.broadcast(bitmaps.select(F.col("bitmap").alias("_b"), F.col("bits").alias("_bits"))), "_b", "left")
    none = F.array().cast(_SPANS)
    columns = []
    for i, rule in enumerate(rules):
        spans = _spans(F.col("text"), rule)
        if i in queries:
            hit = F.col("_bits").isNotNull() & _has_bit(F.col("_bits"), _bit(F.lit(i), F.col("key")))
            spans = F.when(hit, spans).otherwise(none)
        columns.append(spans.alias(f"_r{i}"))
    found = rows.select("doc_id", *columns)
    of = [F.col(f"_r{i}") for i in range(len(rules))]
    base = [c for c, r in zip(of, rules) if r.base]
    found = found.select(
        "doc_id",
        *[F.concat(none, *[c for c, r in zip(of, rules) if r.base and r.kind == k]).alias(f"_{k}") for k in KINDS],
        F.array_sort(F.concat(none, *base)).alias("_base"), F.array_sort(F.array_distinct(F.concat(none, *of))).alias("_all"))
    return found.select(
        "doc_id", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_written(F.col("_base")), 256).alias("base_sha256"), _written(F.col("_all")).alias("spans"),
        (F.size("_all") - F.size("_base")).cast("long").alias("n_added"))


# DuckDB SQL of the query, patterns spelled out: (kind, least length of the last
# stretch of value characters, pattern). The first three are the base.
_SQL_RULES = (
    (0, 6, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""),
    (1, 0, r"AKIA[A-Z0-9]{16,}"),
    (2, 0, r"[0-9a-f]{24,}"),
    (1, 0, r"gh[pousr]_[A-Za-z0-9]{30,}"),
    (1, 0, r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    (1, 0, r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    (1, 0, r"AIza[A-Za-z0-9_-]{35,}"),
    (1, 0, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    (1, 0, r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    (0, 0, r"""(?i:authorization)\x20*[:=]\x20*["']?(?i:bearer|basic)\x20+[A-Za-z0-9._~+/=-]{8,}"""),
    (0, 0, r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[A-Za-z0-9._%+-]{1,64}:[^\s:@/]{6,128}@"),
    (2, 0, r"[0-9A-F]{32,}"),
)


def _sql_rule(kind: int, least: int, pattern: str) -> str:
    rx = pattern.replace("'", "''")
    m, g = f"regexp_extract_all(t, '{rx}')", f"string_split_regex(t, '{rx}')"
    lead = r"""^(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    spans = (f"list_transform(range(1, len({m}) + 1), lambda i: {{'s': "
             f"coalesce(list_sum(list_transform({m}[1:i - 1], lambda x: length(x))), 0)::BIGINT + "
             f"list_sum(list_transform({g}[1:i], lambda x: length(x)))::BIGINT, 'k': {kind}, 'm': {m}[i]}})")
    if least:
        spans = f"list_filter({spans}, lambda x: length(regexp_extract(x.m, '{lead}', 1)) >= {least})"
    return f"list_transform({spans}, lambda x: {{'s': x.s, 'k': x.k, 'e': x.s + length(x.m)}})"


_WRITE = "list_transform({}, lambda x: ['assign', 'access', 'hex'][x.k + 1] || ':' || x.s || ':' || x.e)"
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
r AS (SELECT doc_id, {", ".join(f"{_sql_rule(*r)} AS r{i}" for i, r in enumerate(_SQL_RULES))} FROM d),
a AS (SELECT doc_id, r0, r1, r2, list_sort(r0 || r1 || r2) AS base,
             list_sort(list_distinct({" || ".join(f"r{i}" for i in range(len(_SQL_RULES)))})) AS every FROM r)
SELECT doc_id, len(r0)::BIGINT AS n_assign, len(r1)::BIGINT AS n_access, len(r2)::BIGINT AS n_hex,
       sha256(array_to_string({_WRITE.format("base")}, ',')) AS base_sha256,
       array_to_string({_WRITE.format("every")}, ',') AS spans, (len(every) - len(base))::BIGINT AS n_added
FROM a
"""
