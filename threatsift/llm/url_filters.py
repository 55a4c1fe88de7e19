"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is a regular expression over ``host + path`` together with the
literal tokens a matching URL must contain. The index keeps a rule under the
token that is rarest in the corpus; the tokens of a URL fetch the candidate
rules, and only those run their expressions. The longest matching rule of the
list wins; where none fits, the pattern rules of the method decide.

Everything is one projection of built-in functions over the page table: no
shuffle, no join, no Python. The index is a literal (its size is that of the
rule list, a parameter, never of the data), split into hash buckets so that
the lookup of a token does not scan the whole rule list. The only pass besides
is the count of rule tokens over all URLs, which returns one row per token of
the rule list.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN_RX = "[^a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """One pattern rule. ``pattern`` is searched in host + path; ``tokens`` are
    literal tokens present in every string it matches (at least one);
    ``listed`` rules carry a verdict of the given list and outrank the
    others, which only inform the method's own verdict."""

    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    listed: bool = True

    @property
    def weight(self) -> int:
        return len(self.name)


def host_path_rule(verdict: str, text: str) -> Rule:
    """Rule ``host/path``: the host and all its subdomains, paths that start
    with the rule's. The last path token counts as a literal token only when
    the rule ends it (with a non-token character)."""
    host, _, rest = text.partition("/")
    path = "/" + rest
    tokens = [t for t in re.split(TOKEN_RX, host.lower()) if t]
    parts = re.split("[^A-Za-z0-9]+", path)
    tokens += [t.lower() for t in parts[:-1] if t]
    return Rule(text, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(dict.fromkeys(tokens)), verdict)


def host_word_rule(words: str) -> Rule:
    """Method rule: a whole (hyphenated) label of the host equals ``words``."""
    return Rule(words, rf"^(?:[^/]*\.)?{re.escape(words)}(?:\.[^/]*)?(?:/|$)",
                tuple(t for t in re.split(TOKEN_RX, words) if t), "block", listed=False)


# The list of rules of the query, and host labels of unwanted sites.
LISTED_RULES = (
    host_path_rule("block", "net/"),
    host_path_rule("allow", "example.net/en/"),
    host_path_rule("block", "example.com/de/"),
    host_path_rule("allow", "org/fr/"),
)
METHOD_RULES = tuple(host_word_rule(w) for w in (
    "casino-win", "free-bets", "cheap-pills", "ads-track", "spam-farm", "adult-x"))


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.split(F.translate(F.concat(host, path), UPPER, LOWER), TOKEN_RX))


def token_counts(parsed: DataFrame, rules: tuple[Rule, ...]) -> dict[str, int]:
    """URLs holding each token of the rule list, counted over all rows. At most
    one row per token of the rule list reaches the driver."""
    wanted = sorted({t for r in rules for t in r.tokens})
    literal = F.array(*[F.lit(t) for t in wanted])
    rows = (parsed.select(F.explode(F.array_intersect("_tokens", literal)).alias("token"))
            .groupBy("token").count().collect())
    return {t: 0 for t in wanted} | {r["token"]: r["count"] for r in rows}


def rule_index(rules: tuple[Rule, ...], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """Rules by their rarest literal token (ties: the smaller token)."""
    index: dict[str, list[Rule]] = {}
    for rule in rules:
        if not rule.tokens:
            raise ValueError(f"rule {rule.name!r} has no literal token")
        key = min(rule.tokens, key=lambda t: (counts.get(t, 0), t))
        index.setdefault(key, []).append(rule)
    return index


def _rule_literal(rule: Rule) -> Column:
    return F.struct(F.lit(rule.listed).alias("listed"), F.lit(rule.weight).alias("weight"),
                    F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"),
                    F.lit(rule.pattern).alias("pattern"))


_RULES_TYPE = "array<struct<listed:boolean,weight:int,name:string,verdict:string,pattern:string>>"


def candidates(tokens: Column, index: dict[str, list[Rule]]) -> Column:
    """Candidate rules of a URL: the index entries of its tokens. The literal
    index is an array of small maps, one per hash bucket of the token."""
    n = max(1, len(index) // 4)
    empty = F.array().cast(_RULES_TYPE)
    # Bucket by length and first characters: the same rule on both sides.
    def bucket_of(token: str) -> int:
        return (len(token) * 31 + sum(ord(c) for c in token[:2])) % n
    buckets: list[dict] = [{} for _ in range(n)]
    for token, rules in index.items():
        buckets[bucket_of(token)][token] = rules
    literal = F.array(*[
        F.create_map(*[x for t, rules in sorted(b.items())
                       for x in (F.lit(t), F.array(*[_rule_literal(r) for r in rules]))]
                     or [F.lit(""), empty])
        for b in buckets])
    def lookup(t: Column) -> Column:
        b = (F.length(t) * 31 + F.ascii(t) + F.ascii(F.substring(t, 2, 1))) % n
        return F.coalesce(F.try_element_at(F.element_at(literal, b + 1), t), empty)
    return F.flatten(F.transform(F.filter(tokens, lambda t: t != ""), lookup))


def judge_urls(pages: DataFrame, url_col: str = "url", listed: tuple[Rule, ...] = LISTED_RULES,
               method: tuple[Rule, ...] = METHOD_RULES) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``pages``.

    Columns of those names that ``pages`` already has are replaced. The winner
    is the longest listed rule that fits (ties: the smaller name). Without one,
    ``rule`` is null and the verdict is ``block`` if a method rule fits, else
    ``allow``. A null URL or one without ``://`` has an empty host and path,
    fits no rule and is allowed. Rows are judged one by one: repeated rows come
    back as often, and an empty table gives an empty result.
    """
    rules = tuple(listed) + tuple(method)
    parsed = (pages.withColumn("host", url_host(F.col(url_col))).withColumn("path", url_path(F.col(url_col))))
    tokens = url_tokens(F.col("host"), F.col("path"))
    counts = token_counts(parsed.select(tokens.alias("_tokens")), rules)
    target = F.concat(F.col("host"), F.col("path"))
    found = F.filter(candidates(tokens, rule_index(rules, counts)), lambda r: F.regexp_like(target, r["pattern"]))
    best = F.aggregate(
        found, F.lit(None).cast("struct<listed:boolean,weight:int,name:string,verdict:string,pattern:string>"),
        lambda a, r: F.when(a.isNull() | (r["listed"] & ~a["listed"])
                            | ((r["listed"] == a["listed"])
                               & ((r["weight"] > a["weight"])
                                  | ((r["weight"] == a["weight"]) & (r["name"] < a["name"])))), r).otherwise(a))
    return (parsed.withColumn("_best", best)
            .withColumn("rule", F.when(F.col("_best.listed"), F.col("_best.name")))
            .withColumn("verdict", F.coalesce(F.col("_best.verdict"), F.lit("allow")))
            .drop("_best"))


ORACLE = """
WITH p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
j AS (
  SELECT *,
    CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN len(list_intersect(string_split(host, '.'), ['casino-win', 'free-bets', 'cheap-pills', 'ads-track', 'spam-farm', 'adult-x'])) > 0 THEN 'block'
       ELSE 'allow' END AS verdict
FROM j
"""
