"""Token explanations: offsets, top tokens, URL-span overlap, highlighting
(W2-W4, J7) plus a lexical saliency score.

Tokens are whitespace-prefixed pieces (``\\s*\\S+``), so concatenating a
message's tokens rebuilds its text, as with byte-level BPE pieces. A message's
tokens stay in its row as an array: offsets are running sums over the array,
the top tokens a sort of it, URL tokens a filter, and only what is kept
becomes rows. Nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatsift.functions.text import UI_URL_PATTERN, WS
from threatsift.functions.urls import let
from threatsift.settings import EMAIL_CUE_WORDS, PY_WS_CHARS, TOP_IMPORTANCE_WORDS

TOKEN_PATTERN = f"{WS}*[^{WS[1:-1]}]+"
# Where a token ends and the next begins. Letters and most other characters are
# no whitespace by the first test of the class.
TOKEN_END = f"(?=[[^!-~]&&{WS}])(?<=[!-~[^{WS[1:-1]}]])"
BLOCK_BITS = 4
BLOCK = 1 << BLOCK_BITS  # entries per block of a running sum


def tokens(c) -> Column:
    """The text is cut at the ends of its tokens; whitespace after the last
    token belongs to none."""
    x = F.rtrim(F.coalesce(c, F.lit("")), F.lit(PY_WS_CHARS))
    return F.when(x != "", F.split(x, TOKEN_END, -1)).otherwise(F.array().cast("array<string>"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v)


def running_offsets(lengths: Column) -> Column:
    """Sum of all earlier entries, for every entry of an array of numbers: sums
    of whole blocks first (in the same way), then the few entries before it in
    its own block."""
    def few(ls):
        empty = F.struct(F.array().cast("array<bigint>").alias("at"), F.lit(0).cast("long").alias("sum"))
        return F.aggregate(ls, empty, lambda a, v: F.struct(F.concat(a["at"], F.array(a["sum"])).alias("at"),
                                                            (a["sum"] + v).alias("sum")))["at"]

    def before(ls, levels):
        if not levels:
            return few(ls)
        last = F.shiftright(F.greatest(F.size(ls) - 1, F.lit(0)), BLOCK_BITS)
        sums = F.transform(F.sequence(F.lit(0), last), lambda b: _total(F.slice(ls, b * BLOCK + 1, F.lit(BLOCK))))

        def one(starts, i):
            block = F.shiftright(i, BLOCK_BITS)
            return F.element_at(starts, block + 1) + _total(F.slice(ls, block * BLOCK + 1, i - block * BLOCK))
        return let(sums, lambda s: let(before(s, levels - 1), lambda starts: F.transform(ls, lambda _, i: one(starts, i))))

    return let(F.transform(lengths, lambda n: n.cast("long")), lambda ls: before(ls, 2))


def url_spans(text: Column, pattern: str = UI_URL_PATTERN) -> Column:
    """[start, end) of every URL match of a text, as an array: the text is split
    on the pattern and the ends are running sums of segment and match lengths."""
    def spans(pieces):
        def one(p, off):
            start = off + F.length(p["seg"])
            return F.struct(start.cast("long").alias("start"), (start + F.length(p["url"])).cast("long").alias("end"))
        lengths = F.transform(pieces, lambda p: F.length(p["seg"]) + F.length(p["url"]))
        return F.zip_with(pieces, running_offsets(lengths), one)

    x = F.coalesce(text, F.lit(""))
    urls = F.regexp_extract_all(x, F.lit(pattern), 0)
    segs = F.split(x, pattern, -1)
    pieces = let(urls, lambda u: F.arrays_zip(F.slice(segs, 1, F.size(u)).alias("seg"), u.alias("url")))
    return F.when(F.size(urls) > 0, let(pieces, spans)).otherwise(
        F.array().cast("array<struct<start:bigint,end:bigint>>"))


def url_span_rows(df: DataFrame, key: list[str], text_col: str, pattern: str = UI_URL_PATTERN) -> DataFrame:
    """One row per URL match with its character range."""
    return (df.select(*key, F.posexplode(url_spans(F.col(text_col), pattern)).alias("url_idx", "s"))
            .select(*key, "url_idx", F.col("s.start").alias("start"), F.col("s.end").alias("end")))


def is_url_token(token) -> Column:
    """J7 for whitespace-delimited tokens: a URL match never contains
    whitespace, so it lies inside one token, and a token overlaps a URL span
    exactly when the token itself contains a match (scanning resumes at
    every whitespace, so per-token and whole-text scans agree). Only tokens
    with a mark that every match holds are read by the pattern."""
    return (token.contains(".") | token.contains("://")) & token.rlike(UI_URL_PATTERN)


def overlapping(ts: Column, spans: Column) -> Column:
    """J7 general form, for tokenisers whose pieces may split a URL: of an array
    of pieces, those that overlap any of the spans, as (pos, token, char_offset).
    Blocks of pieces are tried first; only in the blocks that a span reaches
    are the pieces placed and tried one by one."""
    def near(start, length):
        return F.exists(spans, lambda s: (start < s["end"]) & (start + length > s["start"]))

    def in_block(t, b, start):
        inside = placed(F.slice(t, b * BLOCK + 1, F.lit(BLOCK)))
        at = F.transform(inside, lambda p: F.struct(
            (b * BLOCK + p["pos"]).cast("int").alias("pos"), p["token"].alias("token"), (start + p["char_offset"]).alias("char_offset")))
        return F.filter(at, lambda p: near(p["char_offset"], F.length(p["token"])))

    def of_blocks(t, lengths):
        def hits(starts):
            blocks = F.transform(F.arrays_zip(starts.alias("o"), lengths.alias("n")), lambda z, b: F.struct(
                b.alias("b"), z["o"].alias("o"), z["n"].alias("n")))
            reached = F.filter(blocks, lambda z: near(z["o"], z["n"]))
            return F.flatten(F.transform(reached, lambda z: in_block(t, z["b"], z["o"])))
        return let(running_offsets(lengths), hits)

    def lengths_of(t):
        blocks = F.sequence(F.lit(0), F.shiftright(F.greatest(F.size(t) - 1, F.lit(0)), BLOCK_BITS))
        return F.transform(blocks, lambda b: F.length(F.array_join(F.slice(t, b * BLOCK + 1, F.lit(BLOCK)), "")))

    none = F.array().cast("array<struct<pos:int,token:string,char_offset:bigint>>")
    return F.when(F.size(spans) > 0, let(ts, lambda t: let(lengths_of(t), lambda n: of_blocks(t, n)))).otherwise(none)


def placed(ts: Column) -> Column:
    """Array of (pos, token, char_offset) of an array of tokens."""
    def with_offsets(t):
        off = running_offsets(F.transform(t, lambda x: F.length(x)))
        return F.transform(F.arrays_zip(t.alias("t"), off.alias("o")), lambda z, i: F.struct(
            i.alias("pos"), z["t"].alias("token"), z["o"].alias("char_offset")))
    return let(ts, with_offsets)


def pieces(text: Column) -> Column:
    """Array of (pos, token, char_offset) of a text."""
    return placed(tokens(text))


def piece_rows(df: DataFrame, key: list[str], text_col: str) -> DataFrame:
    """One row per token with its position and running offset."""
    return df.select(*key, F.inline(pieces(F.col(text_col))))


_WORD = r"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"
_MARK = rf"[^{_WORD}\p{{L}}\p{{N}}{WS[1:-1]}]"
# Runs of other characters beside a word; plain letters and blanks fail the first test.
_MARKS = rf"(?=[^{_WORD} ])(?:(?<=[{_WORD}\p{{L}}\p{{N}}]){_MARK}++|{_MARK}++(?=[{_WORD}\p{{L}}\p{{N}}]))"


def bare_words(text: Column) -> Column:
    """For every token of a text, in order, its letters, digits and underscores
    in lower case. A token without any keeps its marks, so all keep their places."""
    x = F.trim(F.coalesce(text, F.lit("")), F.lit(PY_WS_CHARS))
    bare = F.lower(F.regexp_replace(x, _MARKS, ""))
    return F.when(x != "", F.split(bare, f"(?=[^!-~]){WS}+", -1)).otherwise(F.array().cast("array<string>"))


def lexical_importance(word: Column, length: Column, target: Column) -> Column:
    """Saliency of a token (its bare word and its length) toward the target
    class name: +1 for a cue word of that class, -0.5 for a cue of another
    class, else 1/(len+1)."""
    e = None
    for cls, words in EMAIL_CUE_WORDS.items():
        hit = word.isin(*words)
        val = F.when(target == F.lit(cls), F.lit(1.0)).otherwise(F.lit(-0.5))
        e = F.when(hit, val) if e is None else e.when(hit, val)
    cue = word.isin(*{w for words in EMAIL_CUE_WORDS.values() for w in words})  # one look-up for most tokens
    return F.when(cue, e).otherwise(F.lit(1.0) / (length + 1).cast("double"))


def target_class(label: Column) -> Column:
    """Explanation target from the verdict: phishing, spam, else legitimate."""
    return (F.when(label == "Phishing", F.lit("phishing")).when(label == "Spam", F.lit("spam"))
            .otherwise(F.lit("legitimate")))


def scored(text: Column, target: Column) -> Column:
    """Array of (pos, token, importance) of a text's tokens."""
    return F.transform(F.arrays_zip(tokens(text).alias("t"), bare_words(text).alias("w")), lambda z, i: F.struct(
        i.alias("pos"), z["t"].alias("token"), lexical_importance(z["w"], F.length(z["t"]), target).alias("importance")))


def top_positions(ranked: Column, n: int = TOP_IMPORTANCE_WORDS) -> Column:
    """The positions of the n tokens of highest |importance|, stable by
    position. Only tokens that reach the n-th value are sorted with their
    positions."""
    neg = lambda t: -F.abs(t["importance"])
    nth = F.try_element_at(F.sort_array(F.transform(ranked, neg)), F.lit(n))
    best = let(nth, lambda v: F.filter(ranked, lambda t: v.isNull() | (neg(t) <= v)))
    pairs = F.transform(best, lambda t: F.struct(neg(t).alias("neg"), t["pos"].alias("pos")))
    return F.transform(F.slice(F.sort_array(pairs), 1, n), lambda t: t["pos"])


def top_rows(df: DataFrame, key: list[str], text_col: str, label_col: str, n: int = TOP_IMPORTANCE_WORDS) -> DataFrame:
    """W2 as rows: key, imp_rank (from 1), pos, token, importance."""
    top = let(scored(F.col(text_col), target_class(F.col(label_col))), lambda ranked: F.transform(
        top_positions(ranked, n), lambda p: F.element_at(ranked, p + 1)))
    return (df.select(*key, F.posexplode(top).alias("_i", "_t"))
            .select(*key, "_t.pos", "_t.token", "_t.importance", (F.col("_i") + 1).alias("imp_rank")))


def highlight(df: DataFrame, key: list[str], text_col: str, label_col: str, is_phishing_col: str = "is_phishing",
              n: int = TOP_IMPORTANCE_WORDS) -> DataFrame:
    """The tokens to highlight (top n or inside a URL); colour follows the
    verdict."""
    def kept(ranked):
        def flagged(at):
            shown = lambda t: F.array_contains(at, t["pos"])
            hits = F.filter(ranked, lambda t: shown(t) | is_url_token(t["token"]))
            return F.transform(hits, lambda t: F.struct(
                t["pos"].alias("pos"), t["token"].alias("token"), t["importance"].alias("importance"),
                shown(t).alias("is_top"), is_url_token(t["token"]).alias("is_url")))
        return let(top_positions(ranked, n), flagged)

    rows = let(scored(F.col(text_col), target_class(F.col(label_col))), kept)
    color = F.when(F.col(is_phishing_col), F.lit("red")).otherwise(F.lit("green"))
    return df.select(*key, color.alias("color"), F.inline(rows))
