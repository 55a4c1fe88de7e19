"""Tokens, bare words, offsets and overlaps against plain Python; work of occlusion."""

import re

from pyspark.sql import functions as F

from threatsift.functions.urls import let
from threatsift.operators import explain as XP
from threatsift.operators import occlusion as OC
from threatsift.operators.scoring import EMAIL_CLASSES, LexicalScorer
from threatsift.settings import EMAIL_CUE_WORDS

WS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
TOKEN = re.compile(f"[{WS}]*[^{WS}]+")
TEXTS = ["", None, "  ", "one", " lead and trail \n", "-- 'verify' -- v.e-rify! #free# 　日本 \U0001d49c\U0001d49cfree \U0001f600 free\U0001f600",
         "a\x1cb\x85c d", "FREE! (Winner) prİze Keep $$$ the,the _bank_", "see http://a.de/x, www.b.net) or https://c.d\"e www. x",
         " ".join(f"w{i}" for i in range(700)) + " http://end.de/x?y=1", "\U0001f600" * 3 + " x " * 40 + "www.q.de" + " yy" * 300 + " HTTP://z.z"]


def _bare(token):
    return "".join(c for c in token if c == "_" or c.isalnum()).lower()


def test_tokens_words_and_offsets(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    x = F.col("t")
    cues = {w for words in EMAIL_CUE_WORDS.values() for w in words}
    for r in df.select("i", XP.tokens(x).alias("t"), XP.bare_words(x).alias("w"), XP.pieces(x).alias("p")).collect():
        want = TOKEN.findall(TEXTS[r.i] or "")
        assert r.t == want
        assert len(r.w) == len(want)
        assert [w if w in cues else "" for w in r.w] == [_bare(t) if _bare(t) in cues else "" for t in want]
        assert [p.char_offset for p in r.p] == [sum(map(len, want[:k])) for k in range(len(want))]


def test_overlapping_pieces_of_any_tokenizer(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    ui = re.compile(rf"(?i)(?:https?://|www\.)[^{WS}<>\"']+")
    for size in (None, 3):
        cut = XP.tokens if size is None else (lambda x: F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit("(?s).{1,3}"), 0))
        hit = let(XP.url_spans(F.col("t")), lambda s: XP.overlapping(cut(F.col("t")), s))
        for r in df.select("i", hit.alias("h")).collect():
            text = TEXTS[r.i] or ""
            pieces = TOKEN.findall(text) if size is None else [text[k:k + 3] for k in range(0, len(text), 3)]
            spans, at, want = [m.span() for m in ui.finditer(text)], 0, []
            for k, p in enumerate(pieces):
                if any(at < e and at + len(p) > s for s, e in spans):
                    want.append((k, p, at))
                at += len(p)
            assert [tuple(h) for h in r.h] == want


class Counting(LexicalScorer):
    """Fails when it is given the variants of a text."""

    def probabilities(self, df, text_col):
        raise AssertionError("a text was scored once for each of its tokens")


def test_counts_replace_the_variants(spark):
    """One text of n tokens costs n short scores, not n scores of the whole text."""
    class Slow(LexicalScorer):
        def word_counts(self, text):
            return None

    df = spark.createDataFrame([(i, t and t + " verify FREE! thanks, the offer") for i, t in enumerate(TEXTS)], "i int, t string")
    fast = OC.occlusion(df, ["i"], "t", Counting("email")).orderBy("i", "pos").collect()
    slow = OC.occlusion(df, ["i"], "t", Slow("email")).orderBy("i", "pos").collect()
    assert fast == slow and len(fast) > 900 and {r.target for r in fast} <= set(EMAIL_CLASSES)


def test_email_scan_is_planned_once(spark):
    """Every cue pattern is in the plan once, whatever reads the scores."""
    from threatsift.plans.triage import triage_requests
    df = spark.createDataFrame([(1, "verify", "email")], "msg_id long, text string, input_type string")
    plan = triage_requests(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("unsubscribe") == 1
