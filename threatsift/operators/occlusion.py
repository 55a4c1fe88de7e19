"""Importance of a text's pieces for any scorer, by occlusion (M7).

Each piece is taken out in turn and the rest scored again by the scorer that
is served: the change of the target class's score is the piece's importance.
Nothing is shuffled or joined: the score of the whole text rides along while
its variants are made one row at a time and scored in the scorer's batches. A
scorer of counts that add up over words needs no variants: what a token adds is
taken from the counts of the whole text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatsift.operators.explain import placed, tokens
from threatsift.operators.scoring import Scorer
from threatsift.settings import EMAIL_MAX_TOKENS

# Alternating runs of word characters and separators; together the whole text.
URL_PIECE_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"


def url_pieces(c) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(URL_PIECE_PATTERN), 0)


def _of_class(classes: tuple, target: Column) -> Column:
    """The score of the class that ``target`` names."""
    value = F.lit(None).cast("double")
    for c in classes:
        value = F.when(target == c, F.col(f"p_{c}")).otherwise(value)
    return value


def best_class(classes: tuple) -> Column:
    """Name of the class with the highest score, the first of equal ones."""
    best = F.greatest(*[F.col(f"p_{c}") for c in classes])
    name = F.lit(None).cast("string")
    for c in reversed(classes):
        name = F.when(F.col(f"p_{c}") == best, F.lit(c)).otherwise(name)
    return name


def occlusion(df: DataFrame, key: list[str], text_col: str, scorer: Scorer, target_col: str | None = None,
              pieces: Callable = tokens, max_pieces: int = EMAIL_MAX_TOKENS - 2) -> DataFrame:
    """M7: key, target, pos, token, importance for every piece, in order.

    ``scorer`` is any scorer with class probabilities. ``target_col`` names a
    column with a class name; without it the target is the class that the whole
    text scores highest for. ``pieces`` splits a text into an array whose
    concatenation is the text. As the served model reads a bounded number of
    tokens, the first ``max_pieces`` pieces are what is scored and explained. A
    text without pieces (NULL, empty, blank) gives no row."""
    wanted = [target_col] if target_col else []
    t = df.select(*key, *wanted, F.slice(pieces(F.col(text_col)), 1, max_pieces).alias("_pieces"))
    t = t.withColumn("_text", F.array_join("_pieces", ""))
    target = F.col(target_col) if target_col else best_class(scorer.classes)
    counts = scorer.word_counts(F.col("_text")) if pieces is tokens else None
    if counts is not None:
        return _by_counts(t, key, scorer, target, counts)
    whole = scorer.probabilities(t, "_text")
    whole = whole.withColumn("_target", target).withColumn("_whole", _of_class(scorer.classes, F.col("_target")))
    # a variant is the text before its piece and the text behind it
    v = whole.select(*key, "_target", "_whole", "_text", F.inline(placed(F.col("_pieces"))).alias("_pos", "_token", "_off"))
    rest = F.concat(F.substring("_text", F.lit(1), F.col("_off").cast("int")),
                    F.substring("_text", (F.col("_off") + F.length("_token") + 1).cast("int"), F.lit(2**31 - 1)))
    v = v.select(*key, "_target", "_whole", "_pos", "_token", rest.alias("_text"))
    change = F.abs(F.col("_whole") - _of_class(scorer.classes, F.col("_target")))
    return scorer.probabilities(v, "_text").select(
        *key, F.col("_target").alias("target"), F.col("_pos").alias("pos"), F.col("_token").alias("token"),
        change.alias("importance"))


def _by_counts(t: DataFrame, key: list[str], scorer: Scorer, target: Column, counts: dict[str, Column]) -> DataFrame:
    """The same for scores that follow from counts over words: every token after
    the first begins with whitespace, so no word crosses a token's ends, and
    the counts of a variant are those of the text less those of the token. Each
    token is read twice, whatever the length of its text."""
    names = list(counts)
    kept = [c for c in t.columns if c not in ("_pieces", "_text")]
    whole = t.select(*kept, "_pieces", *[counts[k].alias(f"_n_{k}") for k in names])
    scores = scorer.scores_of({k: F.col(f"_n_{k}") for k in names})
    whole = whole.select("*", *[scores[k].alias(f"p_{k}") for k in scorer.classes])
    whole = whole.withColumn("_target", target).withColumn("_whole", _of_class(scorer.classes, F.col("_target")))
    v = whole.select(*key, "_target", "_whole", *[f"_n_{k}" for k in names], F.posexplode("_pieces").alias("_pos", "_token"))
    own = scorer.word_counts(F.col("_token"))
    v = v.select(*key, "_target", "_whole", "_pos", "_token", *[(F.col(f"_n_{k}") - own[k]).alias(f"_n_{k}") for k in names])
    scores = scorer.scores_of({k: F.col(f"_n_{k}") for k in names})
    v = v.select(*key, "_target", "_whole", "_pos", "_token", *[scores[k].alias(f"p_{k}") for k in scorer.classes])
    change = F.abs(F.col("_whole") - _of_class(scorer.classes, F.col("_target")))
    return v.select(*key, F.col("_target").alias("target"), F.col("_pos").alias("pos"), F.col("_token").alias("token"),
                    change.alias("importance"))
