"""Scorers (pluggable classifiers) and the per-model decision rules.

A scorer turns a text column into class probabilities ``p_<class>``; the
decision functions (M2/M3) turn probabilities into a prediction
``(is_phishing, confidence, message, class scores)``. Three scorer kinds:

* ``LexicalScorer``: cue-substring counts -> rational scores. Native, exact in
  SQL too, so every scoring query has a DuckDB oracle.
* ``PandasScorer``: any Python model behind an Iterator pandas UDF; the model
  is built once per task and fed Arrow batches in chunks.
* ``SparkMLScorer``: a fitted Spark ML ``PipelineModel``.

A scorer declares ``expensive``; expensive scorers get distinct-then-join
(J4) in the triage plans, cheap native ones score every occurrence in place.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatsift.functions.text import char_count, let, substring_count
from threatsift.settings import (
    DEFAULT,
    EMAIL_CUE_CHARS,
    EMAIL_CUE_WORDS,
    EMAIL_PRIORS,
    MSG_PHISHING,
    MSG_SAFE,
    MSG_SPAM,
    URL_CUE_WEIGHT,
    URL_CUES,
    URL_PRIORS,
    Settings,
)

EMAIL_CLASSES = ("legitimate", "spam", "phishing")
URL_CLASSES = ("legitimate", "phishing")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cue_count(c, cues) -> Column:
    total = F.lit(0).cast("long")
    for cue in cues:
        total = total + substring_count(c, cue)
    return total


def cue_word_pattern(words) -> str:
    """Whole-word alternation: a cue matches only a complete run of word
    characters (letters, digits, underscore), like a token of the word split.
    Most positions fail by their first letter, most others by the letter before."""
    alts = "|".join(sorted(set(words), key=lambda w: (-len(w), w)))
    first = "".join(sorted({re.escape(w[0]) for w in words}))
    return rf"(?=[{first}])(?<![a-z0-9_\p{{L}}\p{{N}}])(?:{alts})(?![\p{{L}}\p{{N}}_])"


def word_cue_counts(c, cue_words: dict, already_lower: bool = False) -> dict[str, Column]:
    """Cue-word counts per class: whole-word matches counted by the regex
    engine, nothing is materialised and no text is too long. A word listed for
    two classes counts for the first. Equal to counting tokens of the word split."""
    x = F.coalesce(_c(c), F.lit(""))
    x = x if already_lower else F.lower(x)
    out, seen = {}, set()
    for k, words in cue_words.items():
        own = [w for w in words if w not in seen]
        seen.update(own)
        out[k] = F.regexp_count(x, F.lit(cue_word_pattern(own))).cast("long") if own else F.lit(0).cast("long")
    return out


def lexical_counts(c, kind: str = "email", already_lower: bool = False) -> dict[str, Column]:
    """Cues per class. Email: cue words plus cue characters; URL: cue substrings."""
    if kind != "email":
        return {k: cue_count(c, URL_CUES[k]) for k in URL_CUES}
    counts = word_cue_counts(c, EMAIL_CUE_WORDS, already_lower)
    for k, chars in EMAIL_CUE_CHARS.items():
        for ch in chars:
            counts[k] = counts[k] + char_count(c, ch)
    return counts


def scores_of_counts(counts: dict[str, Column], kind: str = "email") -> dict[str, Column]:
    """Rational class scores: (prior_k + w * cues_k) / sum over classes."""
    priors, w = (EMAIL_PRIORS, 1) if kind == "email" else (URL_PRIORS, URL_CUE_WEIGHT)
    num = {k: F.lit(priors[k]) + F.lit(w) * counts[k] for k in counts}
    den = F.lit(0)
    for k in counts:
        den = den + num[k]
    return {k: (num[k].cast("double") / den.cast("double")) for k in counts}


def lexical_scores(c, kind: str = "email", already_lower: bool = False) -> dict[str, Column]:
    """Class scores of a text from its cues."""
    return scores_of_counts(lexical_counts(c, kind, already_lower), kind)


def softmax(c) -> Column:
    """M1: max-shifted softmax of an ARRAY<DOUBLE> of logits."""
    x = F.transform(_c(c), lambda v: v.cast("double"))
    m = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - m))
    s = F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(e, lambda v: v / s)


def decide_email(p_legit, p_spam, p_phish, settings: Settings = DEFAULT) -> dict[str, Column]:
    """M2: phishing >= threshold, else spam >= threshold, else safe with
    confidence 1 - max(phishing, spam). Scores rounded to 4 places."""
    l, s, p = _c(p_legit), _c(p_spam), _c(p_phish)
    t = settings.email_threshold
    is_ph = p >= F.lit(t)
    is_sp = ~is_ph & (s >= F.lit(t))
    conf = F.when(is_ph, p).when(is_sp, s).otherwise(F.lit(1.0) - F.greatest(p, s))
    return {
        "is_phishing": is_ph,
        "confidence": F.round(conf, 4),
        "message": F.when(is_ph, F.lit(MSG_PHISHING)).when(is_sp, F.lit(MSG_SPAM)).otherwise(F.lit(MSG_SAFE)),
        "p_phishing": F.round(p, 4),
        "p_spam": F.round(s, 4),
        "p_legitimate": F.round(l, 4),
    }


def decide_url(p_legit, p_phish, settings: Settings = DEFAULT) -> dict[str, Column]:
    """M3: phishing iff p >= threshold; confidence = winning side."""
    l, p = _c(p_legit), _c(p_phish)
    is_ph = p >= F.lit(settings.url_threshold)
    return {
        "is_phishing": is_ph,
        "confidence": F.round(F.when(is_ph, p).otherwise(l), 4),
        "message": F.when(is_ph, F.lit(MSG_PHISHING)).otherwise(F.lit(MSG_SAFE)),
        "p_phishing": F.round(p, 4),
        "p_legitimate": F.round(l, 4),
    }


class Scorer:
    """Base: subclasses implement ``probabilities`` (or override ``predict``)."""

    classes: tuple = EMAIL_CLASSES
    expensive: bool = False

    def probabilities(self, df: DataFrame, text_col: str) -> DataFrame:
        raise NotImplementedError

    def column_predict(self, text: Column, settings: Settings = DEFAULT) -> dict[str, Column] | None:
        """Native scorers return the prediction as expressions over one
        column (usable inside array lambdas); others return None."""
        return None

    def column_struct(self, text: Column, settings: Settings, body: Callable) -> Column:
        """``body`` of the prediction of ``column_predict``, as one expression."""
        return body(self.column_predict(text, settings))

    def word_counts(self, text: Column) -> dict[str, Column] | None:
        """For scorers whose scores follow from counts that simply add up over
        the whitespace-separated words of a text: these counts, else None."""
        return None

    def scores_of(self, counts: dict[str, Column]) -> dict[str, Column]:
        """Class scores by name from (sums of) ``word_counts``."""
        raise NotImplementedError

    def predict(self, df: DataFrame, text_col: str, settings: Settings = DEFAULT) -> DataFrame:
        """Adds is_phishing, confidence, message and p_* columns."""
        probs = self.probabilities(df, text_col)
        if len(self.classes) == 3:
            d = decide_email("p_legitimate", "p_spam", "p_phishing", settings)
        else:
            d = decide_url("p_legitimate", "p_phishing", settings)
        others = [c for c in probs.columns if c not in d]
        return probs.select(*others, *[v.alias(k) for k, v in d.items()])


class LexicalScorer(Scorer):
    """``lowercased=True`` when the scored text is already lowercase (the
    email path lowercases once, up front)."""

    def __init__(self, kind: str = "email", lowercased: bool = False):
        self.kind = kind
        self.lowercased = lowercased
        self.classes = EMAIL_CLASSES if kind == "email" else URL_CLASSES

    def probabilities(self, df, text_col):
        # the counts come out of a one-row generator, so no later projection repeats the scan
        counts = lexical_counts(F.col(text_col), self.kind, self.lowercased)
        one = F.array(F.struct(*[counts[k].alias(f"_n_{k}") for k in self.classes]))
        sc = self.scores_of({k: F.col(f"_n_{k}") for k in self.classes})
        return df.select("*", F.inline(one)).select(*df.columns, *[sc[k].alias(f"p_{k}") for k in self.classes])

    def word_counts(self, text):
        # cue words hold no whitespace and match whole words only; URL cues may cross any boundary
        return lexical_counts(text, self.kind, self.lowercased) if self.kind == "email" else None

    def scores_of(self, counts):
        return scores_of_counts(counts, self.kind)

    def column_struct(self, text, settings, body):
        # an array lambda shares no subexpressions: bind the counts, then the scores
        def decided(sc):
            if self.kind == "email":
                return body(decide_email(sc["legitimate"], sc["spam"], sc["phishing"], settings))
            return body(decide_url(sc["legitimate"], sc["phishing"], settings))

        def named(d):
            return F.struct(*[v.alias(k) for k, v in d.items()])
        counts = named(lexical_counts(text, self.kind, self.lowercased))
        return let(counts, lambda n: let(named(self.scores_of({k: n[k] for k in self.classes})), decided))

    def column_predict(self, text, settings=DEFAULT):
        sc = lexical_scores(text, self.kind, self.lowercased)
        if self.kind == "email":
            return decide_email(sc["legitimate"], sc["spam"], sc["phishing"], settings)
        return decide_url(sc["legitimate"], sc["phishing"], settings)


class RuleScorer(Scorer):
    """A model without class scores: phishing iff the text mentions one of the
    markers. Its predictions take the branches of the verdict that read only
    the flag and the message."""

    def __init__(self, markers: tuple[str, ...], kind: str = "email", hit: float = 0.95, miss: float = 0.10):
        self.markers = tuple(m.lower() for m in markers)
        self.classes = EMAIL_CLASSES if kind == "email" else URL_CLASSES
        self.hit, self.miss = hit, miss

    def predict(self, df, text_col, settings=DEFAULT):
        cols = self.column_predict(F.col(text_col), settings)
        return df.select("*", *[v.alias(k) for k, v in cols.items()])

    def column_predict(self, text, settings=DEFAULT):
        low = F.lower(text)
        found = F.lit(False)
        for m in self.markers:
            found = found | low.contains(m)
        found = F.coalesce(found, F.lit(False))
        cols = {
            "is_phishing": found,
            "confidence": F.when(found, F.lit(self.hit)).otherwise(F.lit(self.miss)),
            "message": F.when(found, F.lit(MSG_PHISHING)).otherwise(F.lit(MSG_SAFE)),
        }
        return cols | {f"p_{c}": F.lit(None).cast("double") for c in self.classes}


class PandasScorer(Scorer):
    """Any Python model: ``factory()`` builds ``fn(list[str]) -> ndarray[n,k]``
    of logits (or probabilities with ``logits=False``) once per task; texts
    are fed in chunks of ``batch_size``."""

    expensive = True

    def __init__(self, factory: Callable[[], Callable], classes=EMAIL_CLASSES,
                 batch_size: int = 32, logits: bool = True):
        self.factory = factory
        self.classes = tuple(classes)
        self.batch_size = batch_size
        self.logits = logits

    def _udf(self):
        factory, k, bs, logits = self.factory, len(self.classes), self.batch_size, self.logits
        schema = T.ArrayType(T.DoubleType())

        @F.pandas_udf(schema)
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = factory()
            for s in batches:
                texts = s.fillna("").astype(str).tolist()
                out = np.zeros((len(texts), k), dtype=np.float64)
                for i in range(0, len(texts), bs):
                    chunk = np.asarray(model(texts[i:i + bs]), dtype=np.float64)
                    if logits:
                        chunk = chunk - chunk.max(axis=1, keepdims=True)
                        chunk = np.exp(chunk)
                        chunk = chunk / chunk.sum(axis=1, keepdims=True)
                    out[i:i + len(chunk)] = chunk
                yield pd.Series(list(out))

        return score

    def probabilities(self, df, text_col):
        arr = self._udf()(F.col(text_col))
        tmp = df.select("*", arr.alias("_probs"))
        return tmp.select(*df.columns, *[F.col("_probs")[i].alias(f"p_{c}") for i, c in enumerate(self.classes)])


class SparkMLScorer(Scorer):
    """A fitted PipelineModel whose output has a ``probability`` vector; the
    model's input column is renamed from ``text_col``."""

    def __init__(self, model, classes=EMAIL_CLASSES, input_col: str = "text"):
        self.model = model
        self.classes = tuple(classes)
        self.input_col = input_col

    def probabilities(self, df, text_col):
        from pyspark.ml.functions import vector_to_array

        tmp_cols = [c for c in df.columns]
        staged = df.withColumn(self.input_col, F.col(text_col)) if text_col != self.input_col else df
        out = self.model.transform(staged)
        arr = vector_to_array("probability")
        out = out.select(*tmp_cols, *[arr[i].alias(f"p_{c}") for i, c in enumerate(self.classes)])
        return out
