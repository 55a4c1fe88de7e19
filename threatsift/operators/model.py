"""Model-side operators: fixed-length token ids (F9), Spark ML training
(M5), linear token importances (M7) and a NumPy demo model for the
pandas-UDF scorer (M4).

Token ids use the hashing trick (md5 of the word into a fixed vocabulary),
so no global vocabulary has to be built, ranked or broadcast: the mapping is
a pure per-row function, identical in every engine.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, SQLTransformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatsift.functions.text import all_words
from threatsift.operators.joins import checked_broadcast
from threatsift.session import cut_lineage

# Fixed values of the token layout: sequence start, padding, sequence end,
# and the vocabulary size of the encoder family being fed.
BOS_ID, PAD_ID, EOS_ID = 0, 1, 2
VOCAB_SIZE = 50265
N_SPECIAL = 3


def token_ids(c) -> Column:
    """Word tokens -> ids in [3, VOCAB_SIZE) by md5 hashing."""
    words = F.filter(all_words(c), lambda w: w != "")
    return F.transform(words, lambda w: F.lit(N_SPECIAL) + F.pmod(
        F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(VOCAB_SIZE - N_SPECIAL)))


def fixed_length(ids: Column, max_len: int) -> tuple[Column, Column]:
    """[BOS] + ids truncated to max_len-2 + [EOS], padded to max_len;
    returns (input_ids, attention_mask)."""
    body = F.slice(ids, 1, max_len - 2)
    seq = F.concat(F.array(F.lit(BOS_ID).cast("long")), body, F.array(F.lit(EOS_ID).cast("long")))
    pad = F.lit(max_len) - F.size(seq)
    input_ids = F.concat(seq, F.array_repeat(F.lit(PAD_ID).cast("long"), pad))
    mask = F.concat(F.array_repeat(F.lit(1), F.size(seq)), F.array_repeat(F.lit(0), pad))
    return input_ids, mask


# ---------------------------------------------------------------- M5

# Features are hashes of a token's md5 (32 ASCII characters): on strings whose
# length is a multiple of four, SQL's hash() and the feature hasher agree, so
# the index of any token can be computed in a query (tested).
WORD_TOKENS = ("transform(filter(split(lower(coalesce(text, '')), '[^\\\\p{L}\\\\p{N}_]+'), w -> w <> ''), w -> md5(w))")
NGRAM = 3


def ngram_tokens(n: int = NGRAM) -> str:
    """Character n-grams of the lowercased text (a shorter text is one token)."""
    return (f"transform(sequence(1, greatest(length(coalesce(text, '')) - {n - 1}, 1)), "
            f"i -> md5(substring(lower(coalesce(text, '')), i, {n})))")


def feature_index(token: Column, num_features: int) -> Column:
    """Index of a (plain) token in the hashed feature vector."""
    return F.pmod(F.hash(F.md5(token)), F.lit(num_features))


def text_pipeline(num_features: int = 1 << 18, weight_col: str | None = "weight", label_col: str = "label",
                  max_iter: int = 50, reg: float = 0.01, tokens: str = WORD_TOKENS) -> Pipeline:
    """Tokenise -> hashed term frequencies -> IDF -> multinomial logistic
    regression (class-weighted). ``tokens`` is the SQL of the token array:
    words for messages, character n-grams for URLs."""
    tok = SQLTransformer(statement=f"SELECT *, {tokens} AS tokens FROM __THIS__")
    tf = HashingTF(inputCol="tokens", outputCol="tf", numFeatures=num_features)
    idf = IDF(inputCol="tf", outputCol="features")
    lr = LogisticRegression(featuresCol="features", labelCol=label_col, family="multinomial",
                            maxIter=max_iter, regParam=reg)
    if weight_col:
        lr.setWeightCol(weight_col)
    return Pipeline(stages=[tok, tf, idf, lr])


def url_pipeline(num_features: int = 1 << 16, **kw) -> Pipeline:
    """M5 for URLs: two classes on character n-grams."""
    return text_pipeline(num_features, tokens=ngram_tokens(), **kw)


def with_class_weights(df: DataFrame, label_col: str = "label") -> DataFrame:
    """M6 weights n / (k * count) attached to every row (tiny join)."""
    from threatsift.operators.sample import class_weights
    w = checked_broadcast(class_weights(df, label_col).select(label_col, "weight"), 10_000)
    return df.join(w, label_col)


def train_classifier(train: DataFrame, pipeline=text_pipeline, **kw):
    """M5: fit a pipeline; returns the PipelineModel. Texts are tokenised once and
    only their term vectors written: weights, IDF and the fit all read those."""
    tok, tf, idf, lr = pipeline(**kw).getStages()
    label_col = lr.getLabelCol()
    terms = cut_lineage(tf.transform(tok.transform(train)).select(label_col, tf.getOutputCol()))
    rows = with_class_weights(terms, label_col)
    idf_model = idf.fit(rows)
    return PipelineModel([tok, tf, idf_model, lr.fit(idf_model.transform(rows))])


# ---------------------------------------------------------------- M7

def coefficient_table(model, spark) -> DataFrame:
    """(class, idx, coef, idf) for every non-zero coefficient: bounded by
    classes x numFeatures, independent of the data size."""
    lr = model.stages[-1]
    idf = model.stages[-2].idf.toArray()
    coef = lr.coefficientMatrix.toArray()
    k, j = np.nonzero(coef)
    return spark.createDataFrame(pa.table({"class": k.astype(np.int32), "idx": j.astype(np.int32),
                                           "coef": coef[k, j], "idf": idf[j]}))


def token_importance(model, df: DataFrame, key: str, text_col: str, target_col: str) -> DataFrame:
    """M7: (key, pos, token, importance) for every word of every message, in
    order: the change of the target class's logit when that word is taken out,
    |coefficient x IDF| of its feature. Words without a coefficient have 0."""
    num_features = model.stages[1].getNumFeatures()
    classes = model.stages[-1].numClasses
    coefs = checked_broadcast(coefficient_table(model, df.sparkSession), classes * num_features)
    words = F.filter(all_words(F.col(text_col)), lambda w: w != "")
    toks = df.select(key, target_col, F.posexplode(words).alias("pos", "token"))
    toks = toks.withColumn("idx", feature_index(F.col("token"), num_features))
    hit = (toks["idx"] == coefs["idx"]) & (toks[target_col] == coefs["class"])
    j = toks.join(coefs, hit, "left")
    return j.select(key, "pos", "token", F.coalesce(F.abs(F.col("coef") * F.col("idf")), F.lit(0.0)).alias("importance"))


# ---------------------------------------------------------------- M4 demo model

def hashed_linear_model(n_classes: int = 3, dim: int = 4096, seed: int = 42):
    """A deterministic NumPy bag-of-words linear model (logits), standing in
    for any Python model behind ``PandasScorer``."""
    rng = np.random.default_rng(seed)
    weights = rng.normal(0.0, 1.0, size=(dim, n_classes))

    def predict(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), n_classes))
        for i, t in enumerate(texts):
            idx = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim for w in t.lower().split()]
            if idx:
                out[i] = weights[idx].mean(axis=0)
        return out

    return predict
