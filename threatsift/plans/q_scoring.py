"""Queries for model-side operators."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from threatsift.operators import model as MD
from threatsift.operators import sample as SM
from threatsift.operators.scoring import EMAIL_CLASSES, URL_CLASSES, PandasScorer, SparkMLScorer
from threatsift.plans import sqltext as S
from threatsift.plans.catalog import query
from threatsift.plans.q_sample import _rows, _split_sql
from threatsift.plans.triage import triage_messages
from threatsift.plans.views import view
from threatsift.session import cut_lineage, fresh_path
from threatsift.settings import EMAIL_MAX_TOKENS, URL_MAX_TOKENS


def _splits(spark, sf_dir):
    return SM.stratified_split(_rows(spark, sf_dir), "row_key")


def sql_token_ids(e: str) -> str:
    words = f"list_filter({S.all_words(e)}, lambda w: w <> '')"
    return (f"list_transform({words}, lambda w: {MD.N_SPECIAL} + "
            f"(CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {MD.VOCAB_SIZE - MD.N_SPECIAL}))")


def _sql_fixed_length() -> str:
    L = EMAIL_MAX_TOKENS
    seq = f"list_concat([{MD.BOS_ID}], ids[1:{L - 2}], [{MD.EOS_ID}])"
    return (f"SELECT text_md5, split, CAST(len(ids) AS INTEGER) AS n_tokens, "
            f"array_to_string(list_resize({seq}, {L}, {MD.PAD_ID}), ' ') AS input_ids, "
            f"CAST(len({seq}) AS INTEGER) AS n_attended FROM "
            f"(SELECT s.text_md5, s.split, {sql_token_ids('d.text')} AS ids FROM ({_split_sql()}) s "
            f"JOIN (SELECT DISTINCT md5(text) AS text_md5, text FROM v_labelled_src) d ON d.text_md5 = s.text_md5) t")


def _oracle_fixed_length() -> str:
    from threatsift.plans.views import sub
    return _sql_fixed_length().replace("v_labelled_src", sub("v_labelled") + " vl")


@query("fixed_length_tokens", _oracle_fixed_length)
def q_fixed_length_tokens(spark, sf_dir):
    """F9 (+K3 layout): 512-long id sequences and masks of every split row."""
    s = _splits(spark, sf_dir).select("text_md5", "split")
    t = s.join(_text_of_digest(spark, sf_dir), "text_md5").withColumn("ids", MD.token_ids(F.col("text")))
    input_ids, mask = MD.fixed_length(F.col("ids"), EMAIL_MAX_TOKENS)
    return t.select("text_md5", "split", F.size("ids").alias("n_tokens"),
                    F.array_join(input_ids, " ").alias("input_ids"),
                    F.aggregate(mask, F.lit(0), lambda a, v: a + v).alias("n_attended"))


@query("token_sink", lambda: f"SELECT text_md5, label, split, {EMAIL_MAX_TOKENS} AS n_ids FROM ({_split_sql()}) s")
def q_token_sink(spark, sf_dir):
    """K3: tokenised splits with their labels, written partitioned by split and
    read back (a text under two labels is two rows)."""
    s = _splits(spark, sf_dir).select("text_md5", "label", "split")
    t = s.join(_text_of_digest(spark, sf_dir), "text_md5")
    input_ids, mask = MD.fixed_length(MD.token_ids(F.col("text")), EMAIL_MAX_TOKENS)
    out = t.select("text_md5", "label", "split", input_ids.alias("input_ids"), mask.alias("attention_mask"))
    path = fresh_path(spark, "tokens")
    out.write.mode("overwrite").partitionBy("split").parquet(path)
    return spark.read.parquet(path).select("text_md5", "label", "split", F.size("input_ids").alias("n_ids"))


def _text_of_digest(spark, sf_dir):
    """One text per digest; map-side, a task keeps one copy of each."""
    d = view(spark, sf_dir, "v_labelled").select(F.md5("text").alias("text_md5"), "text")
    return d.groupBy("text_md5").agg(F.first("text").alias("text"))


def _sql_url_tokens() -> str:
    seq = f"list_concat([{MD.BOS_ID}], ids[1:{URL_MAX_TOKENS - 2}], [{MD.EOS_ID}])"
    return (f"SELECT page_id, array_to_string(list_resize({seq}, {URL_MAX_TOKENS}, {MD.PAD_ID}), ' ') AS input_ids, "
            f"CAST(len({seq}) AS INTEGER) AS n_attended FROM (SELECT page_id, {sql_token_ids('url')} AS ids FROM pages) t")


@query("url_tokens", _sql_url_tokens)
def q_url_tokens(spark, sf_dir):
    """F9 for URLs: sequences of 128 ids and their masks."""
    p = view(spark, sf_dir, "pages").select("page_id", MD.token_ids(F.col("url")).alias("ids"))
    input_ids, mask = MD.fixed_length(F.col("ids"), URL_MAX_TOKENS)
    return p.select("page_id", F.array_join(input_ids, " ").alias("input_ids"),
                    F.aggregate(mask, F.lit(0), lambda a, v: a + v).alias("n_attended"))


@query("score_batch")
def q_score_batch(spark, sf_dir):
    """M4: vectorised scoring with a Python model behind Arrow-batched
    pandas UDFs (built once per task, chunks of 32), full verdicts."""
    email = PandasScorer(partial(MD.hashed_linear_model, 3), EMAIL_CLASSES, batch_size=32)
    url = PandasScorer(partial(MD.hashed_linear_model, 2, 4096, 7), URL_CLASSES, batch_size=32)
    return triage_messages(view(spark, sf_dir, "v_messages"), email, url)


def _trained(spark, sf_dir):
    rows = _splits(spark, sf_dir).select("text_md5", "label", "split").join(_text_of_digest(spark, sf_dir), "text_md5")
    rows = cut_lineage(rows)
    model = MD.train_classifier(rows.filter(F.col("split") == "train"), max_iter=30)
    return model, rows


@query("train_classifier", headline=True)
def q_train_classifier(spark, sf_dir):
    """M5: class-weighted TF-IDF + multinomial logistic regression trained
    on the train split; predictions of the held-out rows."""
    model, rows = _trained(spark, sf_dir)
    held = rows.filter(F.col("split") != "train")
    scorer = SparkMLScorer(model, EMAIL_CLASSES, input_col="text")
    preds = scorer.predict(held, "text")
    return preds.select("text_md5", "split", "label", "is_phishing", "confidence", "p_phishing", "p_spam", "p_legitimate")


@query("train_url_classifier")
def q_train_url_classifier(spark, sf_dir):
    """M5 for URLs: two classes on character n-grams, trained on a stratified
    split of the page URLs; predictions of the held-out rows."""
    urls = view(spark, sf_dir, "v_url_labels").select(F.col("url").alias("text"), "label").dropDuplicates()
    rows = SM.stratified_split(cut_lineage(urls), "text").drop("rank")
    model = MD.train_classifier(rows.filter(F.col("split") == "train"), MD.url_pipeline, max_iter=30)
    held = rows.filter(F.col("split") != "train")
    preds = SparkMLScorer(model, URL_CLASSES, input_col="text").predict(held, "text")
    return preds.select("text", "split", "label", "is_phishing", "confidence", "p_phishing", "p_legitimate")


@query("token_importance")
def q_token_importance(spark, sf_dir):
    """M7: importance of every word of the held-out messages toward the
    predicted class of the trained linear model."""
    model, rows = _trained(spark, sf_dir)
    held = rows.filter(F.col("split") != "train")
    pred = model.transform(held.withColumn("weight", F.lit(1.0))).select(
        "text_md5", "label", "text", F.col("prediction").cast("int").alias("target"))
    return MD.token_importance(model, pred, "text_md5", "text", "target")
