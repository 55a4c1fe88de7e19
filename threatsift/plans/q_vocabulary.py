"""Queries for ranked vocabularies and pluggable tokenizers."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatsift.operators import model as MD
from threatsift.operators import sample as SM
from threatsift.operators import vocabulary as VO
from threatsift.plans import sqltext as S
from threatsift.plans.catalog import query
from threatsift.plans.q_sample import _split_sql
from threatsift.plans.views import sub, view
from threatsift.session import cut_lineage, fresh_path
from threatsift.settings import EMAIL_MAX_TOKENS, URL_MAX_TOKENS


def _split_texts(spark, sf_dir):
    """Texts of every split row (distinct text and label), written once:
    counting and encoding both read them. Splits are made on digests, each with
    the first document that has its text and label; texts cross one shuffle, to
    these documents. The join is a merge at every size, as the keys grow with
    the documents."""
    docs = view(spark, sf_dir, "documents").select("doc_id", "text")
    labels = view(spark, sf_dir, "labels")
    label = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    d = docs.select("doc_id", F.md5("text").alias("text_md5")).join(labels.select("doc_id", label.alias("label")), "doc_id")
    rows = d.groupBy("text_md5", "label").agg(F.min("doc_id").alias("doc_id"))
    rows = rows.withColumn("row_key", F.concat(F.coalesce("text_md5", F.lit("")), F.lit("|"), F.col("label").cast("string")))
    keys = SM.stratified_split(cut_lineage(rows), "row_key").select("doc_id", "text_md5", "label", "split")
    keys = keys.filter(F.col("text_md5").isNotNull())  # a NULL text has a place in the split but no tokens
    return cut_lineage(docs.join(keys.hint("merge"), "doc_id").drop("doc_id"))


def _email_vocabulary(rows):
    train = rows.filter(F.col("split") == "train")
    return VO.ranked_vocabulary(VO.token_counts(train, VO.word_tokens("text")))


def _sequence(t, *key):
    """Sequences as text, comparable across engines."""
    return t.select(*key, "n_tokens", F.array_join("input_ids", " ").alias("input_ids"),
                    F.aggregate("attention_mask", F.lit(0), lambda a, v: a + v).alias("n_attended"))


SQL_SPLIT_TEXTS = (f"(SELECT s.text_md5, s.label, s.split, d.text FROM ({_split_sql()}) s JOIN "
                   f"(SELECT DISTINCT md5(text) AS text_md5, text FROM {sub('v_labelled')} l) d ON d.text_md5 = s.text_md5)")


def sql_words(src: str, key: str, text: str) -> str:
    """Rows (key, pos from 1, token) of every word of a text."""
    words = f"list_filter({S.all_words(text)}, lambda w: w <> '')"
    return (f"(SELECT {key}, unnest(ws) AS token, generate_subscripts(ws, 1) AS pos "
            f"FROM (SELECT {key}, {words} AS ws FROM {src} q0) q1)")


def sql_vocabulary(words: str) -> str:
    return (f"(SELECT * FROM (SELECT token, n, {VO.FIRST_WORD_ID - 1} + row_number() OVER (ORDER BY n DESC, token) AS id "
            f"FROM (SELECT token, count(*) AS n FROM {words} w GROUP BY token) c) r WHERE id < {MD.VOCAB_SIZE})")


def sql_sequences(src: str, key: str, text: str, vocabulary: str, length: int) -> str:
    """Fixed-length sequences: ids of a key's words in order, in the layout."""
    body = (f"(SELECT {key}, count(*) AS n, list(coalesce(v.id, {VO.UNK_ID}) ORDER BY pos) AS ids "
            f"FROM {sql_words(src, key, text)} w LEFT JOIN {vocabulary} v ON v.token = w.token GROUP BY {key})")
    seq = f"list_concat([{MD.BOS_ID}], coalesce(ids[1:{length - 2}], []), [{MD.EOS_ID}])"
    return (f"SELECT {key}, CAST(coalesce(n, 0) AS INTEGER) AS n_tokens, "
            f"array_to_string(list_resize({seq}, {length}, {MD.PAD_ID}), ' ') AS input_ids, "
            f"CAST(len({seq}) AS INTEGER) AS n_attended FROM (SELECT DISTINCT {key} FROM {src} q2) k "
            f"LEFT JOIN {body} b USING ({key})")


SQL_TRAIN = f"(SELECT * FROM {SQL_SPLIT_TEXTS} st WHERE split = 'train')"
SQL_EMAIL_VOCABULARY = sql_vocabulary(sql_words(SQL_TRAIN, "text_md5", "text"))


@query("ranked_vocabulary", lambda: f"SELECT token, n, id FROM {SQL_EMAIL_VOCABULARY} v")
def q_ranked_vocabulary(spark, sf_dir):
    """words of the train split with their ids by frequency rank."""
    return _email_vocabulary(_split_texts(spark, sf_dir))


def _sql_ranked_tokens() -> str:
    src = f"(SELECT concat(text_md5, '|', label, '|', split) AS row_id, text FROM {SQL_SPLIT_TEXTS} st)"
    rows = sql_sequences(src, "row_id", "text", SQL_EMAIL_VOCABULARY, EMAIL_MAX_TOKENS)
    return (f"SELECT split_part(row_id, '|', 1) AS text_md5, CAST(split_part(row_id, '|', 2) AS INTEGER) AS label, "
            f"split_part(row_id, '|', 3) AS split, n_tokens, input_ids, n_attended FROM ({rows}) t")


@query("ranked_tokens", _sql_ranked_tokens)
def q_ranked_tokens(spark, sf_dir):
    """512-long sequences of every split row by the train split's ranked
    vocabulary; words that only the held-out splits have are unknown."""
    rows = _split_texts(spark, sf_dir)
    tok = VO.RankedTokenizer(_email_vocabulary(rows))
    key = ["text_md5", "label", "split"]
    return _sequence(tok.encode(rows, key, "text", EMAIL_MAX_TOKENS), *key)


@query("ranked_url_tokens", lambda: sql_sequences(
    "pages", "page_id", "url", sql_vocabulary(sql_words("pages", "page_id", "url")), URL_MAX_TOKENS))
def q_ranked_url_tokens(spark, sf_dir):
    """F9 for URLs: 128-long sequences by the ranked vocabulary of all URLs."""
    p = view(spark, sf_dir, "pages").select("page_id", "url")
    vocabulary = VO.ranked_vocabulary(VO.token_counts(p, VO.word_tokens("url")))
    return _sequence(VO.RankedTokenizer(vocabulary).encode(p, ["page_id"], "url", URL_MAX_TOKENS), "page_id")


@query("ranked_token_sink", lambda: (
    f"SELECT text_md5, label, split, n_tokens, n_attended, md5(input_ids) AS ids_md5 FROM ({_sql_ranked_tokens()}) s"))
def q_ranked_token_sink(spark, sf_dir):
    """K3: sequences of the ranked vocabulary with labels, written partitioned
    by split and read back."""
    rows = _split_texts(spark, sf_dir)
    tok = VO.RankedTokenizer(_email_vocabulary(rows))
    key = ["text_md5", "label", "split"]
    t = VO.token_sink(rows, tok, key, "text", EMAIL_MAX_TOKENS, fresh_path(spark, "ranked-tokens"))
    return _sequence(t, *key).select(*key, "n_tokens", "n_attended", F.md5("input_ids").alias("ids_md5"))


def subword_path() -> str:
    """Default tokenizer file of the subword query; a parameter everywhere else."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query("subword_token_sink")
def q_subword_token_sink(spark, sf_dir):
    """K3 with a tokenizer plugged in: byte-level subwords of a public tokenizer
    file, 512 long, with labels; held against the library by a test."""
    tok = VO.PandasTokenizer(VO.file_tokenizer(subword_path()))
    rows = _split_texts(spark, sf_dir)
    key = ["text_md5", "label", "split"]
    t = VO.token_sink(rows, tok, key, "text", EMAIL_MAX_TOKENS, fresh_path(spark, "subword-tokens"))
    return _sequence(t, *key)
