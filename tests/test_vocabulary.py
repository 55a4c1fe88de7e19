"""Ranked vocabularies and pluggable tokenizers, against plain Python."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from threatsift.operators import model as MD
from threatsift.operators import vocabulary as VO


def _texts(n=150):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["naïve", "日本", "𝔘x", "Über", "a_b"]
    rows = [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=rng.randint(1, 30))))
            for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, " ,;! "), (n + 3, "hot " * 5000), (n + 4, rows[0][1])]


def _words(text):
    return [w for w in re.split(r"[^\w]+", (text or "").lower()) if w]


def _ids(rows):
    counts = Counter(w for _, t in rows for w in _words(t))
    order = sorted(counts, key=lambda w: (-counts[w], w.encode()))
    return {w: VO.FIRST_WORD_ID + i for i, w in enumerate(order)}, counts


def _layout(ids, length):
    seq = [MD.BOS_ID, *ids[:length - 2], MD.EOS_ID]
    return seq + [MD.PAD_ID] * (length - len(seq)), [1] * len(seq) + [0] * (length - len(seq))


@pytest.fixture(scope="module")
def corpus(spark):
    rows = _texts()
    return rows, spark.createDataFrame(rows, "id long, text string").repartition(5)


def test_ids_follow_frequency_then_bytes(spark, corpus):
    rows, df = corpus
    want, counts = _ids(rows)
    got = VO.ranked_vocabulary(VO.token_counts(df, VO.word_tokens("text")), None).collect()
    assert {r["token"]: r["id"] for r in got} == want
    assert {r["token"]: r["n"] for r in got} == dict(counts)


def test_exact_rank_is_the_same_for_any_number_of_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("c"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        seen = []
        for ranges in ("1", "3", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", ranges)
            r = VO.exact_rank(df, [F.col("c").desc(), F.col("k").asc()])
            seen.append([x["rank"] for x in r.orderBy(F.col("c").desc(), "k").collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert seen == [list(range(1, 1001))] * 3
    assert VO.exact_rank(df.limit(0), [F.col("k").asc()]).count() == 0


@pytest.mark.parametrize("size", [12, 30, MD.VOCAB_SIZE])
@pytest.mark.parametrize("length", [8, 128])
def test_sequences_of_the_ranked_vocabulary(spark, corpus, size, length):
    rows, df = corpus
    ids, _ = _ids(rows)
    ids = {w: i for w, i in ids.items() if i < size}
    vocabulary = VO.ranked_vocabulary(VO.token_counts(df, VO.word_tokens("text")), size)
    assert vocabulary.count() == len(ids)
    got = {r["id"]: r for r in VO.RankedTokenizer(vocabulary, size).encode(df, ["id"], "text", length).collect()}
    assert len(got) == len(rows)
    for key, text in rows:
        words = _words(text)
        seq, mask = _layout([ids.get(w, VO.UNK_ID) for w in words], length)
        assert (got[key]["n_tokens"], got[key]["input_ids"], got[key]["attention_mask"]) == (len(words), seq, mask)


def test_texts_do_not_move(spark, corpus):
    _, df = corpus
    vocabulary = VO.ranked_vocabulary(VO.token_counts(df, VO.word_tokens("text")))
    plan = VO.RankedTokenizer(vocabulary).encode(df.coalesce(2), ["id"], "text", 16)
    text = plan._jdf.queryExecution().executedPlan().toString()
    after = text[:text.index("Generate")]  # what is planned above the explode
    assert "text#" not in after


def test_hashed_tokenizer_has_the_same_layout(spark, corpus):
    rows, df = corpus
    got = {r["id"]: r for r in VO.HashedTokenizer().encode(df, ["id"], "text", 16).collect()}
    for key, text in rows:
        n = len(_words(text))
        assert got[key]["n_tokens"] == n and sum(got[key]["attention_mask"]) == min(n, 14) + 2
        assert len(got[key]["input_ids"]) == 16


def test_a_library_tokenizer_plugs_in(spark, corpus, tmp_dir):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    rows, df = corpus
    rows = rows + [(1000, "<|endoftext|> \x00 é\n\n" * 40)]
    df = df.unionByName(spark.createDataFrame(rows[-1:], df.schema)).withColumn("split", F.lit("train"))
    tok = VO.PandasTokenizer(VO.file_tokenizer(path))
    t = VO.token_sink(df, tok, ["id", "split"], "text", 32, tmp_dir + "/tokens")
    got = {r["id"]: r for r in t.collect()}
    lib = tokenizers.Tokenizer.from_file(path)
    assert len(got) == len(rows)
    for key, text in rows:
        ids = lib.encode(text, add_special_tokens=False).ids if text else []
        seq, mask = _layout([i + MD.N_SPECIAL for i in ids], 32)
        assert (got[key]["n_tokens"], got[key]["input_ids"], got[key]["attention_mask"]) == (len(ids), seq, mask)


def test_a_task_holds_the_ids_of_few_texts(spark):
    """Sequences come back in chunks, and a batch of texts is small, also where
    a task has many rows."""
    class Watched(VO.PandasTokenizer):
        CHUNK = 7

    df = spark.range(40).selectExpr("id", "repeat('a ', cast(id as int)) AS text").coalesce(1)
    got = Watched(lambda: lambda t: list(range(len(t.split())))).encode(df, ["id"], "text", 12).collect()
    assert {r.id: r.n_tokens for r in got} == {i: i for i in range(40)}
    assert all(r.input_ids[1:1 + min(r.id, 10)] == [i + 3 for i in range(min(r.id, 10))] for r in got)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
