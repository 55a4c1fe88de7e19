import random

import pytest

from threatsift.llm import token_counts, tokens
from threatsift.llm.queries import QUERIES
from tests.llm.helpers import HARD_TEXTS, SF, hard_docs, no_docs

PARTS = ["<|endoftext|>", "<|endof", "text|>", " ", "'", "re", "'s", "é", "一", "1", "22", "\n\n", "  ", "\t", "a", "b", "!", "...",
         "👍", "ab" * 30, "一" * 50, "z" * 90, " " * 40, "٣٤", "\u00a0", "\u2003"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokens.default_tokenizer())


def test_spliced_chunks_equal_the_library(library):
    rng = random.Random(4)
    enc = tokens.encoder(tokens.default_tokenizer())
    for _ in range(600):
        t = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 140)))
        want = library.encode(t, add_special_tokens=False).ids
        for chunk, overlap in ((100, 40), (64, 33), (1 << 16, 256)):
            assert list(enc.encode(t, chunk, overlap)) == want
            assert enc.count(t, chunk, overlap) == len(want)


def test_endless_word_widens_until_it_fits(library):
    enc = tokens.encoder(tokens.default_tokenizer())
    rng = random.Random(5)
    t = "start " + "".join(rng.choice("abcdefgh") for _ in range(5000)) + " end"
    want = library.encode(t, add_special_tokens=False).ids
    assert list(enc.encode(t, 200, 50)) == want


def test_query_equals_the_library(spark, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op5_token_counts"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = len(library.encode(docs[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(docs[r["doc_id"]].encode()), n, n > 512)


def test_hard_rows(spark, library):
    rows = token_counts.count_tokens(hard_docs(spark)).collect()
    assert len(rows) == len(HARD_TEXTS) + 4
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[20]["n_tokens"] == 0 and by_id[20]["n_bytes"] == 0 and by_id[20]["over_limit"] is False
    for i, t in enumerate(HARD_TEXTS):
        assert by_id[i]["n_tokens"] == len(library.encode(t or "", add_special_tokens=False).ids)
    assert token_counts.count_tokens(no_docs(spark)).count() == 0
