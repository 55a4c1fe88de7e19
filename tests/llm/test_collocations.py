import random
import re
from collections import Counter

from tests.llm.helpers import hard_docs, no_docs
from threatsift.llm import collocations as C
from threatsift.llm import windows as W

SCHEMA = "doc_id long, text string, lang string, bucket int, n long, w1 string, batch binary, rank int"


def brute(docs, least, top):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    found = {}
    for (lang, w), a in f.items():
        if len(w) > 1 and a >= least:
            cuts = [(10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
            found[lang, w] = (a, *min(cuts))
    kept = [x for x in found if not any(
        y[0] == x[0] and len(y[1]) > len(x[1]) and 100 * found[y][0] >= 50 * found[x][0]
        and any(y[1][i:i + len(x[1])] == x[1] for i in range(len(y[1]))) for y in found)]
    out = []
    for lang in {x[0] for x in kept}:
        mine = sorted((-found[x][1], -found[x][0], " ".join(x[1]).encode(), x) for x in kept if x[0] == lang)
        for i, (score, _, phrase, x) in enumerate(mine[:top]):
            out.append((lang, i + 1, phrase.decode(), found[x][0], found[x][3], found[x][4], n[lang], -score))
    return sorted(out)


def frame(spark, docs):
    return spark.createDataFrame([(i, t, lang, 1, 2, "x", None, 3) for i, (lang, t) in enumerate(docs)], SCHEMA).repartition(4)


def random_docs():
    rnd = random.Random(2)
    words = ["of", "The", "the", "x\x01y", "ünï", "日本", "New", "york", "city", "a b", "%", "z" * 40]
    marks = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "\x0b", "!?"]
    docs = [(rnd.choice(["en", "en", "en", None, "de", "und", ""]),
             "".join(rnd.choice(words) + rnd.choice(marks) for _ in range(rnd.randint(0, 120)))) for _ in range(150)]
    docs += [("en", "new york city hall " * 50), ("en", None), ("en", ""), (None, None), ("de", " ... ,;")]
    return docs + docs[:6]


def test_random_texts_against_brute_force(spark):
    docs = random_docs()
    for least, top, chars, limit in ((2, 40, 10**6, 10**6), (10, 2000, 400, 300)):    # one bucket; many buckets and full tasks
        got = sorted(tuple(r) for r in C.collocations(frame(spark, docs), least, top, chars, limit).collect())
        assert got == brute(docs, least, top) and got


def test_sums_beyond_64_bits_in_products(spark):
    """10**6 a a passes 64 bits from a of about four million."""
    text = "a b " * 1_300_000
    docs = [("en", text)] * 4
    rows = [tuple(r) for r in C.collocations(frame(spark, docs)).collect()]
    by = {r[2]: r for r in rows}
    n = 4 * 2_600_000
    a3 = 4 * 1_299_999
    assert by["b a b"][3:] == (a3, n // 2, n // 2, n, 10**6 * a3 * a3 // (n // 2) ** 2)


def test_word_lists_cut_only_between_words():
    rnd = random.Random(4)
    data = "".join(rnd.choice(["ab", "c", " ", "\t", ".", "\n", "é"]) for _ in range(5_000)).encode() + b"tail" * 50
    whole = [w for part in W.word_lists(data) for w in part]
    for step in (1, 7, 64):
        parts = [w for part in W.word_lists(data, step) for w in part]
        squeeze = lambda ws: [w for i, w in enumerate(ws) if w or (i and ws[i - 1])]
        assert squeeze(parts) == squeeze(whole)
    assert list(W.word_lists(b"")) == []


def test_hard_rows_and_empty_table(spark):
    rows = C.collocations(hard_docs(spark)).collect()
    assert {r["lang"] for r in rows} == {"en"} and any(r["phrase"] == "alpha beta gamma" for r in rows)
    assert C.collocations(no_docs(spark)).count() == 0
