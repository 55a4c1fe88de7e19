import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threatsift.llm import jaccard as J
from threatsift.llm import projections as P
from threatsift.llm import shingles
from threatsift.llm.components import components
from threatsift.llm.queries import QUERIES
from tests.llm.helpers import HARD_TEXTS, SF, hard_docs, no_docs


class Union:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components_of_random_graphs_paths_and_stars(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 80)] + [(5, 5), (7, 9), (9, 7), (7, 9)]
    u = Union({x for e in edges for x in e})
    for a, b in edges:
        u.join(a, b)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: u.find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def sets_by_hand(text, width=4):
    w = [x for x in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if x]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1)))


def test_shingle_sets_have_the_right_sizes():
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "B", " ", "\t", "é", "\n", "xy ", "\u00a0", "\u2003"]) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += [t or "" for t in HARD_TEXTS]
    for limit in (64, 1 << 20):
        sizes = []
        for _, rows, owner, _h in shingles.blocks(pa.array(texts), 4, limit):
            sizes += np.bincount(owner, minlength=rows).tolist()
        assert sizes == [len(sets_by_hand(t)) for t in texts]
    sliced = pa.array(["x y", *texts]).slice(1)
    assert sum(len(h) for *_, h in shingles.blocks(sliced, 4)) == sum(sizes)


def test_pairs_at_the_threshold_share_a_band_key():
    """The pigeonhole: sets at or above the threshold always meet."""
    rng = np.random.default_rng(3)
    classes = J.size_classes(85)
    def keys(tokens, k, nb):
        tokens = np.sort(tokens)
        zero = np.zeros(len(tokens), np.int64)
        return set(J._band_keys(zero, tokens, zero + k, zero + nb)[1].tolist())
    met = 0
    for _ in range(3000):
        a = int(rng.integers(6, 90))
        d = J.max_difference(2 * a, 85)
        out = int(rng.integers(0, d + 1))
        new = int(rng.integers(0, d + 1 - out))
        pool = rng.integers(0, 1 << 63, size=a + new, dtype=np.int64).astype(np.uint64)
        x, y = pool[:a], np.concatenate([pool[out:a], pool[a:]])
        common = a - out
        if 100 * common < 85 * (len(x) + len(y) - common) or set(x) == set(y):
            continue
        joins = set(J.join_bands(len(x), 85, classes)) & set(J.join_bands(len(y), 85, classes))
        assert joins, (len(x), len(y))
        assert any(keys(x, k, nb) & keys(y, k, nb) for k, nb in joins)
        met += 1
    assert met > 300


def expected_components(docs, percent=85):
    sets = {}
    u = Union(list(docs))
    for i, t in docs.items():
        sets[i] = sets_by_hand(t)
    ids = [i for i in docs if sets[i]]
    for n, i in enumerate(ids):
        for j in ids[:n]:
            common = len(sets[i] & sets[j])
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                u.join(i, j)
    return {i: (len(sets[i]), u.find(i)) for i in docs}


def test_jaccard_query_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op8_parity_sketch_join"](spark, SF).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == expected_components(docs)
    assert len(rows) == len(docs)


def _near_copies(rng):
    """Groups whose members differ by edits around the threshold, chains, and
    many documents that share one long passage but nothing else."""
    words = [f"w{i}" for i in range(5000)]
    docs = {}
    def add(ws):
        docs[len(docs) * 3 + 1] = " ".join(ws)
    for size in (4, 5, 8, 10, 12, 20, 60, 200):
        for _ in range(4):
            base = [rng.choice(words) for _ in range(size)]
            add(base)
            chain = list(base)
            for _ in range(6):
                copy = list(rng.choice([base, chain]))
                for _ in range(max(1, rng.randint(0, size // 40 + 1))):
                    k = rng.randrange(len(copy))
                    copy[k:k + rng.randint(0, 1)] = [rng.choice(words)]
                add(copy)
                chain = copy
    passage = [rng.choice(words) for _ in range(60)]
    for _ in range(40):
        add(passage + [rng.choice(words) for _ in range(rng.randint(4, 40))])
    return docs


def test_jaccard_near_copies_chains_and_passages(spark):
    docs = _near_copies(random.Random(4))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_components(df).collect()}
    want = expected_components(docs)
    assert got == want
    groups = len({c for _, c in want.values()})
    assert 20 < groups < len(docs)
    kept = J.keep_one(df.withColumn("component_id", df.doc_id)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({c for _, c in want.values()})


def test_jaccard_hard_rows(spark):
    docs = hard_docs(spark)
    rows = J.jaccard_components(docs).collect()
    assert len(rows) == docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[7]["component_id"] == 6 and by_id[0]["component_id"] == 0 and by_id[0]["n_shingles"] == 0
    assert by_id[2]["n_shingles"] == 0 and by_id[3]["n_shingles"] == 1 and by_id[None]["component_id"] is None
    assert J.jaccard_components(no_docs(spark)).count() == 0
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [0, 1, 2, 3, 4, 5, 6, 8, 20]


def expected_vectors(vectors, threshold=0.95):
    sound = {}
    for i, v in vectors.items():
        if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            sound[i] = np.array(v, dtype=np.float64) / np.linalg.norm(v)
    u, links = Union(list(vectors)), dict.fromkeys(vectors, 0)
    ids = list(sound)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if len(sound[i]) == len(sound[j]) and sound[i] @ sound[j] >= threshold:
                links[i] += 1
                links[j] += 1
                u.join(i, j)
    return {i: (links[i], u.find(i), u.find(i) == i) for i in vectors}


def test_projections_with_copies_chains_and_unsound_vectors(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vectors = {}
    for g in range(40):
        v = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 6))):
            vectors[len(vectors) * 2 + 1] = v.tolist()
            v = v + rng.normal(size=16) * 0.08 * np.linalg.norm(v) / 4
    same = rng.normal(size=16).tolist()
    for _ in range(30):
        vectors[len(vectors) * 2 + 1] = same
    for odd in (None, [], [0.0] * 16, [None] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0] * 3, [2.0] * 3, [1e-3] * 3):
        vectors[len(vectors) * 2 + 1] = odd
    schema = "vec_id long, embedding array<double>, label string, many string, id string"
    df = spark.createDataFrame([(i, v, "a", "b", "c") for i, v in vectors.items()], schema).repartition(5)
    want = expected_vectors(vectors)
    def got(df):
        return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in P.near_duplicates(df).collect()}
    assert got(df) == want
    monkeypatch.setattr(P, "CHUNK", 2)              # cells in tiles of two chunks
    assert got(df) == want
    assert P.near_duplicates(df.limit(0)).count() == 0


def test_projections_query_and_recall(spark):
    rows = QUERIES["op3_embedding_near_dedup"](spark, SF).collect()
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rows} == expected_vectors(vectors)
    rng = np.random.default_rng(6)                  # pairs just above the threshold, the hardest to meet
    x = rng.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    y = 0.952 * x + np.sqrt(1 - 0.952 ** 2) * noise
    pairs = np.concatenate([x, y]).tolist()
    found = P.near_duplicates(spark.createDataFrame(list(enumerate(pairs)), "vec_id long, embedding array<double>"))
    assert sum(r["n_links"] for r in found.collect()) >= 0.95 * 800


@pytest.mark.parametrize("rows", [2, 500, 10 ** 6, 10 ** 10])
def test_projection_plan_is_calibrated(rows):
    tables, per_table, need = P.plan(rows)
    assert 0 < need <= tables * per_table


def test_pairs_at_four_fifths_share_a_band_key():
    """At 80 percent the larger partner can be CLASS_RATIO times as large."""
    rng = np.random.default_rng(7)
    classes = J.size_classes(80)
    def keys(tokens, k, nb):
        tokens = np.sort(tokens)
        zero = np.zeros(len(tokens), np.int64)
        return set(J._band_keys(zero, tokens, zero + k, zero + nb)[1].tolist())
    largest = 0
    for a in [*range(4, 90)] * 8:
        more = int(rng.integers(0, a // 4 + 1)) if rng.random() < 0.5 else a // 4
        out = int(rng.integers(0, J.max_difference(2 * a, 80) + 1)) if more < a // 4 else 0
        pool = rng.integers(0, 1 << 63, size=a + more, dtype=np.int64).astype(np.uint64)
        x, y = pool[:a], pool[out:]
        common = a - out
        if 100 * common < 80 * (len(x) + len(y) - common) or set(x) == set(y):
            continue
        joins = set(J.join_bands(len(x), 80, classes)) & set(J.join_bands(len(y), 80, classes))
        assert joins, (len(x), len(y))
        assert any(keys(x, k, nb) & keys(y, k, nb) for k, nb in joins)
        largest += 4 * len(y) == 5 * len(x)
    assert largest > 50


def test_tile_numbers_of_many_chunks(spark):
    from threatsift.llm.common import tile_of
    chunks = [(2047, 2048), (2048, 2048), (4096, 4096), (0, 4096), (4096, 0), (4096, 8191)]
    got = [r[0] for r in spark.createDataFrame(chunks, "a int, b int").select(tile_of(F.col("a"), F.col("b"))).collect()]
    assert got == [min(c) * 2 ** 20 + max(c) for c in chunks]


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_words_without_a_common_shingle_never_link(spark):
    """Words whose letters form complementary Thue-Morse sequences cancel in every
    polynomial modulo a power of two; long words go another way than short ones."""
    rows = []
    for n in (64, 256, 1_000, 1_024, 1_025, 2_048, 4_096, 8_192):
        rows += [(len(rows), thue_morse(n)), (len(rows) + 1, thue_morse(n, "ba"))]
    rows += [(100, "AbCdEfGhI"), (101, "aBcDeFgHi"), (102, "abcdefgh"), (103, "abcdefghj")]
    got = {r["doc_id"]: r["component_id"] for r in J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (100 if i == 101 else i) for i, _ in rows}


def test_strangers_rarely_share_a_key():
    """Rows in keys of more than one document stay in proportion to the table."""
    rng = np.random.default_rng(8)
    shares = []
    for docs in (1_000, 8_000):
        for size in (30, 120):
            k, bands = J.join_bands(size, 80, J.size_classes(80))[0]
            owner = np.repeat(np.arange(docs), size)
            h = rng.integers(0, 1 << 63, size=docs * size, dtype=np.int64).astype(np.uint64)
            _, keys = J._band_keys(owner, h, np.full(len(h), k), np.full(len(h), bands))
            _, count = np.unique(keys, return_counts=True)
            shares.append(count[count > 1].sum() / docs)
            assert count.max() <= 3
    assert max(shares) < 0.001


def test_long_documents_have_few_keys():
    """Keys grow with the number of bands, however many pairs are poor."""
    rng = np.random.default_rng(9)
    for size in (3_000, 30_000, 300_000):
        k, bands = J.join_bands(size, 80, J.size_classes(80))[0]
        h = rng.integers(0, 1 << 63, size=size, dtype=np.int64).astype(np.uint64)
        zero = np.zeros(size, np.int64)
        assert len(J._band_keys(zero, h, zero + k, zero + bands)[1]) < 6 * bands


@pytest.mark.parametrize("size,cut", [(12, 2), (16, 3), (20, 4), (40, 8), (6_000, 1_200)])
def test_linked_sets_share_a_key_however_empty_their_bands(size, cut):
    """Random pairs at the threshold, many of them with nearly empty band pairs."""
    rng = np.random.default_rng(size)
    classes = J.size_classes(80)
    for _ in range(400 if size < 100 else 15):
        x = rng.integers(0, 1 << 63, size=size, dtype=np.int64).astype(np.uint64)
        y = np.unique(x)[:size - cut]
        if 100 * len(y) < 80 * size:
            continue
        keys = []
        for s in (np.unique(x), y):
            found = set()
            for k, bands in J.join_bands(len(s), 80, classes):
                zero = np.zeros(len(s), np.int64)
                found |= set(J._band_keys(zero, s, zero + k, zero + bands)[1].tolist())
            keys.append(found)
        assert keys[0] & keys[1]
