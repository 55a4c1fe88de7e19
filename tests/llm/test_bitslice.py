import numpy as np

from threatsift.llm import bitslice as B
from threatsift.llm.queries import QUERIES
from tests.llm.helpers import SF


def brute(vectors, every, k=5):
    ints = {}
    for i, v in vectors:
        if i is None or v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v):
            continue
        w = [int(np.floor(256 * np.float64(x))) for x in v]
        ints[i] = min(ints.get(i, w), w)
    out = set()
    for q, x in ints.items():
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in ints.items() if i != q and len(x) == len(y))
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(found[:k], 1)}
    return out


def test_query_equals_brute_force(spark):
    rows = QUERIES["op7_bitsliced_top_k"](spark, SF).collect()
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows} == brute(vectors, 50)
    assert len(rows) == len(set(rows))


def test_ties_unsound_vectors_repeated_rows_and_small_blocks(spark):
    rng = np.random.default_rng(1)
    vectors = [(int(i), np.round(rng.normal(size=4) * 2).tolist()) for i in range(120)]      # few values: many ties
    vectors += [(200 + i, [1.0, -1.0, 0.5, 0.0]) for i in range(20)] + [vectors[3], vectors[3]]
    vectors += [(400, None), (401, [None] * 4), (402, [float("nan")] * 4), (403, []), (None, [1.0] * 4), (500, [1.0, 2.0]), (501, [3.0, 1.0]),
                (600, [1e4, -1e4, 0.0, 3.0]), (610, [0.0] * 4)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in vectors], "vec_id long, embedding array<double>, score string, rank int")
    for block_rows, query_rows in ((16, 4), (8192, 256)):
        got = B.top_k(df, 10, block_rows=block_rows, query_rows=query_rows).collect()
        assert {tuple(r) for r in got} == brute(vectors, 10)
    assert B.top_k(df.limit(0), 10).count() == 0


def test_score_slices_are_exact():
    rng = np.random.default_rng(2)
    for _ in range(50):
        rows, dims = int(rng.integers(1, 200)), int(rng.integers(1, 9))
        values = rng.integers(-300, 300, size=(rows, dims))
        query = rng.integers(-300, 300, size=dims)
        slices, shift = B.slices_of(values)
        planes, offset = B.score_slices(slices, shift, query)
        bits = [np.unpackbits(p.view(np.uint8), bitorder="little")[:rows].astype(np.int64) for p in planes]
        score = sum((b << w for w, b in enumerate(bits)), np.zeros(rows, np.int64)) + offset
        assert (score == values @ query).all()


def test_selection_keeps_the_boundary():
    scores = np.array([5, 3, 5, 1, 3, 3, 0, 7])
    planes = [np.packbits(np.pad((scores >> b & 1).astype(bool), (0, 56)), bitorder="little").view(np.uint64) for b in range(3)]
    allowed = np.packbits(np.pad(np.ones(8, bool), (0, 56)), bitorder="little").view(np.uint64)
    assert sorted(B.select_top(planes, allowed, 2)) == [0, 2, 7]
    assert sorted(B.select_top(planes, allowed, 3)) == [0, 2, 7]
    assert sorted(B.select_top(planes, allowed, 100)) == list(range(8))


def test_components_far_apart(spark):
    rng = np.random.default_rng(3)
    vectors = [(int(i), np.round(rng.normal(size=4), 2).tolist()) for i in range(60)]
    vectors += [(70, [1e9, -1.0, 0.0, 0.5]), (71, [0.25, 1e12, -3e10, 0.0]), (75, [-4e5, 0.0, 7e4, 1.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    for block_rows in (16, 8192):
        assert {tuple(r) for r in B.top_k(df, 10, block_rows=block_rows).collect()} == brute(vectors, 10)
    values = np.array([[-2 ** 63, 5], [2 ** 63 - 1, -5], [0, 0]])
    slices, shift = B.slices_of(values)
    planes, offset = B.score_slices(slices, shift, np.array([-3, 2]))
    score = [sum((int(p[0]) >> r & 1) << w for w, p in enumerate(planes)) + offset for r in range(3)]
    assert score == [-3 * int(a) + 2 * int(b) for a, b in values]


def test_blocks_meet_without_join_or_broadcast(spark, monkeypatch):
    # a broadcast of the queries, once for every block of rows, ended the driver
    rng = np.random.default_rng(4)
    vectors = [(int(i), np.round(rng.normal(size=4), 1).tolist()) for i in range(150)] + [(i, [0.5, float(i)]) for i in range(200, 230)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    for every, group in ((10, 65_536), (2, 16), (1, 16)):        # one group of queries and several
        monkeypatch.setattr(B, "QUERY_GROUP", group, raising=False)
        found = B.top_k(df, every, block_rows=16, query_rows=4)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Broadcast" not in plan
        assert {tuple(r) for r in found.collect()} == brute(vectors, every)


def test_grid_bounds_the_queries_of_a_task():
    for blocks, query_blocks, query_rows, tasks in ((1, 1, 256, 400), (7, 5, 256, 24), (75, 49, 256, 50), (1878, 1202, 256, 1200), (3, 2000, 256, 24)):
        r, q = B.grid(blocks, query_blocks, query_rows, tasks)
        assert 1 <= r <= blocks and 1 <= q <= query_blocks
        assert query_blocks * query_rows / q <= B.QUERY_GROUP and r * q >= min(tasks, blocks * query_blocks)


def test_signed_digits_and_rows_at_least():
    q = np.array([0, 1, -1, 7, -7, 150, -150, 2 ** 62 - 1, 2 ** 63 - 1, -2 ** 63])
    for part in (q[:7], q[:8], q):
        plus, minus = B.signed_digits(part)
        assert [int(a) - int(b) for a, b in zip(plus, minus)] == part.tolist()
    scores = np.array([5, 3, 5, 1, 3, 3, 0, 7])
    planes = [np.packbits(np.pad((scores >> b & 1).astype(bool), (0, 56)), bitorder="little").view(np.uint64) for b in range(3)]
    allowed = np.packbits(np.pad(np.arange(8) != 2, (0, 56)), bitorder="little").view(np.uint64)
    for low in (-4, 0, 1, 3, 4, 7, 8, 100):
        assert B._positions(B.at_least(planes, allowed, low)).tolist() == [i for i in range(8) if i != 2 and scores[i] >= low]
