import math
import random
import struct
import zlib
from collections import Counter, defaultdict

from threatsift.llm import packing as P
from threatsift.llm import tokens
from threatsift.llm.queries import QUERIES
from tests.llm.helpers import HARD_TEXTS, SF, hard_docs, no_docs


def one_by_one(lengths, capacity):
    """Best fit decreasing, document by document; rooms left."""
    rooms = []
    for s in sorted(lengths, reverse=True):
        fitting = [r for r in rooms if r >= s]
        if fitting:
            rooms[rooms.index(min(fitting))] -= s
        else:
            rooms.append(capacity - s)
    return sorted(rooms)


def filled(rows):
    """Rows (sequence, offset, length): rooms used, after checking they are gapless."""
    spans = defaultdict(list)
    for seq, off, length in rows:
        spans[seq].append((off, length))
    used = {}
    for seq, parts in spans.items():
        end = 0
        for off, length in sorted(parts):
            assert off == end
            end += length
        used[seq] = end
    return used


def test_plan_equals_one_by_one():
    rng = random.Random(2)
    for _ in range(150):
        capacity = rng.choice([3, 16, 64, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 150))]
        histogram = Counter(lengths)
        placements, opened = P.plan(histogram, capacity)
        rows = []
        for s, n in histogram.items():
            mine = sorted((p for p in placements if p.length == s), key=lambda p: p.rank)
            for r in range(n):
                p = [x for x in mine if x.rank <= r][-1]
                rows.append((p.first + (r - p.rank) // p.per, p.offset + (r - p.rank) % p.per * s, s))
        used = filled(rows)
        assert opened == len(used)
        assert sorted(capacity - u for u in used.values()) == one_by_one(lengths, capacity)


def test_query_packs_every_piece(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op4_best_fit_packing"](spark, SF).collect()
    enc = tokens.encoder(tokens.default_tokenizer())
    pieces = defaultdict(dict)
    for r in rows:
        pieces[r["doc_id"]][r["piece"]] = r
    assert set(pieces) == set(docs)
    for d, t in docs.items():
        ids = [*enc.encode(t).tolist(), 2]
        at = 0
        mine = [pieces[d][k] for k in range(len(pieces[d]))]
        for k, r in enumerate(mine):
            part = ids[at:at + r["length"]]
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            assert r["length"] == 1024 or k == 0
            at += r["length"]
        assert at == len(ids) and len(mine) == math.ceil(len(ids) / 1024)
    used = filled([(r["sequence_id"], r["offset"], r["length"]) for r in rows])
    assert max(used.values()) <= 1024
    assert sorted(1024 - u for u in used.values()) == one_by_one([r["length"] for r in rows], 1024)


def test_hard_rows(spark):
    rows = P.pack(hard_docs(spark), bucket_rows=2).collect()
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter([*range(len(HARD_TEXTS)), 6, 6, None, 20])
    assert {r["length"] for r in rows if r["doc_id"] in (0, 1, 20)} == {1}
    filled([(r["sequence_id"], r["offset"], r["length"]) for r in rows])
    assert P.pack(no_docs(spark)).count() == 0
