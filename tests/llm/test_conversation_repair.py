import hashlib
import heapq
import random
import re
import zlib

import numpy as np

from tests.llm.helpers import SF
from threatsift.llm import conversation_repair as R
from threatsift.llm import path_ranks as P
from threatsift.llm.common import read_table
from threatsift.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, key string, pos string, seg int, cost double"


def damage(rows):
    out = []
    for c, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(c, turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, repaired) by a search in order of (cost, audit)."""
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, last, kept = heapq.heappop(queue)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit, kept
        more = "a" if last == "u" else "u"
        name = {"u": "user", "a": "assistant"}[more]
        heapq.heappush(queue, (cost + 5, audit + "I", i, more, (*kept, f"{name}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, last, kept))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                if role[:1] == more or role[:1] == "s" and last == "":
                    heapq.heappush(queue, (cost + extra, audit + "K", i + 1, role[0], (*kept, f"{role}:{text}")))
                heapq.heappush(queue, (cost + 1 + extra, audit + "R", i + 1, more, (*kept, f"{name}:{text}")))


def brute(rows):
    out = {}
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in damage(rows) if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, judged = set(), []
        for _, _, role, text in mine:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = [r[1] for r in mine if r[1] is not None]
        cost, audit, kept = cheapest(judged)
        count = {f: sum(x[2] == f for x in judged) for f in ("blank", "duplicate", "truncated")}
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *count.values(), illegal, cost, audit,
                  hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def conversations(n, seed=3):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rnd.randint(1, 12)):
            role = rnd.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "Assistant"]) if rnd.random() < 0.4 else ("user", "assistant")[t % 2]
            text = rnd.choice(["Hi.", "Yes!", "no end", " \t\r\n", "", None, "Trail. \n ", f"Line {rnd.random()}?", "ünï 👍."])
            rows.append((c if c else None, rnd.choice([t, t, t, t + 3, None]), role, text))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, 0.5) for r in rows], SCHEMA).repartition(3)


def results(df):
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(list(r)[1:]) for r in rows}


def test_random_conversations_against_search(spark):
    rows = conversations(300)
    rows += rows[:4]                                                 # whole rows repeated
    df = frame(spark, rows)
    assert results(R.audit_conversations(df, R.damaged(df))) == brute(rows)


def test_segments_do_not_matter(spark):
    """A conversation that is longer than a segment, and repaired rows."""
    rows = [(7, i, ("user", "assistant")[i % 2] if i % 5 else "user", f"Turn {i // 3}.") for i in range(90)] + conversations(20, 5)
    df = frame(spark, rows)
    bad = R.damaged(df)
    want = brute(rows)
    assert results(R.audit_conversations(df, bad, segment=4)) == want
    lines = {}
    for r in sorted(R.repair(bad, segment=4).collect(), key=lambda r: (r["key"], r["at"])):
        lines.setdefault(r["key"], []).append(f"{r['role']}:{r['text']}")
    for c, w in want.items():
        text = "\n".join(lines.get(" " if c is None else str(c), []))
        assert hashlib.sha256(text.encode()).hexdigest() == w[-1]


def test_whole_table(spark):
    rows = [tuple(r) for r in read_table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert results(QUERIES["op12_conversation_repair"](spark, SF)) == brute(rows)


def test_long_text_and_empty_table(spark):
    rows = [(1, 0, "user", "word " * 200_000 + "."), (1, 1, "assistant", "ok."), (2, None, None, None)]
    df = frame(spark, rows)
    assert results(R.audit_conversations(df, R.damaged(df))) == brute(rows)
    none = frame(spark, rows).limit(0)
    assert R.audit_conversations(none, R.damaged(none)).count() == 0 and R.repair(none).count() == 0


def test_insertions_when_they_pay(spark, monkeypatch):
    """With dear deletions inserting is cheaper; the ranks spell such paths too."""
    monkeypatch.setitem(P.COSTS, "delete", 20)
    codes, size = P.padded([np.array([1, 1, 2]), np.array([2]), np.array([0]), np.array([], dtype=np.int64)])
    exits = np.broadcast_to(P.end_costs(), (4, 4)).copy()
    audits, _ = P.ranked_paths(codes, size, exits, np.ones(4, bool))
    assert [a[0] for a in audits] == ["KIKK", "IK", "IR", ""]
