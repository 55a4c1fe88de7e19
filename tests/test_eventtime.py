"""The limiter in event-time order: shuffled batches, late rows, restarts,
bounded input, forgotten clients."""

import random
from datetime import datetime, timedelta

import pandas as pd

from threatsift.settings import Settings
from threatsift.streaming import eventtime as EV

T0 = datetime(2024, 1, 1)
SCHEMA = "event_id long, client string, ts timestamp, path string"


def _replay(rows, limit, window):
    """One request after another in (time, id) order."""
    kept, out = {}, {}
    for i, c, s, p in sorted(rows, key=lambda r: (r[2], r[0])):
        live = [x for x in kept.get(c, []) if s - x < window]
        out[i] = p == "/health" or len(live) < limit
        kept[c] = live + [s] if out[i] and p != "/health" else live
    return out


def _run(spark, folder, batches, st, slot, delay="15 minutes"):
    """One run, so one restart, for each batch; all on one checkpoint."""
    src, sink, ckpt = (str(folder / n) for n in ("in", "out", "ckpt"))
    for rows in batches:
        df = spark.createDataFrame([(i, c, s if s is None else T0 + timedelta(seconds=s), p) for i, c, s, p in rows], SCHEMA)
        df.coalesce(2).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        EV.start_rate_limit(stream, sink, ckpt, watermark=delay, slot_seconds=slot, settings=st, path_col="path").awaitTermination()
    return spark.read.schema("event_id long, client string, ts timestamp, allowed boolean, late boolean").parquet(sink).collect()


def test_shuffled_batches_equal_the_replay_and_late_rows_are_kept_apart(spark, tmp_path):
    rng = random.Random(5)
    st = Settings(rate_limit=3, rate_window_seconds=60, rate_exempt_paths=("/health",))
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.randrange(0, 1500) + rng.random(), rng.choice(["/p", "/p", "/p", "/health"]))
            for i in range(600)]
    first = [r for r in rows if r[2] < 900 and r[0] % 3] + [(None, None, 800, None)]
    second = [r for r in rows if r not in first] + [(900, "a", None, "/p")]
    rng.shuffle(second)
    third = [(1000, "a", 5, "/p"), (1001, "d", 6, "/p"), (1002, "b", 4000, "/p"), (None, None, 9000, None)]
    got = _run(spark, tmp_path, [first, second, third], st, 30)
    late = {r.event_id for r in got if r.late}
    # the first batch leaves every slot open; after the second the watermark lies 15 minutes before its last request
    assert late == {900, 1000, 1001} and len(got) == len(rows) + 4
    assert all(r.allowed is None for r in got if r.late) and [r.ts for r in got if r.event_id == 900] == [None]
    want = _replay([*rows, (1002, "b", 4000, "/p")], 3, 60)
    assert {r.event_id: r.allowed for r in got if not r.late} == want
    times = {i: T0 + timedelta(seconds=s) for i, _, s, _ in rows}
    assert all(abs(r.ts - times[r.event_id]) < timedelta(milliseconds=1) for r in got if r.event_id in times)


class _Map(dict):
    containsKey = dict.__contains__
    getValue = dict.__getitem__
    updateValue = dict.__setitem__
    removeKey = dict.__delitem__


class _Value:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, v):
        self.value = v

    def clear(self):
        self.value = None


class _Clock:
    """Stands for the handle, the timer values and the expired timer."""

    def __init__(self):
        self.timers, self.now = set(), 0

    def getMapState(self, *_):
        return _Map()

    def getValueState(self, *_):
        return _Value()

    def registerTimer(self, t):
        self.timers.add(t)

    def getCurrentWatermarkInMs(self):
        return self.now

    getExpiryTimeInMs = getCurrentWatermarkInMs


def _fire(p, clock):
    while clock.timers:
        clock.now = min(clock.timers)
        clock.timers.remove(clock.now)
        yield from p.handleExpiredTimer(("a",), clock, clock)


def test_a_million_requests_of_one_client_are_taken_batch_by_batch():
    p, clock = EV.SlotLimiter(100, 60_000_000, 60_000_000, "long"), _Clock()
    p.init(clock)
    alive = []

    def batches():
        for b in range(100):
            us = [3_600_000_000 + (b * 10_000 + i) * 3_600 for i in range(10_000)]
            pdf = pd.DataFrame({"request_id": range(b * 10_000, (b + 1) * 10_000), "us": us, "timed": True, "mark": False, "exempt": False})
            alive.append(b)
            yield pdf
            # the batch was put into slots before the next one was asked for
            assert sum(len(v[0]) for v in p.rows.values()) == (b + 1) * 10_000

    assert list(p.handleInputRows(("a",), batches(), clock)) == [] and len(alive) == 100
    out = list(_fire(p, clock))
    assert len(out) == 60 and max(len(o) for o in out) < 17_000          # one slot at a time
    assert sum(len(o) for o in out) == 1_000_000
    assert sum(int(o["allowed"].sum()) for o in out) == 6_000            # 100 a minute for an hour
    # the timers have removed everything, the stamps of the idle client included
    assert not p.rows and not p.parts and not p.stamps.exists() and not clock.timers


def test_open_slot_sees_stamps_that_expire_inside_it():
    p, clock = EV.SlotLimiter(1, 60_000_000, 30_000_000, "long"), _Clock()
    p.init(clock)
    pdf = pd.DataFrame({"request_id": range(3), "us": [35_000_000, 91_000_000, 95_000_000], "timed": True, "mark": False, "exempt": False})
    list(p.handleInputRows(("a",), iter([pdf]), clock))
    assert {i: a for o in _fire(p, clock) for i, a in zip(o["request_id"], o["allowed"])} == {0: True, 1: False, 2: True}


def test_stamps_outlive_a_slot_by_one_window_only():
    p, clock = EV.SlotLimiter(1, 60_000_000, 10_000_000, "long"), _Clock()
    p.init(clock)
    us = [100_000_000, 131_000_000, 159_999_999, 160_000_000, 400_000_000]
    pdf = pd.DataFrame({"request_id": range(5), "us": us, "timed": True, "mark": False, "exempt": False})
    list(p.handleInputRows(("a",), iter([pdf]), clock))
    seen = {i: a for o in _fire(p, clock) for i, a in zip(o["request_id"], o["allowed"])}
    assert seen == {0: True, 1: False, 2: False, 3: True, 4: True} and not p.stamps.exists()


def test_closed_slots_of_a_client_cost_one_timer_and_one_frame():
    calls = []

    class Counted(_Clock):
        def registerTimer(self, t):
            calls.append(t)
            super().registerTimer(t)

    p, clock = EV.SlotLimiter(2, 60_000_000, 30_000_000, "long"), Counted()
    p.init(clock)
    us = [k * 30_000_000 for k in range(200, 0, -1)]
    pdf = pd.DataFrame({"request_id": range(200), "us": us, "timed": True, "mark": False, "exempt": False})
    list(p.handleInputRows(("a",), iter([pdf]), clock))
    assert calls == [60_000]
    clock.now = 10_000_000
    clock.timers.clear()
    out = list(p.handleExpiredTimer(("a",), clock, clock))
    assert len(out) == 1 and out[0]["us"].tolist() == us[::-1] and out[0]["allowed"].all()
    assert not p.rows and not p.parts and not p.stamps.exists() and not clock.timers
