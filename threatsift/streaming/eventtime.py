"""Rate limits in event-time order over a stream, late requests kept apart.

``rate_limit_stream`` answers at once and takes each micro-batch as it comes.
``rate_limit_events`` waits for the watermark instead: a request is judged when
the time slot it lies in is closed, so the answer is that of the batch form
(``rate_limit_flags``) however the requests were shuffled over micro-batches.
A request whose slot was closed before it arrived is late: it gets no judgement
and is returned as such, so every request comes out exactly once.

The state of a client is its open slots (times, ids and exempt marks, in parts
of one Arrow batch each), the accepted stamps of the last window, and a timer: at
the end of its first open slot, or, when none is open, one that forgets the stamps
when the client has been idle for a window. A task holds one Arrow batch or one
slot of one client and the numbers of its open slots, never a client's whole
micro-batch; the rest lies in the state store (RocksDB, on disk). A slot costs two
calls of the store when it is filled and three when it is judged, and the judgements
of a client's closed slots leave the task together (``OUT_ROWS``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from threatsift.settings import DEFAULT, Settings
from threatsift.streaming.ratelimit import US, _limiter, _micros

PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

OUT_ROWS = 10_000  # judgements of one client that leave a task together


class SlotLimiter(StatefulProcessor):
    """Collects a client's requests by time slot and replays each slot in
    (time, id) order when the watermark has passed its end."""

    def __init__(self, limit: int, window_us: int, slot_us: int, id_type: str):
        self.limit, self.window_us, self.slot_us, self.id_type = limit, window_us, slot_us, id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "slot long", "n long")
        self.rows = handle.getMapState(
            "rows", "slot long, part long", f"us array<long>, ids array<{self.id_type}>, exempt array<boolean>")
        self.stamps = handle.getValueState("stamps", "us array<long>")

    def _out(self, key, us, ids, allowed, late: bool) -> pd.DataFrame:
        n = len(ids)
        return pd.DataFrame({"request_id": pd.Series(ids, dtype=object), "client_key": pd.Series([key[0]] * n, dtype=object),
                             "us": pd.Series(us, dtype=object), "allowed": pd.Series(allowed, dtype=object),
                             "late": pd.Series([late] * n, dtype=bool)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        closed_us = timerValues.getCurrentWatermarkInMs() * 1000
        parts = None  # of the client's open slots, read once
        for pdf in rows:
            pdf = pdf[~pdf["mark"].to_numpy(dtype=bool)]  # time marks only move the watermark
            timed = pdf["timed"].to_numpy(dtype=bool)
            slot = pdf["us"].to_numpy(dtype="int64") // self.slot_us
            late = ~timed | ((slot + 1) * self.slot_us <= closed_us)
            if late.any():
                us = [u if t else None for u, t in zip(pdf["us"][late].tolist(), timed[late].tolist())]
                yield self._out(key, us, pdf["request_id"][late].tolist(), [None] * int(late.sum()), True)
                pdf, slot = pdf[~late], slot[~late]
            if not len(slot):
                continue
            if parts is None:
                parts = self._open_slots()
            order = np.argsort(slot, kind="stable")
            slot = slot[order]
            us, ids, exempt = (pdf[c].iloc[order].tolist() for c in ("us", "request_id", "exempt"))
            cuts = [0, *(np.flatnonzero(np.diff(slot)) + 1).tolist(), len(slot)]
            if not parts or slot[0] < min(parts):
                self._wake(int(slot[0]))
            for lo, hi in zip(cuts, cuts[1:]):
                s = int(slot[lo])
                n = parts.get(s, 0)
                self.rows.updateValue((s, n), (us[lo:hi], ids[lo:hi], [bool(e) for e in exempt[lo:hi]]))
                self.parts.updateValue((s,), (n + 1,))
                parts[s] = n + 1

    def _open_slots(self) -> dict[int, int]:
        return {s[0]: n[0] for s, n in zip(list(self.parts.keys()), list(self.parts.values()))}

    def _wake(self, slot: int) -> None:
        self.handle.registerTimer((slot + 1) * self.slot_us // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # every slot that the watermark has closed is judged now, one after another
        now_us = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000
        now_us = now_us // self.slot_us * self.slot_us
        had = self.stamps.exists()
        stamps = list(self.stamps.get()[0]) if had else []
        parts = self._open_slots()
        closed = sorted(s for s in parts if (s + 1) * self.slot_us <= now_us)
        out_us, out_ids, out_allowed = [], [], []
        for slot in closed:
            pending = []
            for part in range(parts.pop(slot)):
                us, ids, exempt = self.rows.getValue((slot, part))
                pending += zip(us, ids, exempt)
                self.rows.removeKey((slot, part))
            self.parts.removeKey((slot,))
            pending.sort(key=lambda r: r[:2])
            if stamps and pending[0][0] < stamps[-1]:
                raise RuntimeError("time slots of a client were closed out of order")
            flags, stamps = _limiter(self.limit, self.window_us, [u for u, _, e in pending if not e], stamps)
            judged = iter(flags)
            out_allowed += [True if e else next(judged) for _, _, e in pending]
            out_us += [u for u, _, _ in pending]
            out_ids += [i for _, i, _ in pending]
            if len(out_ids) >= OUT_ROWS:
                yield self._out(key, out_us, out_ids, out_allowed, False)
                out_us, out_ids, out_allowed = [], [], []
        if out_ids:
            yield self._out(key, out_us, out_ids, out_allowed, False)
        # stamps that no later slot can see are forgotten; the last one sets the next
        # timer, at a slot's end, unless an open slot has one
        stamps = [s for s in stamps if s + self.window_us > now_us]
        if parts:
            self._wake(min(parts))
        elif stamps:
            self.handle.registerTimer(-(-(stamps[-1] + self.window_us) // self.slot_us) * self.slot_us // 1000)
        if stamps:
            self.stamps.update((stamps,))
        elif had:
            self.stamps.clear()

    def close(self) -> None:
        pass


def rate_limit_events(stream: DataFrame, key: str = "client", ts: str = "ts", id_col: str = "event_id",
                      watermark: str = "1 hour", slot_seconds: int = 60, settings: Settings = DEFAULT,
                      path_col: str | None = None) -> DataFrame:
    """X2 in event-time order: (id, key, ts, allowed, late) per request.

    ``slot_seconds`` is the step in which requests are judged and the most one
    task holds of a client. ``late`` requests (slot closed by the watermark on
    arrival, or no time at all) have a null ``allowed`` and are not counted. Times
    before 1970 are late, for Spark's watermark starts there. A row without an id
    is a time mark: it moves the watermark and gets no output. A null client is a
    client of its own; equal ids are judged one by one. Start it under the RocksDB
    state store (``start_rate_limit`` does)."""
    if slot_seconds <= 0:
        raise ValueError("a slot must last at least a second")
    exempt = F.coalesce(F.col(path_col).isin(*settings.rate_exempt_paths), F.lit(False)) if path_col else F.lit(False)
    id_type, key_type, ts_type = (stream.schema[c].dataType for c in (id_col, key, ts))
    # no nulls and no leading underscores: the processor's frames are built from
    # named tuples, where either would change names, types or keys
    src = stream.select(
        F.col(ts).cast("timestamp").alias("time"), F.coalesce(_micros(ts), F.lit(0)).alias("us"), F.col(ts).isNotNull().alias("timed"),
        F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("client_key"),
        F.coalesce(F.col(id_col), F.lit("0").cast(id_type)).alias("request_id"), F.col(id_col).isNull().alias("mark"), exempt.alias("exempt"))
    # the watermark sits on a copy of the time that the limiter does not read, so
    # Spark does not drop late rows before the limiter sees them
    src = src.withWatermark("time", watermark).select("client_key", "request_id", "us", "timed", "mark", "exempt")
    out_schema = T.StructType([T.StructField("request_id", id_type), T.StructField("client_key", T.StringType()),
                               T.StructField("us", T.LongType()), T.StructField("allowed", T.BooleanType()),
                               T.StructField("late", T.BooleanType())])
    judge = SlotLimiter(settings.rate_limit, settings.rate_window_seconds * US, slot_seconds * US, id_type.simpleString())
    out = src.groupBy("client_key").transformWithStateInPandas(judge, out_schema, "Append", "EventTime")
    client = F.when(F.col("client_key") != "", F.substring("client_key", 2, 2**31 - 1)).cast(key_type)
    return out.select(F.col("request_id").alias(id_col), client.alias(key), F.timestamp_micros("us").cast(ts_type).alias(ts), "allowed", "late")


def start_rate_limit(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True, **options):
    """Start ``rate_limit_events`` into one table in two parts, judged and late
    (``late`` is its partition column); returns the StreamingQuery. The file sink
    writes each micro-batch once, also over restarts on the same checkpoint."""
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER_CONF, None)
    spark.conf.set(PROVIDER_CONF, ROCKSDB)  # a query keeps the settings it was started with
    try:
        w = rate_limit_events(stream, **options).writeStream.format("parquet").partitionBy("late")
        w = w.option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
        w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
        return w.start()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER_CONF)
        else:
            spark.conf.set(PROVIDER_CONF, before)


def read_judged(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table of ``start_rate_limit`` (``schema``: that of ``rate_limit_events``)."""
    return spark.read.schema(schema).parquet(path)
