"""Per-client sliding-window rate limiting.

* ``trailing_request_count`` (W6): requests in the trailing window per
  client, regardless of acceptance. A RANGE window partitioned by (client,
  time bucket); each row is also copied into the next bucket when it lies in
  its bucket's last window, as context only. So no task ever holds a whole
  client, however hot.
* ``rate_limit_flags`` (X1): a request is allowed iff fewer than ``limit``
  *accepted* requests lie in the trailing window (rejected ones are not
  recorded). Acceptance depends on earlier acceptances, so each client's
  sequence is replayed in order by a small Python function over a stream of
  Arrow batches (secondary sort: partitioned by client and segment, sorted by
  time inside), keeping only ``limit`` timestamps, so a hot client never has to
  fit in memory. The sequence is cut at idle gaps >=
  window, where the state is provably empty, so independent segments run in
  parallel.
* ``rate_limit_stream`` (X2): the same rule as Structured Streaming state,
  ``applyInPandasWithState`` keyed by client; the state holds at most
  ``limit`` accepted timestamps, and an event-time timeout evicts idle
  clients once the watermark passes.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from threatsift.settings import DEFAULT, Settings

US = 1_000_000


def _micros(ts) -> F.Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp"))


def trailing_request_count(df: DataFrame, key: str = "client", ts: str = "ts", window_seconds: int = 60,
                           bucket_seconds: int = 3600, out: str = "trailing_count") -> DataFrame:
    """count(*) over (partition by key order by ts range between
    window preceding and current row), skew-safe by time bucketing."""
    if bucket_seconds < window_seconds:
        raise ValueError("bucket must be at least one window long")
    w_us, b_us = window_seconds * US, bucket_seconds * US
    x = df.withColumn("_us", _micros(ts))
    b = F.floor(F.col("_us") / F.lit(b_us)).cast("long")
    tail = (F.col("_us") - b * F.lit(b_us)) >= F.lit(b_us - w_us)
    x = x.withColumn("_home", b).withColumn(
        "_b", F.explode(F.when(tail, F.array(b, b + 1)).otherwise(F.array(b))))
    w = Window.partitionBy(key, "_b").orderBy("_us").rangeBetween(-w_us, 0)
    x = x.withColumn(out, F.count(F.lit(1)).over(w))
    return x.filter(F.col("_b") == F.col("_home")).drop("_us", "_b", "_home")


def _limiter(limit: int, window_us: int, ts_us: list[int], state: list[int] | None = None) -> tuple[list[bool], list[int]]:
    """Sequential rule: accepted stamps at least a window older than a request
    are dropped, and it is rejected when ``limit`` remain. The stamps are kept
    sorted, so requests may arrive out of order."""
    acc = state or []
    out = []
    for t in ts_us:
        del acc[:bisect.bisect_right(acc, t - window_us)]
        if len(acc) >= limit:
            out.append(False)
        else:
            bisect.insort(acc, t)
            out.append(True)
    return out, acc


def _segments(df: DataFrame, key: str, order_col: str, window_us: int, bucket_us: int) -> DataFrame:
    """Adds ``_seg``: the start of the run of requests without an idle gap of a
    window. Rows are compared within (client, time bucket), each bucket with
    the last window of the one before as context; only one row per client and
    bucket takes part in the running maximum over a whole client."""
    b = F.floor(F.col("_us") / F.lit(bucket_us)).cast("long")
    tail = (F.col("_us") - b * F.lit(bucket_us)) >= F.lit(bucket_us - window_us)
    x = df.withColumn("_home", b).withColumn("_b", F.explode(F.when(tail, F.array(b, b + 1)).otherwise(F.array(b))))
    order = Window.partitionBy(key, "_b").orderBy("_us", order_col)
    prev = F.lag("_us").over(order)
    x = x.withColumn("_start", F.when(prev.isNull() | ((F.col("_us") - prev) >= F.lit(window_us)), F.col("_us")))
    x = x.withColumn("_start", F.when(F.col("_b") == F.col("_home"), F.col("_start")))
    x = x.withColumn("_local", F.max("_start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.filter(F.col("_b") == F.col("_home"))
    last = x.groupBy(F.col(key).alias("_k"), F.col("_home").alias("_h")).agg(F.max("_start").alias("_last"))
    before = Window.partitionBy("_k").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select("_k", "_h", F.max("_last").over(before).alias("_carried"))
    x = x.join(last, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_home") == F.col("_h")))
    return x.withColumn("_seg", F.coalesce("_local", "_carried")).drop("_home", "_b", "_start", "_local", "_k", "_h", "_carried")


def rate_limit_flags(df: DataFrame, key: str = "client", ts: str = "ts", order_col: str = "event_id",
                     settings: Settings = DEFAULT, path_col: str | None = None, bucket_seconds: int = 3600) -> DataFrame:
    """X1 over a table: adds ``allowed`` (replay in event-time order). With
    ``path_col``, requests to the exempt paths are allowed and not counted."""
    if path_col:
        exempt = F.coalesce(F.col(path_col).isin(*settings.rate_exempt_paths), F.lit(False))
        limited = rate_limit_flags(df.filter(~exempt), key, ts, order_col, settings, None, bucket_seconds)
        return limited.unionByName(df.filter(exempt).withColumn("allowed", F.lit(True)))
    limit, w_us = settings.rate_limit, settings.rate_window_seconds * US
    x = _segments(df.withColumn("_us", _micros(ts)), key, order_col, w_us, max(bucket_seconds * US, w_us))
    # secondary sort: every run of one client and segment lies in one partition,
    # in (time, id) order, and is replayed as the batches stream by
    run = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("\x00")), "_seg")
    x = x.withColumn("_run", run).repartition(key, "_seg").sortWithinPartitions(key, "_seg", "_us", order_col)
    out_schema = T.StructType([*x.schema.fields, T.StructField("allowed", T.BooleanType())])

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: list[int] = []
        current, last = None, None
        for pdf in batches:
            allowed = []
            for group, seg, t in zip(pdf["_run"].tolist(), pdf["_seg"].tolist(), pdf["_us"].tolist()):
                if (group, seg) != current:
                    current, state = (group, seg), []
                elif t < last:
                    raise RuntimeError("rate limiter input is not in event-time order")
                last = t
                flags, state = _limiter(limit, w_us, [t], state)
                allowed += flags
            yield pdf.assign(allowed=allowed)

    return x.mapInPandas(replay, out_schema).drop("_us", "_seg", "_run")


STATE_SCHEMA = "stamps array<long>"


def rate_limit_stream(stream: DataFrame, key: str = "client", ts: str = "ts", id_col: str = "event_id",
                      watermark: str = "1 hour", settings: Settings = DEFAULT, path_col: str | None = None) -> DataFrame:
    """Streaming limiter; output (id, key, ts, allowed) per request, with
    the input's types. Within a micro-batch a client's requests are replayed in
    event-time order; a request of a later batch is judged on arrival against
    the stamps that its own time has not expired, however it is ordered.
    Contract for late rows: rows older than the watermark are dropped by Spark
    and get no output (Spark counts them in the query progress as
    ``numRowsDroppedByWatermark``); choose ``watermark`` accordingly. With
    ``path_col``, requests to the exempt paths are allowed and not counted."""
    limit, w_us = settings.rate_limit, settings.rate_window_seconds * US
    exempt = F.coalesce(F.col(path_col).isin(*settings.rate_exempt_paths), F.lit(False)) if path_col else F.lit(False)
    src = stream.withWatermark(ts, watermark).select(id_col, key, ts, _micros(ts).alias("_us"), exempt.alias("_exempt"))

    def step(k, batches: Iterator[pd.DataFrame], state):
        if state.hasTimedOut:
            state.remove()
            return
        stamps = sorted(state.get[0]) if state.exists else []
        parts = list(batches)
        if not parts:
            return
        pdf = pd.concat(parts).sort_values(["_us", id_col], kind="stable")
        allowed = pdf["_exempt"].to_numpy(dtype=bool).copy()
        counted = ~allowed
        flags, stamps = _limiter(limit, w_us, pdf["_us"][counted].tolist(), stamps)
        allowed[counted] = flags
        state.update((stamps,))
        # idle clients are evicted once the watermark passes their last window;
        # a timeout must lie beyond the current watermark
        last = int(max([pdf["_us"].max(), *stamps[-1:]])) // 1000 + settings.rate_window_seconds * 1000
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))
        yield pdf.assign(allowed=allowed)[[id_col, key, ts, "allowed"]]

    out_schema = T.StructType([*[src.schema[c] for c in (id_col, key, ts)], T.StructField("allowed", T.BooleanType())])
    return src.groupBy(key).applyInPandasWithState(
        step, outputStructType=out_schema, stateStructType=STATE_SCHEMA,
        outputMode="append", timeoutConf=GroupStateTimeout.EventTimeTimeout)
