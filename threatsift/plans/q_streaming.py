"""Queries for sliding-window limits and streaming scoring."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from threatsift.operators import history as H
from threatsift.operators.history import read_history
from threatsift.plans.catalog import query
from threatsift.plans.q_history import history_with_ts, sql_history_ts
from threatsift.plans.views import sub, view
from threatsift.session import fresh_path
from threatsift.settings import Settings
from threatsift.streaming import eventtime as EV
from threatsift.streaming import ratelimit as RL
from threatsift.streaming.triage_stream import start_triage_stream

# events at these scales: ~150 clients over 30 days, so the limiter is
# exercised with 2 requests per day instead of 100 per minute
DAILY = Settings(rate_limit=2, rate_window_seconds=86400)


@query("trailing_request_count", lambda: (
    f"SELECT event_id, client, count(*) OVER (PARTITION BY client ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING "
    f"AND CURRENT ROW) AS trailing_count FROM {sub('v_requests')} r"))
def q_trailing_request_count(spark, sf_dir):
    """Requests per client in the trailing 60 s, accepted or not."""
    r = view(spark, sf_dir, "v_requests")
    return RL.trailing_request_count(r, "client", "ts", 60).select("event_id", "client", "trailing_count")


def _limiter_sql(requests: str | None = None) -> str:
    """Recursive replay: each iteration advances every client by one request
    (event-time order), carrying the accepted timestamps of the window."""
    w, lim = DAILY.rate_window_seconds * 1_000_000, DAILY.rate_limit
    kept = f"list_filter(r.acc, lambda t: e.us - t < {w})"
    return (
        f"WITH RECURSIVE ev AS (SELECT client, event_id, epoch_us(ts) AS us, row_number() OVER "
        f"(PARTITION BY client ORDER BY ts, event_id) AS rn FROM {requests or sub('v_requests')} q), "
        f"r(client, rn, event_id, allowed, acc) AS ("
        f"SELECT client, rn, event_id, TRUE, [us] FROM ev WHERE rn = 1 UNION ALL "
        f"SELECT e.client, e.rn, e.event_id, len({kept}) < {lim}, "
        f"CASE WHEN len({kept}) < {lim} THEN list_append({kept}, e.us) ELSE {kept} END "
        f"FROM r JOIN ev e ON e.client = r.client AND e.rn = r.rn + 1) "
        f"SELECT event_id, client, allowed FROM r")


@query("rate_limit_flags", _limiter_sql, headline=True)
def q_rate_limit_flags(spark, sf_dir):
    """Allowed / rejected per request by the sequential limiter."""
    r = view(spark, sf_dir, "v_requests")
    return RL.rate_limit_flags(r, "client", "ts", "event_id", DAILY).select("event_id", "client", "allowed")


@query("rate_limit_stream", _limiter_sql)
def q_rate_limit_stream(spark, sf_dir):
    """The limiter as streaming state over the events file."""
    schema = spark.read.parquet(os.path.join(sf_dir, "events.parquet")).schema
    src = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    src = src.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("client"))
    out = RL.rate_limit_stream(src, "client", "ts", "event_id", "2 days", DAILY)
    sink, ckpt = fresh_path(spark, "ratelimit"), fresh_path(spark, "ratelimit-ckpt")
    q = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt) \
        .outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(sink).select("event_id", "client", "allowed")


def _stream_sql() -> str:
    from threatsift.plans.q_triage import oracle_triage_messages, oracle_triage_urls
    v = oracle_triage_messages("(SELECT doc_id AS msg_id, text FROM documents) d")
    cols = "v.label AS prediction_label, v.confidence, v.is_phishing, v.reason"
    return (f"SELECT v.msg_id AS id, d.text AS input_text, 'email' AS input_type, {cols} "
            f"FROM ({v}) v JOIN documents d ON d.doc_id = v.msg_id UNION ALL "
            f"SELECT v.msg_id, p.url, 'url', {cols} FROM ({oracle_triage_urls()}) v JOIN pages p ON p.page_id = v.msg_id")


@query("triage_stream", _stream_sql)
def q_triage_stream(spark, sf_dir):
    """Requests of both input types arriving as a stream of several
    micro-batches, scored and appended to the history table."""
    docs = view(spark, sf_dir, "documents").select(F.col("doc_id").alias("msg_id"), "text", F.lit("email").alias("input_type"))
    pages = view(spark, sf_dir, "pages").select(F.col("page_id").alias("msg_id"), F.col("url").alias("text"), F.lit("url").alias("input_type"))
    arriving = fresh_path(spark, "triage-requests")
    docs.unionByName(pages).write.parquet(arriving)
    src = spark.readStream.schema("msg_id long, text string, input_type string").option("maxFilesPerTrigger", 4).parquet(arriving)
    hist, ckpt = fresh_path(spark, "triage-history"), fresh_path(spark, "triage-ckpt")
    q = start_triage_stream(src, hist, ckpt, type_col="input_type")
    q.awaitTermination()
    # the log's wall-clock timestamp is left out so the rows are comparable
    return read_history(spark, hist).drop("batch", "timestamp")


# Arrival of rows out of order, in units of an hour (requests) or a minute (history):
# most come up to 48 units after their time, three in a hundred 360 after it. The
# arrivals are cut into four batches; the watermark waits 72 units.
BATCHES, DELAY, LONG, SLOT_SECONDS = 4, 72, 360, 21600
HOUR, MINUTE = 3600, 60


def _arrivals(df, id_col: str, ts: str, unit: int):
    """Adds ``_batch``, the batch (0 to 3) in which a row arrives."""
    h = F.pmod(F.col(id_col) * 7919, F.lit(100))
    units = F.when(h < 3, F.lit(LONG)).otherwise(F.floor(h / 2))
    df = df.withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp")) + units * F.lit(unit * RL.US))
    lo, hi = df.agg(F.min("_at"), F.max("_at")).first()
    if lo is None:  # no row with a time
        return df.withColumn("_batch", F.lit(0)).drop("_at")
    batch = F.expr(f"least({BATCHES - 1}, ((_at - {lo}L) * {BATCHES}) div {hi - lo + 1}L)")
    return df.withColumn("_batch", batch.cast("int")).drop("_at")


def _arrivals_sql(src: str, id_col: str, unit: int) -> str:
    """The same, with ``wm``: the watermark in microseconds when the row arrives
    (the latest time of the batches before, less the delay; 0 at first)."""
    delay = DELAY * unit * 1000
    return (f"(WITH a AS (SELECT *, epoch_us(ts) AS us, epoch_us(ts) + (CASE WHEN ({id_col} * 7919) % 100 < 3 THEN {LONG} "
            f"ELSE ({id_col} * 7919) % 100 // 2 END) * {unit * 1_000_000} AS at_us FROM ({src}) s), "
            f"k AS (SELECT *, least({BATCHES - 1}, (at_us - min(at_us) OVER ()) * {BATCHES} "
            f"// (max(at_us) OVER () - min(at_us) OVER () + 1)) AS batch FROM a), "
            f"w AS (SELECT batch AS wb, greatest(0, coalesce(max(max(us) // 1000 - {delay}) OVER "
            f"(ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * 1000 AS wm FROM k GROUP BY batch) "
            f"SELECT k.*, wm FROM k JOIN w ON wb = batch)")


def _events_sql() -> str:
    slot = SLOT_SECONDS * 1_000_000
    rows = _arrivals_sql(f"SELECT * FROM {sub('v_requests')} v", "event_id", HOUR)
    late = f"(us // {slot} + 1) * {slot} <= wm"
    judged = _limiter_sql(f"(SELECT event_id, client, ts FROM {rows} r WHERE NOT ({late}))")
    return (f"SELECT event_id, client, allowed, FALSE AS late FROM ({judged}) j UNION ALL "
            f"SELECT event_id, client, NULL, TRUE FROM {rows} r WHERE {late}")


@query("rate_limit_events", _events_sql)
def q_rate_limit_events(spark, sf_dir):
    """X2 in event-time order: requests arriving shuffled over several
    micro-batches, each in a query started anew on the same checkpoint; late
    ones are kept apart. A time mark closes the last slots."""
    r = _arrivals(view(spark, sf_dir, "v_requests").select("event_id", "client", F.col("ts").cast("timestamp").alias("ts")), "event_id", "ts", HOUR)
    src, sink, ckpt = (fresh_path(spark, f"ratelimit-events-{n}") for n in ("in", "out", "ckpt"))
    mark = r.agg((F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"))
    mark = mark.select(F.lit(None).cast("long").alias("event_id"), F.lit(None).cast(r.schema["client"].dataType).alias("client"), "ts")
    for k in range(BATCHES + 1):
        arriving = mark if k == BATCHES else r.filter(F.col("_batch") == k).drop("_batch")
        arriving.write.mode("append").parquet(src)
        stream = spark.readStream.schema(mark.schema).parquet(src)
        EV.start_rate_limit(stream, sink, ckpt, watermark=f"{DELAY} hours", slot_seconds=SLOT_SECONDS, settings=DAILY).awaitTermination()
    schema = mark.schema.add("allowed", "boolean").add("late", "boolean")
    return EV.read_judged(spark, sink, schema).select("event_id", "client", "allowed", "late")


def _windowed_stream_sql() -> str:
    hour = 3_600_000_000
    rows = _arrivals_sql(f"SELECT * FROM ({sql_history_ts()}) h WHERE ts IS NOT NULL", "id", MINUTE)
    end = f"(us // {hour} + 1) * {hour}"
    return (f"WITH r AS {rows} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, prediction_label AS label, "
            f"count(*) AS n FROM r WHERE {end} > wm AND {end} <= (SELECT max(us) // 1000 * 1000 FROM r) - {DELAY * MINUTE * 1_000_000} "
            f"GROUP BY ALL")


@query("history_windowed_stream", _windowed_stream_sql)
def q_history_windowed_stream(spark, sf_dir):
    """X4 as a stream: the history grows by batches whose entries are out of
    order; every window is written once, when the watermark has closed it."""
    staged, log, sink, ckpt = (fresh_path(spark, f"history-stream-{n}") for n in ("rows", "log", "out", "ckpt"))
    history_with_ts(spark, sf_dir).filter(F.col("timestamp").isNotNull()).write.parquet(staged)
    rows = _arrivals(spark.read.parquet(staged), "id", "timestamp", MINUTE)
    for k in range(BATCHES):
        H.append_history(rows.filter(F.col("_batch") == k).drop("_batch"), log, "log", k)
        H.start_windowed_counts(H.stream_history(spark, log), sink, ckpt, watermark=f"{DELAY} minutes").awaitTermination()
    out = spark.read.schema(H.WINDOWED_SCHEMA).parquet(sink)
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "label", "n")
