"""Queries for the prediction history."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatsift.operators import history as H
from threatsift.plans.catalog import query
from threatsift.plans.q_triage import oracle_triage_messages
from threatsift.plans.triage import triage_messages
from threatsift.plans.views import sub, view
from threatsift.session import fresh_path
from threatsift.settings import HISTORY_DEFAULT_LIMIT


def history_with_ts(spark, sf_dir):
    """History rows of the scored messages, logged at the time of the
    request event with the same id (1-second resolution)."""
    m = view(spark, sf_dir, "v_messages")
    ev = view(spark, sf_dir, "events").select(F.col("event_id").alias("msg_id"), "ts")
    inputs = m.select("msg_id", "text").join(ev, "msg_id", "left")
    return H.history_rows(triage_messages(inputs, carry=("text", "ts")), None, "email", "msg_id", "text", "ts")


def sql_history_ts() -> str:
    return (f"SELECT v.msg_id AS id, v.label AS prediction_label, v.confidence, v.is_phishing, "
            f"date_trunc('second', e.ts) AS ts FROM ({oracle_triage_messages()}) v "
            f"LEFT JOIN events e ON e.event_id = v.msg_id")


@query("history_latest", lambda: (
    f"SELECT id, prediction_label, confidence, strftime(ts, '%Y-%m-%d %H:%M:%S') AS logged_at FROM ({sql_history_ts()}) h "
    f"ORDER BY ts DESC NULLS LAST, id DESC LIMIT {HISTORY_DEFAULT_LIMIT}"))
def q_history_latest(spark, sf_dir):
    """The newest 100 history entries (ties on the second broken by id)."""
    latest = H.history_latest(history_with_ts(spark, sf_dir))
    return latest.select("id", "prediction_label", "confidence",
                         F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("logged_at"))


@query("history_windowed", lambda: (
    f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, prediction_label AS label, count(*) AS n "
    f"FROM ({sql_history_ts()}) h WHERE ts IS NOT NULL GROUP BY date_trunc('hour', ts), prediction_label"))
def q_history_windowed(spark, sf_dir):
    """X4 (batch form): verdict counts per tumbling hour."""
    h = history_with_ts(spark, sf_dir).filter(F.col("timestamp").isNotNull())
    w = H.windowed_counts(h)
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "label", "n")


LOGGED = ("id", "input_text", "input_type", "prediction_label", "confidence", "is_phishing", "reason")


def _logged(df):
    return df.select(*LOGGED, F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("logged_at"))


def _sql_logged() -> str:
    return (f"SELECT v.msg_id AS id, m.text AS input_text, 'email' AS input_type, v.label AS prediction_label, v.confidence, v.is_phishing, "
            f"v.reason, strftime(date_trunc('second', e.ts), '%Y-%m-%d %H:%M:%S') AS logged_at FROM ({oracle_triage_messages()}) v "
            f"JOIN {sub('v_messages')} m ON m.msg_id = v.msg_id LEFT JOIN events e ON e.event_id = v.msg_id")


@query("history_append", _sql_logged)
def q_history_append(spark, sf_dir):
    """K5: append scored messages to a history table; read it back."""
    path = fresh_path(spark, "history")
    H.append_history(history_with_ts(spark, sf_dir), path, "batch", 0)
    H.append_history(history_with_ts(spark, sf_dir), path, "batch", 0)  # a retried batch replaces itself
    return _logged(H.read_history(spark, path))


@query("history_clear", lambda: f"SELECT * FROM ({_sql_logged()}) h WHERE FALSE")
def q_history_clear(spark, sf_dir):
    """K6: clear a populated history table (same schema, no rows)."""
    path = fresh_path(spark, "history")
    H.append_history(history_with_ts(spark, sf_dir), path, "batch", 0)
    H.clear_history(spark, path)
    return _logged(H.read_history(spark, path))
