"""Queries for request validation (Q1-Q4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatsift.operators import quality as Q
from threatsift.plans import sqltext as S
from threatsift.plans.catalog import query
from threatsift.plans.views import sub, view
from threatsift.settings import MAX_BATCH_SIZE, MAX_PAYLOAD_BYTES

REQ = sub("v_requests")


@query("input_type_check", lambda: (
    f"SELECT event_id, input_type, CASE WHEN input_type IS NULL OR input_type NOT IN ('email', 'url') "
    f"THEN 'input_type must be email or url' END AS error FROM {REQ} r"))
def q_input_type_check(spark, sf_dir):
    """Q1: request type must be email or url (error column, no exception)."""
    r = view(spark, sf_dir, "v_requests")
    return r.select("event_id", "input_type", Q.input_type_error(F.col("input_type")).alias("error"))


@query("request_check", lambda: (
    f"SELECT r.event_id, r.input_type, CASE WHEN r.input_type IS NULL OR r.input_type NOT IN ('email', 'url') "
    f"THEN 'input_type must be email or url' WHEN d.doc_id IS NULL OR d.text IS NULL THEN 'text is required' END AS error "
    f"FROM {REQ} r LEFT JOIN documents d ON d.doc_id = r.event_id"))
def q_request_check(spark, sf_dir):
    """Q1: the whole request check, type and text; a request whose document is
    missing or NULL has no text (an empty text is a text)."""
    r = view(spark, sf_dir, "v_requests")
    # only a mark of the text crosses the join
    d = view(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), F.when(F.col("text").isNotNull(), F.lit("")).alias("text"))
    j = r.join(d, "event_id", "left")
    return j.select("event_id", "input_type", Q.input_type_error(F.col("input_type"), F.col("text")).alias("error"))


@query("batch_size_check", lambda: (
    f"SELECT client, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00:00') AS batch_hour, count(*) AS n_items, "
    f"count(*) >= 1 AND count(*) <= {MAX_BATCH_SIZE} AS valid FROM {REQ} r GROUP BY client, date_trunc('hour', ts)"))
def q_batch_size_check(spark, sf_dir):
    """Q2: a client's requests in one hour form a batch of 1..32 items."""
    r = view(spark, sf_dir, "v_requests").withColumn(
        "batch_hour", F.date_format(F.date_trunc("hour", F.col("ts").cast("timestamp")), "yyyy-MM-dd HH:00:00"))
    return Q.batch_sizes(r, ["client", "batch_hour"])


@query("payload_size_check", lambda: (
    f"SELECT msg_id, strlen(text) AS n_bytes, coalesce(strlen(text), 0) <= {MAX_PAYLOAD_BYTES} AS ok FROM {sub('v_messages')} m"))
def q_payload_size_check(spark, sf_dir):
    """Q3: UTF-8 payload size within the 5 MB limit."""
    m = view(spark, sf_dir, "v_messages")
    return m.select("msg_id", F.octet_length("text").alias("n_bytes"), Q.payload_ok("text").alias("ok"))


@query("blank_check", lambda: (
    f"SELECT conv_id, turn, coalesce(length({S.strip('text')}) = 0, TRUE) AS is_blank FROM conversations"))
def q_blank_check(spark, sf_dir):
    """Q4: blank inputs (filtered before scoring in the UI path)."""
    c = view(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", Q.is_blank("text").alias("is_blank"))
