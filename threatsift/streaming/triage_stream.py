"""Streaming scoring (X3): arriving messages -> verdicts -> history table.

The batch transform (``triage_messages`` or ``triage_requests``) runs unchanged on each micro-batch
inside ``foreachBatch``; its per-message grouping is local to the batch. Each
batch is appended idempotently under its (query id, batch id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatsift.operators.history import append_history, history_rows
from threatsift.plans.triage import triage_messages, triage_requests
from threatsift.settings import DEFAULT, Settings


def start_triage_stream(stream: DataFrame, history_path: str, checkpoint: str, key: str = "msg_id",
                        text_col: str = "text", ts_col: str | None = None, type_col: str | None = None,
                        available_now: bool = True, settings: Settings = DEFAULT, email_scorer=None, url_scorer=None):
    """Start the query; returns the StreamingQuery. With ``type_col`` the stream
    holds requests of both input types, else every row is a message."""

    def process(batch: DataFrame, batch_id: int) -> None:
        carry = (text_col, *([ts_col] if ts_col else []))
        # the input text and time ride along with the verdict (no join back)
        if type_col:
            inputs = batch.select(key, type_col, *carry)
            verdicts = triage_requests(inputs, email_scorer, url_scorer, text_col, key, type_col, None, settings, (*carry, type_col))
            rows = history_rows(verdicts, None, F.col(type_col), key, text_col, ts_col)
        else:
            verdicts = triage_messages(batch.select(key, *carry), email_scorer, url_scorer, text_col, key, settings, carry=carry)
            rows = history_rows(verdicts, None, F.lit("email"), key, text_col, ts_col)
        append_history(rows, history_path, "triage", batch_id)

    w = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
