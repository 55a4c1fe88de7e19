"""Token counts of whole texts, huge documents by overlap resynchronisation.

One narrow pass: id and text go to Arrow batches, three numbers come back.
Documents longer than a chunk are encoded chunk by chunk (see ``tokens.py``),
so the memory of a task is two chunks' ids whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatsift.llm import tokens

TOKEN_LIMIT = 512


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = TOKEN_LIMIT,
                 chunk: int = tokens.CHUNK_CHARS, overlap: int = tokens.OVERLAP_CHARS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, repeated rows
    included. Needs doc_id and text; other columns are ignored. A null or empty
    text has no bytes and no tokens. An empty table gives an empty result."""
    path = tokenizer or tokens.default_tokenizer()
    schema = docs.select("doc_id", F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        for b in batches:
            counts = [enc.count(t.as_py(), chunk, overlap) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(counts, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return (rows.mapInArrow(run, schema)
            .withColumn("over_limit", F.col("n_tokens") > F.lit(limit)))
