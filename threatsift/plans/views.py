"""Shared input views over the driver tables.

The same SQL text is run by Spark (over temp views of the parquet tables)
and inlined into the DuckDB oracle, so both sides read identical inputs.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

V_MESSAGES = (
    "SELECT d.doc_id AS msg_id, CASE WHEN d.doc_id % 3 = 0 THEN concat(d.text, ' See (', p.url, "
    "'). Or www.google.com/x?utm_source=a&id=', CAST(d.doc_id AS VARCHAR(20)), ';') "
    "WHEN d.doc_id % 3 = 1 THEN concat(d.text, ' Go to ', p.url, '!') ELSE d.text END AS text, "
    "d.source, d.lang, CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.toxic = 1 THEN 2 "
    "WHEN l.quality = 0 THEN 1 ELSE 0 END AS label FROM documents d "
    "JOIN pages p ON p.page_id = d.doc_id % (SELECT count(*) FROM pages) "
    "LEFT JOIN labels l ON l.doc_id = d.doc_id"
)

V_RAW_LABELS = (
    "SELECT doc_id, concat('src/', CASE WHEN doc_id % 5 = 0 THEN 'nazario_' ELSE '' END, source, '.csv') AS path, "
    "text, CASE doc_id % 8 WHEN 0 THEN ' Ham ' WHEN 1 THEN 'spam' WHEN 2 THEN 'Phishing Email' WHEN 3 THEN '1' "
    "WHEN 4 THEN '2.0' WHEN 5 THEN 'online' WHEN 6 THEN NULL ELSE 'safe' END AS raw_label FROM documents"
)

V_PREDS = (
    "SELECT doc_id AS msg_id, label_true, pred FROM (SELECT doc_id, CASE WHEN toxic = 1 THEN 2 "
    "WHEN quality = 0 THEN 1 ELSE 0 END AS label_true, CASE WHEN doc_id % 7 = 0 THEN doc_id % 3 "
    "WHEN toxic = 1 THEN 2 WHEN quality = 0 THEN 1 ELSE 0 END AS pred FROM labels) t"
)

V_REQUESTS = (
    "SELECT event_id, ts, user_id AS client, CASE WHEN event_type = 'view' THEN 'url' "
    "WHEN event_type = 'error' THEN 'sms' ELSE 'email' END AS input_type FROM events"
)

# Labelled corpus: documents with their class (toxic -> 2, low quality -> 1, else 0).
V_LABELLED = (
    "SELECT d.doc_id, d.text, CASE WHEN l.toxic = 1 THEN 2 WHEN l.quality = 0 THEN 1 ELSE 0 END AS label "
    "FROM documents d JOIN labels l ON l.doc_id = d.doc_id"
)

# Page URLs with a class: hosts that name an unwanted trade are 1.
V_URL_LABELS = (
    "SELECT page_id AS msg_id, url, CASE WHEN url LIKE '%casino%' OR url LIKE '%bets%' OR url LIKE '%pills%' OR url LIKE '%spam%' "
    "OR url LIKE '%ads-%' OR url LIKE '%adult%' THEN 1 ELSE 0 END AS label FROM pages"
)

VIEWS = {
    "v_url_labels": V_URL_LABELS,
    "v_messages": V_MESSAGES,
    "v_raw_labels": V_RAW_LABELS,
    "v_preds": V_PREDS,
    "v_requests": V_REQUESTS,
    "v_labelled": V_LABELLED,
}


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Temp views of the tables, remembered on the session itself (see
    ``session.spread`` for scans of few splits)."""
    from threatsift.session import table
    if getattr(spark, "_threatsift_tables", None) == sf_dir:
        return
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    spark._threatsift_tables = sf_dir


def messages_view(spark: SparkSession) -> DataFrame:
    """v_messages with the DataFrame API: the page count is taken once as a
    scalar (one count job) instead of a correlated-free scalar subquery in
    the join key; same rows as the SQL text."""
    from pyspark.sql import functions as F
    d, p, lab = spark.table("documents"), spark.table("pages"), spark.table("labels")
    n_pages = p.count()
    m = d.join(p.select("page_id", "url"), p["page_id"] == d["doc_id"] % F.lit(n_pages))
    r = d["doc_id"] % 3
    text = (F.when(r == 0, F.concat(d["text"], F.lit(" See ("), F.col("url"),
                                    F.lit("). Or www.google.com/x?utm_source=a&id="), d["doc_id"].cast("string"), F.lit(";")))
            .when(r == 1, F.concat(d["text"], F.lit(" Go to "), F.col("url"), F.lit("!")))
            .otherwise(d["text"]))
    m = m.join(lab.select(F.col("doc_id").alias("l_doc"), "quality", "toxic"), d["doc_id"] == F.col("l_doc"), "left")
    label = (F.when(F.col("l_doc").isNull(), F.lit(None).cast("int")).when(F.col("toxic") == 1, F.lit(2))
             .when(F.col("quality") == 0, F.lit(1)).otherwise(F.lit(0)))
    return m.select(d["doc_id"].alias("msg_id"), text.alias("text"), d["source"], d["lang"], label.alias("label"))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view (or a base table) as a DataFrame."""
    register_tables(spark, sf_dir)
    if name == "v_messages":
        return messages_view(spark)
    if name in VIEWS:
        return spark.sql(VIEWS[name])
    return spark.table(name)


def sub(name: str) -> str:
    """The view's text as an inline subquery for oracle SQL."""
    return f"({VIEWS[name]})"
