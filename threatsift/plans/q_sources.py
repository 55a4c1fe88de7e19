"""Queries for sources and sinks.

Each query first writes files derived from the driver tables into a fresh
folder below the shared work folder, then reads them back with the library's
readers, so the work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from threatsift.operators import sample as SM
from threatsift.plans import prepare as PREP
from threatsift.plans import sqltext as S
from threatsift.plans.catalog import query
from threatsift.plans.q_clean import sql_map_label, sql_relabel
from threatsift.plans.views import sub, view
from threatsift.session import fresh_path
from threatsift.settings import EMAIL_LABEL_MAP, SEED, URL_LABEL_MAP
from threatsift.sources import corpus as SRC

# Raw corpora derived from the tables. Bodies hold line breaks, commas and
# doubled quotes; the same text comes under several labels (also in one file);
# some records have too many fields, the last ones empty.
BODY = ("concat(text, CASE WHEN doc_id % 4 = 0 THEN concat(chr(10), 'said \"yes, ok\"') WHEN doc_id % 4 = 1 THEN ', \"' ELSE '' END)")
REPEATED = f"SELECT doc_id, doc_id * 2 AS ord, path, {BODY} AS body, raw_label FROM {sub('v_raw_labels')} r"
AGAIN = (f"SELECT doc_id, doc_id * 2 + 1, path, {BODY}, CASE WHEN raw_label = 'spam' THEN 'ham' ELSE 'spam' END "
         f"FROM {sub('v_raw_labels')} r2 WHERE doc_id % 3 = 0")
SOURCE = "regexp_extract(path, '([^/]*)[.]csv$', 1)"
RAW_MAILS = f"SELECT doc_id, ord, {SOURCE} AS file, body, raw_label FROM ({REPEATED} UNION ALL {AGAIN}) raw_mails"


def _write_per_file(df, path, file_col, order_col):
    """CSV files per value of ``file_col``, one per range of ``order_col``; their
    names sort in row order, as part numbers follow the ranges."""
    w = df.repartitionByRange(F.col(file_col), F.col(order_col)).sortWithinPartitions(file_col, order_col).drop(order_col)
    w.write.mode("overwrite").option("header", "true").option("escape", '"').partitionBy(file_col).csv(path)


def _write_raw_lines(df, path, line, header):
    """Lines as they are, below a header (for records a CSV writer would mend)."""
    (df.select(line.alias(header)).write.mode("overwrite").option("header", "true").option("sep", "\u0001")
     .option("escapeQuotes", "false").csv(path))


def _write_email_corpus(spark, sf_dir, root):
    view(spark, sf_dir, "documents")
    mails = spark.sql(RAW_MAILS)
    _write_per_file(mails.select("file", "ord", "body", "raw_label"), f"{root}/email datasets/corpora", "file", "ord")
    bench = view(spark, sf_dir, "benchmark").select(F.concat(F.col("text"), F.lit("\nsecond, line")).alias("body"))
    SRC.write_table(bench, f"{root}/email datasets/fraud_list", "csv")
    docs = view(spark, sf_dir, "documents")
    line = F.concat(F.lit("long "), F.col("doc_id"), F.when(F.col("doc_id") % 2 == 0, F.lit(",spam,,")).otherwise(F.lit(",spam")))
    _write_raw_lines(docs.where("doc_id % 5 = 0"), f"{root}/email datasets/zz_records", line, "body,label")


def _sql_email_corpus() -> str:
    name = "concat('corpora/file=', file)"
    lab = sql_relabel(sql_map_label("raw_label", EMAIL_LABEL_MAP), "concat('x/', file)")
    rows = (f"SELECT {name} AS src, ord, lower(body) AS text, {lab} AS label FROM ({RAW_MAILS}) m UNION ALL "
            f"SELECT 'fraud_list', item_id, lower(concat(text, chr(10), 'second, line')), 2 FROM benchmark UNION ALL "
            f"SELECT 'zz_records', doc_id, concat('long ', doc_id), 1 FROM documents WHERE doc_id % 5 = 0 AND doc_id % 2 = 1")
    return (f"SELECT text, label FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY src, ord) AS rn FROM ({rows}) c "
            f"WHERE text IS NOT NULL AND label IS NOT NULL) d WHERE rn = 1")


@query("corpus_scan", lambda: f"SELECT md5(text) AS text_md5, label FROM ({_sql_email_corpus()}) e", headline=True)
def q_corpus_scan(spark, sf_dir):
    """S1 (+R1, R2, R4, S2, S5, C1-C8): scan a raw CSV corpus built from the
    tables and prepare the canonical, deduplicated email table."""
    root = fresh_path(spark, "raw")
    _write_email_corpus(spark, sf_dir, root)
    return PREP.prepare_email_corpus(spark, root).select(F.md5("text").alias("text_md5"), "label")


URL_ROWS = ("SELECT page_id, url, CASE page_id % 5 WHEN 0 THEN 'phishing' WHEN 1 THEN ' Benign ' WHEN 2 THEN '1' "
            "WHEN 3 THEN 'unheard of' ELSE 'legitimate' END AS kind FROM pages")


def _write_url_corpus(spark, sf_dir, root):
    view(spark, sf_dir, "pages")
    base = f"{root}/url datasets"
    rows = spark.sql(URL_ROWS)
    marked = rows.select(F.lit("a").alias("file"), "page_id", F.concat("url", F.lit('?q="x, y"')).alias("url"), F.col("kind").alias("type"))
    _write_per_file(marked, f"{base}/marked_urls", "file", "page_id")
    ranked = rows.where("page_id % 4 = 0").select(F.col("page_id").cast("string").alias("r"), F.concat(F.lit("D"), "page_id", F.lit(".ORG")).alias("d"))
    ranked.write.mode("overwrite").option("header", "false").csv(f"{base}/tranco_list")
    top = rows.where("page_id % 4 = 1").select(F.col("page_id").alias("GlobalRank"), F.concat(F.lit("d"), F.col("page_id") - 1, F.lit(".org")).alias("Domain"))
    SRC.write_table(top, f"{base}/majestic_million", "csv")
    SRC.write_table(rows.where("page_id % 3 = 0").select(F.concat("url", F.lit('?q="x, y"')).alias("link")), f"{base}/zz_blocked", "csv")
    _write_raw_lines(rows.where("page_id % 6 = 0"), f"{base}/zzz_records",
                     F.concat(F.lit("http://r/"), F.col("page_id"), F.when(F.col("page_id") % 12 == 0, F.lit(",phishing,,")).otherwise(F.lit(",phishing"))),
                     "url,verified")
    feed = F.concat_ws(",", F.col("page_id"), F.lit("2024-01-01"), F.concat(F.lit('"http://feed/'), "page_id", F.lit('?q=""a"""')), F.lit("online"))
    _write_raw_lines(rows, f"{base}/feed", feed, "# id,dateadded,url,url_status")


def _sql_url_corpus() -> str:
    u = "lower(concat(url, '?q=\"x, y\"'))"
    rows = (f"SELECT 'marked_urls' AS src, page_id AS ord, {u} AS url, {sql_map_label('kind', URL_LABEL_MAP)} AS label FROM ({URL_ROWS}) p "
            f"UNION ALL SELECT 'tranco_list', page_id, concat('d', page_id, '.org'), 0 FROM pages WHERE page_id % 4 = 0 "
            f"UNION ALL SELECT 'majestic_million', page_id, concat('d', page_id - 1, '.org'), 0 FROM pages WHERE page_id % 4 = 1 "
            f"UNION ALL SELECT 'zz_blocked', page_id, {u}, 1 FROM pages WHERE page_id % 3 = 0 "
            f"UNION ALL SELECT 'zzz_records', page_id, concat('http://r/', page_id), 1 FROM pages WHERE page_id % 6 = 0 AND page_id % 12 <> 0")
    return (f"SELECT url, label FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY src, ord) AS rn FROM ({rows}) c "
            f"WHERE url IS NOT NULL AND label IS NOT NULL) d WHERE rn = 1")


@query("corpus_scan_url", _sql_url_corpus)
def q_corpus_scan_url(spark, sf_dir):
    """URL half of the preparation: labelled sets, ranked lists, blocklists,
    a feed (whose online / offline labels map to nothing) and records with too
    many fields; first occurrence per URL."""
    root = fresh_path(spark, "raw-urls")
    _write_url_corpus(spark, sf_dir, root)
    return PREP.prepare_url_corpus(spark, root).select("url", "label")


@query("tolerant_csv", lambda: "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, source FROM documents")
def q_tolerant_csv(spark, sf_dir):
    """Documents as quoted multi-line CSV, read back with the
    too-many-fields rule."""
    path = fresh_path(spark, "docs-csv")
    docs = view(spark, sf_dir, "documents").select(F.col("doc_id").cast("string"), "text", "source")
    SRC.write_table(docs, path, "csv")
    return SRC.tolerant_csv(spark, path, ["doc_id", "text", "source"]).select("doc_id", "text", "source")


@query("threat_feed_csv", lambda: "SELECT CAST(page_id AS VARCHAR) AS id, '2024-01-01' AS dateadded, url, 'online' AS url_status FROM pages")
def q_threat_feed_csv(spark, sf_dir):
    """S3: page URLs as feed files with a comment preamble and a commented
    header line; read back with the header-driven schema."""
    path = fresh_path(spark, "feed")
    pages = view(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("2024-01-01").alias("dateadded"),
                                                 "url", F.lit("online").alias("url_status"))
    SRC.write_threat_feed(pages, path, ["id", "dateadded", "url", "url_status"], ["threat feed", "generated from pages"])
    return SRC.threat_feed_csv(spark, path).select("id", "dateadded", "url", "url_status")


def _sql_hosts() -> str:
    from threatsift.plans import sqltext as S
    return f"SELECT DISTINCT {S.url_part('lower(url)', 2)} AS url, 0 AS label FROM pages"


@query("ranked_list_source", _sql_hosts)
def q_ranked_list_source(spark, sf_dir):
    """Page hosts as a header-less rank,domain list (tranco form)."""
    from threatsift.functions.urls import url_netloc
    path = fresh_path(spark, "tranco")
    hosts = view(spark, sf_dir, "pages").select(url_netloc(F.col("url")).alias("domain")).groupBy("domain").count()
    ranked = SM.hash_rank(hosts, "domain", None, out="rank").select(F.col("rank").cast("string"), "domain")
    ranked.write.mode("overwrite").option("header", "false").csv(path)
    return SRC.ranked_list(spark, path, "tranco").select("url", "label")


@query("blocklist_source", lambda: "SELECT url AS text, 1 AS label FROM pages")
def q_blocklist_source(spark, sf_dir):
    """Page URLs as a single-column blocklist; every row positive."""
    path = fresh_path(spark, "blocklist")
    SRC.write_table(view(spark, sf_dir, "pages").select("url"), path, "csv")
    return SRC.blocklist(spark, path, label=1).select("text", "label")


@query("pruned_label_scan", lambda: f"SELECT raw_label, count(*) AS n_rows FROM {sub('v_raw_labels')} r GROUP BY raw_label")
def q_pruned_label_scan(spark, sf_dir):
    """Label counts reading only the label column of a written table."""
    path = fresh_path(spark, "raw-labels")
    SRC.write_table(view(spark, sf_dir, "v_raw_labels"), path)
    return SRC.label_column_scan(spark, path, "raw_label").groupBy("raw_label").agg(F.count(F.lit(1)).alias("n_rows"))


def _sql_lines() -> str:
    from threatsift.plans import sqltext as S
    return (f"SELECT {S.strip('l')} AS item FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents) t "
            f"WHERE length({S.strip('l')}) > 0")


@query("text_line_source", _sql_lines)
def q_text_line_source(spark, sf_dir):
    """Document texts written as text files, read one item per line."""
    path = fresh_path(spark, "lines")
    view(spark, sf_dir, "documents").select("text").write.mode("overwrite").text(path)
    return SRC.text_lines(spark, path)


@query("csv_column_source", lambda: "SELECT url AS item FROM pages WHERE url IS NOT NULL")
def q_csv_column_source(spark, sf_dir):
    """One chosen column of an uploaded CSV."""
    path = fresh_path(spark, "pages-csv")
    SRC.write_table(view(spark, sf_dir, "pages").select("page_id", "url"), path, "csv")
    return SRC.csv_column(spark, path, "url")


def _sql_paragraphs() -> str:
    from threatsift.plans import sqltext as S
    lines = ("SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS l FROM "
             "(SELECT doc_id, string_split_regex(text, '\\r\\n|\\r|\\n') AS ls FROM documents) d")
    return (f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS para_idx, "
            f"{S.strip('l')} AS text FROM ({lines}) x WHERE length({S.strip('l')}) > 0")


@query("docx_paragraph_source", _sql_paragraphs)
def q_docx_paragraph_source(spark, sf_dir):
    """Every document as a Word file (one paragraph per line) in a table of
    files, read back paragraph by paragraph; the id comes from the file name."""
    path = fresh_path(spark, "docx")
    SRC.docx_table(view(spark, sf_dir, "documents"), "doc_id", "text").write.mode("overwrite").parquet(path)
    files = spark.read.parquet(path)
    p = SRC.docx_rows(files.withColumn("length", F.octet_length("content"))).where(F.col("error").isNull())
    return p.select(F.regexp_extract("path", r"([0-9]+)\.docx$", 1).cast("long").alias("doc_id"), "para_idx", "text")


def _sql_canonical_sink() -> str:
    urls, mails = f"({_sql_url_corpus()})", f"({_sql_email_corpus()})"
    least = f"(SELECT min(n) FROM (SELECT count(*) AS n FROM {urls} u2 GROUP BY label) m)"
    return (f"SELECT 'url_cleaned_unbalanced' AS \"table\", md5(url) AS key_md5, label FROM {urls} a UNION ALL "
            f"SELECT 'url_cleaned', md5(url), label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat(url, '|{SEED}')), url) "
            f"AS rk FROM {urls} b) c WHERE rk <= {least} UNION ALL SELECT 'email_cleaned', md5(text), label FROM {mails} d")


@query("canonical_sink", _sql_canonical_sink)
def q_canonical_sink(spark, sf_dir):
    """K1: the three tables of the preparation written and read back: URLs
    unbalanced and balanced, emails in seeded order."""
    root, base = fresh_path(spark, "raw-both"), fresh_path(spark, "canonical")
    _write_email_corpus(spark, sf_dir, root)
    _write_url_corpus(spark, sf_dir, root)
    PREP.write_corpora(spark, root, base)
    out = None
    for name, key in (("url_cleaned_unbalanced", "url"), ("url_cleaned", "url"), ("email_cleaned", "text")):
        t = spark.read.parquet(f"{base}/{name}").select(F.lit(name).alias("table"), F.md5(key).alias("key_md5"), "label")
        out = t if out is None else out.unionByName(t)
    return out


def _sql_split_sink() -> str:
    from threatsift.plans.q_sample import _split_sql
    rows = f"(SELECT doc_id, label, CAST(doc_id AS VARCHAR) AS row_key FROM {sub('v_labelled')} l) r0"
    return f"SELECT doc_id, label, split FROM ({_split_sql(rows, 'doc_id')}) s"


@query("split_sink", _sql_split_sink)
def q_split_sink(spark, sf_dir):
    """K2: stratified splits written partitioned by split, read back."""
    path = fresh_path(spark, "splits")
    from threatsift.session import cut_lineage
    d = view(spark, sf_dir, "v_labelled").select("doc_id", "text", "label")
    keys = cut_lineage(d.select("doc_id", "label", F.col("doc_id").cast("string").alias("row_key")))
    split = SM.stratified_split(keys, "row_key").select("doc_id", "split")
    # ranks are taken on keys; the texts join the finished split once
    SRC.write_table(d.join(split, "doc_id"), path, partition_by=["split"])
    return spark.read.parquet(path).select("doc_id", "label", "split")
