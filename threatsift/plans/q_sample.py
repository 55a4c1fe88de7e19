"""Queries for seeded shuffling, balancing and stratified splitting
(C10-C12, split_leakage, M6) over the labelled document corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatsift.operators import sample as SM
from threatsift.plans.catalog import query
from threatsift.plans.views import sub, view
from threatsift.settings import SEED

LAB = sub("v_labelled")


def _rows(spark, sf_dir):
    """Whole-row dedup of (text, label) on the text digest (only 32-byte
    digests are shuffled, never texts); the key digest|label is unique. The
    small result is checkpointed once: counts, offsets and ranks all read it."""
    from threatsift.session import cut_lineage
    d = view(spark, sf_dir, "v_labelled").select(F.md5("text").alias("text_md5"), "label").dropDuplicates()
    d = d.select("text_md5", "label", F.concat(F.col("text_md5"), F.lit("|"), F.col("label").cast("string")).alias("row_key"))
    return cut_lineage(d)


SQL_ROWS = (f"(SELECT text_md5, label, concat(text_md5, '|', CAST(label AS VARCHAR)) AS row_key "
            f"FROM (SELECT DISTINCT md5(text) AS text_md5, label FROM {LAB} l) d) r")


def sql_rank(partition: str | None) -> str:
    part = f"PARTITION BY {partition} " if partition else ""
    return f"row_number() OVER ({part}ORDER BY md5(concat(row_key, '|{SEED}')), row_key)"


@query("seeded_shuffle", lambda: f"SELECT text_md5, label, {sql_rank(None)} AS shuffle_pos FROM {SQL_ROWS}")
def q_seeded_shuffle(spark, sf_dir):
    """Deterministic whole-table shuffle (seed 42) with positions."""
    return SM.seeded_shuffle(_rows(spark, sf_dir), "row_key").select("text_md5", "label", "shuffle_pos")


def _sql_balance() -> str:
    return (f"SELECT text_md5, label, rk AS rank FROM (SELECT *, {sql_rank('label')} AS rk FROM {SQL_ROWS}) t "
            f"WHERE rk <= (SELECT min(n) FROM (SELECT count(*) AS n FROM {SQL_ROWS} GROUP BY label) c)")


@query("balance_undersample", _sql_balance, headline=True)
def q_balance_undersample(spark, sf_dir):
    """C11: exactly min-class-count rows of every class."""
    return SM.balance_undersample(_rows(spark, sf_dir), "row_key").select("text_md5", "label", "rank")


def _split_sql(rows: str = SQL_ROWS, id_col: str = "text_md5") -> str:
    # quotas are computed from class counts exactly as split_quotas does
    counts = f"(SELECT label, count(*) AS n FROM {rows} GROUP BY label)"
    tot = f"(SELECT sum(n) AS n FROM {counts} c0)"
    # train allocation: floor + largest remainders (ties: lowest label)
    train = (f"(SELECT label, n, fl + CASE WHEN rnk <= need THEN 1 ELSE 0 END AS q FROM ("
             f"SELECT c.label, c.n, floor(c.n * t.ntrain / t.n) AS fl, "
             f"t.ntrain - sum(floor(c.n * t.ntrain / t.n)) OVER () AS need, "
             f"row_number() OVER (ORDER BY (c.n * t.ntrain / t.n) - floor(c.n * t.ntrain / t.n) DESC, c.label) AS rnk "
             f"FROM {counts} c, (SELECT n, n - CAST(ceil(0.3 * n) AS BIGINT) AS ntrain FROM {tot} t1) t) a)")
    temp = f"(SELECT label, n - q AS n, q AS q_train FROM {train} tr)"
    val = (f"(SELECT label, q_train, fl + CASE WHEN rnk <= need THEN 1 ELSE 0 END AS q_val FROM ("
           f"SELECT c.label, c.q_train, floor(c.n * t.nval / t.n) AS fl, "
           f"t.nval - sum(floor(c.n * t.nval / t.n)) OVER () AS need, "
           f"row_number() OVER (ORDER BY (c.n * t.nval / t.n) - floor(c.n * t.nval / t.n) DESC, c.label) AS rnk "
           f"FROM {temp} c, (SELECT n, n - CAST(ceil(0.5 * n) AS BIGINT) AS nval FROM (SELECT sum(n) AS n FROM {temp} x) y) t) a)")
    ranked = f"(SELECT *, {sql_rank('label')} AS rk FROM {rows})"
    return (f"SELECT r.{id_col}, r.label, r.rk AS rank, CASE WHEN r.rk <= q.q_train THEN 'train' "
            f"WHEN r.rk <= q.q_train + q.q_val THEN 'validation' ELSE 'test' END AS split "
            f"FROM {ranked} r JOIN {val} q ON q.label = r.label")


@query("stratified_split", _split_sql, headline=True)
def q_stratified_split(spark, sf_dir):
    """70/15/15 stratified split with exact per-class counts."""
    return SM.stratified_split(_rows(spark, sf_dir), "row_key").select("text_md5", "label", "rank", "split")


@query("split_counts", lambda: f"SELECT split, label, count(*) AS n_rows FROM ({_split_sql()}) s GROUP BY split, label")
def q_split_counts(spark, sf_dir):
    """Rows per (split, label): the sizes C12 guarantees."""
    s = SM.stratified_split(_rows(spark, sf_dir), "row_key")
    return s.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n_rows"))


@query("split_leakage", lambda: (
    f"WITH s AS ({_split_sql()}) SELECT text_md5, label, split FROM s WHERE split = 'train' "
    f"AND text_md5 IN (SELECT text_md5 FROM s WHERE split <> 'train')"))
def q_split_leakage(spark, sf_dir):
    """Training rows whose text also lands in validation/test (the same text
    under two labels survives whole-row dedup)."""
    s = SM.stratified_split(_rows(spark, sf_dir), "row_key").select("text_md5", "label", "split")
    return SM.split_leakage(s, "text_md5")


@query("class_weights", lambda: (
    f"SELECT label, n_rows, round(CAST(sum(n_rows) OVER () AS DOUBLE) / (count(*) OVER () * n_rows), 6) AS weight "
    f"FROM (SELECT label, count(*) AS n_rows FROM {LAB} l GROUP BY label) c"))
def q_class_weights(spark, sf_dir):
    """M6: inverse-frequency class weights n / (k * count)."""
    w = SM.class_weights(view(spark, sf_dir, "v_labelled"))
    return w.select("label", "n_rows", F.round("weight", 6).alias("weight"))
