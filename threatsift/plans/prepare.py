"""Corpus preparation (entry A): raw files to canonical, deduplicated tables.

Emails: route, exclude, tolerant load, resolve columns, map and relabel, first
occurrence per text, shuffle. URLs: the same with ranked lists, blocklists and
threat feeds, plus a class-balanced table. The position of a row is taken at
the scan, so "first" means the order of (path, row) whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatsift.operators import clean as C
from threatsift.operators import sample as SM
from threatsift.settings import DEFAULT, EMAIL_LABEL_MAP, URL_LABEL_MAP, Settings
from threatsift.sources import corpus as SRC

ORDER = ["path", "row_pos"]


def _files(spark: SparkSession, root: str, kind: str) -> list[str]:
    """Paths of one kind that are not excluded: file names, not contents."""
    rows = SRC.list_corpus(spark, root).filter((F.col("kind") == kind) & ~F.col("excluded")).select("path").collect()
    return sorted(r["path"] for r in rows)


def _named(paths: list[str]) -> list[tuple[str, str]]:
    """(path, lowercase source name): the file's name, or for a part file of a
    written dataset the folder's."""
    out = []
    for p in paths:
        parts = p.rstrip("/").split("/")
        name = parts[-2] if parts[-1].startswith("part-") and len(parts) > 1 else parts[-1]
        out.append((p, name.lower()))
    return out


def _labelled(df: DataFrame, header: str, rename: str) -> tuple[DataFrame, str, str]:
    """The two resolved columns of a group under fixed names."""
    names = SRC.column_names(header)
    text, label = C.resolve_columns(names, C.distinct_counts_of(df.select(*names)))
    return df.select(F.col(text).alias(rename), F.col(label).alias("label"), *ORDER), rename, "label"


def prepare_email_corpus(spark: SparkSession, root: str) -> DataFrame:
    """(text, label, path, row_pos) of the first occurrence of every text."""
    frames = []
    blocks = SRC.CsvBlocks(spark, _files(spark, root, "email"))
    for header, paths in SRC.header_groups(spark, blocks.paths, blocks).items():
        df = SRC.read_group(spark, paths, header, blocks)
        if len(SRC.column_names(header)) == 1:      # a list of phishing mails
            only = SRC.column_names(header)[0]
            frames.append(df.select(F.lower(F.col(only)).alias("text"), F.lit(2).alias("label"), *ORDER).dropna(subset=["text"]))
        else:
            frames.append(C.canonical_email(*_labelled(df, header, "text"), "path", EMAIL_LABEL_MAP))
    if not frames:
        return spark.createDataFrame([], "text string, label int, path string, row_pos long")
    return C.dedup_first(C.union_sources(frames), "text", ORDER, ["text", "label", *ORDER])


def prepare_url_corpus(spark: SparkSession, root: str, label_override: dict[str, int] | None = None) -> DataFrame:
    """(url, label, path, row_pos) of the first occurrence of every URL.

    ``label_override`` gives the label of sources whose own label column cannot
    be mapped (part of the file name -> label), e.g. a feed whose status column
    says online / offline and which would otherwise add no rows.
    """
    overrides = {k.lower(): v for k, v in (label_override or {}).items()}
    ranked: dict[str, list[str]] = {"majestic": [], "tranco": []}
    plain: list[str] = []
    forced: dict[str, int] = {}
    blocks = SRC.CsvBlocks(spark, _files(spark, root, "url"))
    for path, name in _named(blocks.paths):
        if "majestic" in name:
            ranked["majestic"].append(path)
        elif "tranco" in name or "top-1m" in name:
            ranked["tranco"].append(path)
        else:
            plain.append(path)
            forced.update({path: v for k, v in overrides.items() if k in name})
    frames = [SRC.ranked_list(spark, paths, kind, blocks).select(F.lower("url").alias("url"), "label", *ORDER).dropna(subset=["url"])
              for kind, paths in ranked.items() if paths]
    for label in [None, *sorted(set(forced.values()))]:
        mine = [p for p in plain if forced.get(p) == label]
        for header, paths in SRC.header_groups(spark, mine, blocks).items():
            df = SRC.read_group(spark, paths, header, blocks)
            names = SRC.column_names(header)
            if label is not None or len(names) == 1:
                url = names[0] if len(names) == 1 else C.resolve_columns(names)[0]
                value = F.lit(1 if label is None else label)
                frames.append(df.select(F.lower(F.col(url)).alias("url"), value.alias("label"), *ORDER).dropna(subset=["url"]))
            else:
                frames.append(C.canonical_url(*_labelled(df, header, "url"), URL_LABEL_MAP))
    if not frames:
        return spark.createDataFrame([], "url string, label int, path string, row_pos long")
    return C.dedup_first(C.union_sources(frames), "url", ORDER, ["url", "label", *ORDER])


def write_corpora(spark: SparkSession, root: str, target: str, settings: Settings = DEFAULT) -> None:
    """K1: writes ``url_cleaned_unbalanced``, ``url_cleaned`` (balanced) and
    ``email_cleaned`` (shuffled) below ``target``. Every table is read back from
    what was written before it, so the raw files are read once."""
    base = target.rstrip("/")
    prepare_url_corpus(spark, root).select("url", "label").write.mode("overwrite").parquet(f"{base}/url_cleaned_unbalanced")
    urls = spark.read.parquet(f"{base}/url_cleaned_unbalanced")
    SM.balance_undersample(urls, "url", seed=settings.seed).drop("rank").write.mode("overwrite").parquet(f"{base}/url_cleaned")
    emails = prepare_email_corpus(spark, root).select(F.md5("text").alias("text_md5"), "text", "label")
    shuffled = emails.withColumn("_h", SM.seeded_hash("text_md5", settings.seed)).orderBy("_h", "text_md5")
    shuffled.select("text", "label").write.mode("overwrite").parquet(f"{base}/email_cleaned")
