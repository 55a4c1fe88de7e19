"""Raw corpus sources and sinks.

Readers return DataFrames with string columns plus the source path (from
``_metadata.file_path``) and the position of the row in its scan. The driver
sees file names and first lines only.
"""

from __future__ import annotations

import csv
import functools
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatsift.operators.clean import is_excluded, route_source
from threatsift.settings import MAX_UPLOAD_BYTES, THREAT_FEED_HEADER, THREAT_FEED_SCAN_LINES
from threatsift.sources.split_csv import CsvBlocks, csv_records, plain_path

RECORD = "_record"


# ---------------------------------------------------------------- S1

def list_corpus(spark: SparkSession, root: str, glob: str = "*.csv") -> DataFrame:
    """Every matching file below ``root`` (recursive) with its size, route
    (url / email) and exclusion flag. A listing: no content is read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
             .select(plain_path(F.col("path")).alias("path"), "length"))
    kind = route_source(F.col("path"))
    excluded = F.when(kind == "url", is_excluded(F.col("path"), "url")).otherwise(is_excluded(F.col("path"), "email"))
    return files.select("path", "length", kind.alias("kind"), excluded.alias("excluded"))


def first_lines(spark: SparkSession, path: str, n: int = 1) -> list[str]:
    """The first ``n`` lines of one file; a limit on the scan, so no more of the
    file is read than they need."""
    rows = spark.read.option("lineSep", "\n").text(path).limit(n).collect()
    lines = [r["value"].rstrip("\r") for r in rows]
    return [lines[0].lstrip("\ufeff"), *lines[1:]] if lines else []


def _below_store(path: str) -> str:
    """A path without scheme and host: listings and scans spell these differently."""
    return re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path)


def header_groups(spark: SparkSession, paths: list[str], blocks: CsvBlocks | None = None) -> dict[str, list[str]]:
    """Paths grouped by their header (one read per group): the first line, or
    for a threat feed the commented header within its first lines. All headers
    come from the one job that looked at the files' blocks. Files without a
    header line are left out."""
    groups: dict[str, list[str]] = {}
    heads = {_below_store(p): lines for p, lines in (blocks or CsvBlocks(spark, paths)).heads().items()}
    for path in paths:
        lines = heads.get(_below_store(path), [])
        if lines and lines[0].startswith("#"):
            lines = [x for x in lines[:THREAT_FEED_SCAN_LINES] if x.strip().startswith(THREAT_FEED_HEADER)][:1]
        if lines:
            groups.setdefault(lines[0].lstrip("\ufeff"), []).append(path)
    return groups


def column_names(header: str) -> list[str]:
    """Names of a header line; a repeated name gets a numbered suffix, so the
    first column of that name keeps it."""
    names = [c.strip() for c in next(csv.reader([header.lstrip("#")]), [])]
    return [c if c not in names[:i] else f"{c}__{i}" for i, c in enumerate(names)]


# ---------------------------------------------------------------- S2

def field_count(record: Column) -> Column:
    """Fields of a raw CSV record: commas outside quoted stretches, plus one (a
    doubled quote is two stretches side by side)."""
    bare = F.regexp_replace(record, '"[^"]*+"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def tolerant_csv(spark: SparkSession, paths, columns: list[str], header: bool = True, feed: bool = False,
                 blocks: CsvBlocks | None = None) -> DataFrame:
    """Rows with too MANY fields are skipped, short rows are kept
    null-filled, undecodable bytes are tolerated. The parser flags every record
    whose field count differs; the flagged ones are counted. Adds ``path`` and
    ``row_pos``, which grows along each file. Every file is read by as many
    tasks as it has blocks (``split_csv``); ``blocks`` is the job that looked at
    them, if there was one. A ``feed`` has comment lines and blanks around fields."""
    files = [paths] if isinstance(paths, str) else list(paths)
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in [*columns, RECORD])
    trim = str(feed).lower()
    options = {"escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": RECORD, "multiLine": "true",
               "ignoreLeadingWhiteSpace": trim, "ignoreTrailingWhiteSpace": trim}
    records = csv_records(blocks or CsvBlocks(spark, files), files, feed, header)
    r = records.select(F.from_csv("record", schema, options).alias("_c"), "path", "row_pos")
    few = F.col(f"_c.{RECORD}").isNull() | (field_count(F.col(f"_c.{RECORD}")) <= len(columns))
    return r.where(few).select(*[F.col("_c")[c].alias(c) for c in columns], "path", "row_pos")


def read_group(spark: SparkSession, paths: list[str], header: str, blocks: CsvBlocks | None = None) -> DataFrame:
    """One header group by the tolerant rules, all columns string."""
    if header.startswith("#"):
        return threat_feed_rows(spark, paths, column_names(header), blocks)
    return tolerant_csv(spark, paths, column_names(header), blocks=blocks)


# ---------------------------------------------------------------- S3

def threat_feed_header(spark: SparkSession, path: str, scan_lines: int = THREAT_FEED_SCAN_LINES) -> list[str] | None:
    """Column names from the '# id,dateadded,url,...' line within the first
    lines of a feed."""
    for line in first_lines(spark, path, scan_lines):
        if line.strip().startswith(THREAT_FEED_HEADER):
            return column_names(line.strip())
    return None


def threat_feed_rows(spark: SparkSession, paths, columns: list[str], blocks: CsvBlocks | None = None) -> DataFrame:
    """Rows below the comment block, by the tolerant rules, fields trimmed."""
    return tolerant_csv(spark, paths, columns, header=False, feed=True, blocks=blocks)


def threat_feed_csv(spark: SparkSession, path: str) -> DataFrame:
    """S3: comment block skipped, schema from the commented header line; a file
    without one is read as a plain CSV."""
    columns = threat_feed_header(spark, path)
    if columns is None:
        return read_group(spark, [path], first_lines(spark, path)[0])
    return threat_feed_rows(spark, path, columns)


def write_threat_feed(df: DataFrame, path: str, columns: list[str], preamble: list[str]) -> None:
    """Writes feed files: a comment preamble, the commented header, then quoted
    CSV rows. The row text is built by built-in functions; every file starts
    with the preamble because it is part of its first row."""
    def cell(c: str) -> Column:
        return F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))

    head = "\n".join([*[f"# {p}" for p in preamble], "# " + ",".join(columns)]) + "\n"
    line = F.concat_ws(",", *[cell(c) for c in columns])
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0     # first row of a partition
    df.select(F.when(first, F.concat(F.lit(head), line)).otherwise(line).alias("value")).write.mode("overwrite").text(path)


# ---------------------------------------------------------------- S4 / S5

def ranked_list(spark: SparkSession, path, kind: str = "tranco", blocks: CsvBlocks | None = None) -> DataFrame:
    """Ranked domain lists are legitimate (label 0). 'majestic' lists have a
    header with a Domain column, each file its own; 'tranco' / 'top-1m' are
    header-less rank,domain files (the first domain is kept)."""
    if kind == "majestic":
        files = [path] if isinstance(path, str) else list(path)
        blocks = blocks or CsvBlocks(spark, files)
        groups = header_groups(spark, files, blocks)
        parts = [tolerant_csv(spark, paths, column_names(header), blocks=blocks).select(F.col("Domain").alias("url"), "path", "row_pos")
                 for header, paths in groups.items()]
        r = functools.reduce(DataFrame.unionByName, parts) if parts else tolerant_csv(spark, [], ["url"], blocks=blocks)
    else:
        r = tolerant_csv(spark, path, ["rank", "url"], header=False, blocks=blocks)
    return r.select("url", F.lit(0).alias("label"), "path", "row_pos")


def blocklist(spark: SparkSession, path: str, label: int = 1, header: bool = True) -> DataFrame:
    """Single-column list; every row is positive (URL 1, email 2). A quoted
    item may span lines; rows of several fields are skipped."""
    r = tolerant_csv(spark, path, ["text"], header=header)
    return r.select("text", F.lit(label).alias("label"), "path", "row_pos")


# ---------------------------------------------------------------- S6-S8

def label_column_scan(spark: SparkSession, path: str, label_col: str, fmt: str = "parquet") -> DataFrame:
    """Read only the label column (pruned at the scan)."""
    return spark.read.format(fmt).option("header", "true").load(path).select(label_col)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """One item per line, stripped, blanks dropped."""
    from threatsift.functions.text import py_strip
    r = spark.read.option("lineSep", "\n").text(path).select(py_strip(F.col("value")).alias("item"))
    return r.filter(F.length("item") > 0)


def csv_column(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One chosen column, NULLs dropped, as strings."""
    r = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    return r.select(F.col(column).cast("string").alias("item")).dropna()


# ---------------------------------------------------------------- S9

W_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _run_text(node) -> str:
    """Text of a paragraph's runs in order: tabs and breaks included, the
    paragraphs of embedded boxes not."""
    out = []
    for child in node:
        tag = child.tag.removeprefix(W_NS)
        if tag == "t":
            out.append(child.text or "")
        elif tag == "tab":
            out.append("\t")
        elif tag in ("br", "cr"):
            out.append("\n")
        elif tag in ("r", "hyperlink", "ins", "smartTag", "sdt", "sdtContent"):
            out.append(_run_text(child))
    return "".join(out)


def docx_paragraph_texts(data: bytes) -> list[str]:
    """Texts of the paragraphs of a .docx body (not those of table cells)."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    body = root.find(f"{W_NS}body")
    return [_run_text(p) for p in body.findall(f"{W_NS}p")] if body is not None else []


def docx_paragraphs(spark: SparkSession, path: str, max_bytes: int | None = MAX_UPLOAD_BYTES) -> DataFrame:
    """S9 for every .docx below ``path``, see ``docx_rows``."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
             .select("path", "content", "length"))
    return docx_rows(files, max_bytes)


def docx_rows(files: DataFrame, max_bytes: int | None = MAX_UPLOAD_BYTES) -> DataFrame:
    """(path, para_idx, text, error) from rows (path, content, length): stripped,
    non-blank paragraphs. A file that cannot be read, or is longer than
    ``max_bytes``, is one row with its error and no text."""
    limit = F.lit(max_bytes if max_bytes is not None else (1 << 62))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"]):
                try:
                    if content is None:
                        raise ValueError("file too large")
                    kept = [t for t in (x.strip() for x in docx_paragraph_texts(bytes(content))) if t]
                    rows += [(p, i, t, None) for i, t in enumerate(kept)]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError) as e:
                    rows.append((p, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "para_idx", "text", "error"]).astype({"para_idx": "Int32"})

    sized = files.select("path", F.when(F.col("length") <= limit, F.col("content")).alias("content"))
    return sized.mapInPandas(parse, "path string, para_idx int, text string, error string")


def docx_bytes(paragraphs: list[str]) -> bytes:
    """A minimal .docx holding the given paragraphs."""
    def esc(s):
        return (s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))

    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{esc(p)}</w:t></w:r></w:p>' for p in paragraphs)
    doc = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
           '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">'
           f"<w:body>{body}</w:body></w:document>")
    ct = ('<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
          '<Default Extension="xml" ContentType="application/xml"/>'
          '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/>'
          "</Types>")
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", ct)
        z.writestr("word/document.xml", doc)
    return buf.getvalue()


def docx_table(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """(path, content): one .docx per row (paragraph = line) as bytes."""
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            content = [docx_bytes(re.split(r"\r\n|\r|\n", t or "")) for t in pdf["t"]]
            yield pd.DataFrame({"path": [f"{k}.docx" for k in pdf["k"]], "content": content})

    return df.select(F.col(key).alias("k"), F.col(text_col).alias("t")).mapInPandas(build, "path string, content binary")


# ---------------------------------------------------------------- K1-K3

def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """K1/K2/K3: overwrite a table (optionally partitioned, e.g. by split)."""
    w = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = w.option("header", "true").option("escape", '"')
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
