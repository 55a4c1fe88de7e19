"""SQL-callable forms of the text and URL functions (survey section 2.11).

``register(spark)`` creates session functions so the same operators work from
``spark.sql``:

* ``ts_html_to_text(html)``: the general HTML converter (stdlib parser, full
  entity table) as an Arrow-batched pandas UDF;
* SQL functions (``CREATE TEMPORARY FUNCTION ... RETURN``), pure Spark SQL, so
  they run in the JVM: ``ts_strip``, ``ts_is_html``, ``ts_extract_urls``,
  ``ts_prepare_url``, ``ts_url_part``, ``ts_recode_path``,
  ``ts_strip_tracking``, ``ts_normalize_url``, ``ts_url_domain``,
  ``ts_allowlisted``.

They mirror the Column functions in ``text.py`` / ``urls.py`` (tested equal).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from threatsift.functions.text import URL_PATTERN, URL_TRAILING, html_to_text_udf
from threatsift.functions.urls import (
    IPV6_PATTERN,
    IPVFUTURE_PATTERN,
    REPLACEMENT,
    SPLIT_PATTERN,
    STRAY_PERCENT,
    SURROGATE_BYTES,
    delimiter_lookalikes,
)
from threatsift.settings import DEFAULT, PY_WS_CHARS, USES_NETLOC, Settings


def _q(s: str) -> str:
    """A raw SQL string literal (no escape processing)."""
    if "'" in s:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return "r'" + s + "'"


def _in(values) -> str:
    return ", ".join(_q(v) for v in values)


def definitions(settings: Settings = DEFAULT) -> list[str]:
    ws = "".join(f"\\u{ord(c):04x}" for c in PY_WS_CHARS)  # escaped (non-raw) literal
    stray = _q(STRAY_PERCENT)
    def enc_q(x):
        return f"replace(replace(url_encode({x}), '*', '%2A'), '%7E', '~')"

    def whole(x):
        return f"regexp_replace(regexp_replace({x}, {_q(SURROGATE_BYTES)}, '{REPLACEMENT * 3}'), {stray}, '%25')"

    def dec(x):
        return f"url_decode({whole(x)})"

    key = "substring_index(s, '=', 1)"
    val = "CASE WHEN instr(s, '=') > 0 THEN substring(s, instr(s, '=') + 1) ELSE '' END"
    tracking = " AND ".join([f"NOT lower(p.k) IN ({_in(settings.tracking_keys)})"]
                            + [f"NOT startswith(lower(p.k), {_q(pre)})" for pre in settings.tracking_prefixes])
    return [
        f"CREATE OR REPLACE TEMPORARY FUNCTION ts_strip(s STRING) RETURNS STRING RETURN trim(BOTH '{ws}' FROM s)",
        "CREATE OR REPLACE TEMPORARY FUNCTION ts_is_html(s STRING) RETURNS BOOLEAN "
        "RETURN contains(lower(s), '<html') OR contains(s, '</')",
        "CREATE OR REPLACE TEMPORARY FUNCTION ts_extract_urls(s STRING) RETURNS ARRAY<STRING> RETURN "
        f"transform(regexp_extract_all(coalesce(s, ''), {_q(URL_PATTERN)}, 0), u -> regexp_replace(u, {_q(URL_TRAILING)}, ''))",
        "CREATE OR REPLACE TEMPORARY FUNCTION ts_explode_urls(s STRING) RETURNS TABLE (url_pos INT, url STRING) RETURN "
        "SELECT pos, col FROM (SELECT posexplode(u) FROM (SELECT ts_extract_urls(s) AS u))",
        "CREATE OR REPLACE TEMPORARY FUNCTION ts_prepare_url(u STRING) RETURNS STRING RETURN "
        "regexp_replace(regexp_replace(CASE WHEN startswith(lower(ts_strip(u)), 'www.') "
        "THEN concat('https://', lower(ts_strip(u))) ELSE lower(ts_strip(u)) END, "
        r"r'^[\x{0}-\x{20}]+', ''), r'[\t\r\n]', '')",
        "CREATE OR REPLACE TEMPORARY FUNCTION ts_url_part(x STRING, i INT) RETURNS STRING RETURN "
        f"regexp_extract(x, {_q(SPLIT_PATTERN)}, i)",
        "CREATE OR REPLACE TEMPORARY FUNCTION ts_recode_path(p STRING) RETURNS STRING RETURN "
        "replace(replace(replace(replace(replace(replace(url_encode(url_decode(replace("
        f"{whole('p')}, '+', '%2B'))), '+', '%20'), '*', '%2A'), '%7E', '~'), "
        "'%2F', '/'), '%3A', ':'), '%25', '%')",
        "CREATE OR REPLACE TEMPORARY FUNCTION ts_strip_tracking(q STRING) RETURNS STRING RETURN array_join(transform(filter("
        "transform(filter(split(q, '&'), s -> s != ''), s -> named_struct("
        f"'k', {dec(key)}, 'v', {dec(val)})), "
        f"p -> {tracking}), p -> concat({enc_q('p.k')}, '=', {enc_q('p.v')})), '&')",
        "CREATE OR REPLACE TEMPORARY FUNCTION ts_bad_netloc(n STRING) RETURNS BOOLEAN RETURN "
        "(contains(n, '[') != contains(n, ']')) OR (contains(n, '[') AND NOT ("
        rf"regexp_extract(n, r'^[^\[]*\[([^\]]*)', 1) RLIKE {_q(IPV6_PATTERN)} OR "
        rf"regexp_extract(n, r'^[^\[]*\[([^\]]*)', 1) RLIKE {_q(IPVFUTURE_PATTERN)})) "
        f"OR n RLIKE {_q(delimiter_lookalikes())}",
        "CREATE OR REPLACE TEMPORARY FUNCTION ts_assemble(sc STRING, n STRING, p STRING, q STRING) RETURNS STRING RETURN "
        "concat(sc, ':', CASE WHEN n != '' THEN concat('//', n, CASE WHEN p = '' OR startswith(p, '/') THEN p ELSE concat('/', p) END) "
        "WHEN startswith(p, '//') THEN concat('//', p) "
        f"WHEN sc IN ({_in(USES_NETLOC)}) AND (p = '' OR startswith(p, '/')) THEN concat('//', p) ELSE p END, "
        "CASE WHEN q != '' THEN concat('?', q) ELSE '' END)",
        "CREATE OR REPLACE TEMPORARY FUNCTION ts_normalize_prepared(x STRING) RETURNS STRING RETURN "
        "CASE WHEN x IS NULL OR ts_bad_netloc(ts_url_part(x, 2)) THEN NULL ELSE ts_assemble("
        "CASE WHEN ts_url_part(x, 1) = '' THEN 'https' ELSE ts_url_part(x, 1) END, ts_url_part(x, 2), "
        "ts_recode_path(ts_url_part(x, 3)), ts_strip_tracking(ts_url_part(x, 4))) END",
        "CREATE OR REPLACE TEMPORARY FUNCTION ts_normalize_url(u STRING) RETURNS STRING RETURN "
        "ts_normalize_prepared(ts_prepare_url(u))",
        "CREATE OR REPLACE TEMPORARY FUNCTION ts_url_domain(n STRING) RETURNS STRING RETURN "
        "replace(ts_url_part(n, 2), 'www.', '')",
        "CREATE OR REPLACE TEMPORARY FUNCTION ts_allowlisted(d STRING) RETURNS BOOLEAN RETURN "
        f"coalesce(d IN ({_in(settings.safe_domains)}), false)",
    ]


def register(spark: SparkSession, settings: Settings = DEFAULT) -> list[str]:
    """Create the session functions; returns their names."""
    spark.udf.register("ts_html_to_text", html_to_text_udf)
    names = ["ts_html_to_text"]
    for stmt in definitions(settings):
        spark.sql(stmt)
        names.append(stmt.split("FUNCTION ")[1].split("(")[0])
    return names
