"""Text, HTML and word functions as native Column expressions.

All are built-in functions; those with array lambdas (URL extraction, words)
run interpreted inside the JVM, the others in whole-stage codegen. Only HTML
that is not simple markup crosses into Python, through an Arrow-batched UDF.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatsift.settings import PY_WS_CHARS, PY_WS_CLASS

WS = f"[{PY_WS_CLASS}]"

# URL pattern of the message parser: http(s):// or www., up to whitespace,
# angle brackets or double quote; trailing ) . , ; ] are trimmed afterwards.
URL_PATTERN = rf'(?i)https?://[^{PY_WS_CLASS}<>"]+|www\.[^{PY_WS_CLASS}<>"]+'
URL_TRAILING = r"[).,;\]]+\z"
# UI variant: also stops at a single quote and keeps trailing punctuation.
UI_URL_PATTERN = rf"""(?i)(?:https?://|www\.)[^{PY_WS_CLASS}<>"']+"""

# Entities the JVM form decodes, '&amp;' last (fixed values); a value with any
# other goes to the parser, which knows all of them.
NATIVE_ENTITIES = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&nbsp;", " "),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&amp;", "&"),
)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a variable (a
    one-element ``transform``); Spark does not share subexpressions inside
    CASE branches, so this keeps staged work from being recomputed."""
    return F.element_at(F.transform(F.array(value), body), 1)


def py_strip(c) -> Column:
    """str.strip(): remove leading/trailing Unicode whitespace. Uses trim with
    an explicit character set, which only touches the two ends (a regex
    anchored at the end would scan the whole text)."""
    return F.trim(_c(c), F.lit(PY_WS_CHARS))


def collapse_ws(c) -> Column:
    """' '.join(s.split()): runs of whitespace become one space, then strip."""
    return py_strip(F.regexp_replace(_c(c), f"{WS}+", " "))


def trim_input(c, lowercase: bool = False) -> Column:
    """Strip; lowercase for the email path."""
    out = py_strip(c)
    return F.lower(out) if lowercase else out


def is_html(c) -> Column:
    """T2: '<html' in any case, or a closing tag marker."""
    x = _c(c)
    return F.lower(x).contains("<html") | x.contains("</")


# Markup whose meaning does not depend on parser state: script and style
# up to their end tag, comments without angle brackets or a double hyphen,
# declarations, and tags whose attribute values hold no angle brackets. All
# repetitions of groups are bounded (the regex engine recurses on them).
def _simple_raw(tag: str) -> str:
    return rf"""(?i)<{tag}(?:\s[^<>"'`]*+(?:"[^"<>]*+"[^<>"'`]*+){{0,50}})?>[^<]*+(?:<(?!/\s*{tag})[^<]*+){{0,200}}+</{tag}>"""


_SIMPLE_COMMENT = r"<!--(?!>)(?!->)[^<>-]*+(?:-(?!-)[^<>-]*+){0,200}+-->"
_SIMPLE_DECLARATION = r"(?i)<!doctype [^<>\"']*>"
_SIMPLE_TAG = (r"""(?i)</?(?!(?:script|style)\b)[a-z][a-z0-9]*+"""
               r"""(?:\s++[a-z][a-z0-9-]*+(?:="[^"<>]*+"|='[^'<>]*+')?+){0,100}+\s*+/?>""")
_SIMPLE_STEPS = (_simple_raw("script"), _simple_raw("style"), _SIMPLE_COMMENT, _SIMPLE_DECLARATION, _SIMPLE_TAG)


def _without_simple_markup(x: Column) -> Column:
    for pattern in _SIMPLE_STEPS:
        x = F.regexp_replace(x, pattern, " ")
    return x


def simple_html_to_text(c) -> Column:
    """T1 in the JVM, or NULL: when removing simple markup and the entities of
    the native table leaves no '<', '>' or '&', the result equals the parser's."""
    def convert(stripped):
        rest, text = stripped, stripped
        for ent, ch in NATIVE_ENTITIES:
            rest = F.replace(rest, F.lit(ent), F.lit(""))
            text = F.replace(text, F.lit(ent), F.lit(ch))
        return F.when(~rest.rlike("[<>&]"), collapse_ws(text))
    return let(_without_simple_markup(_c(c)), convert)


class _Visible(HTMLParser):
    """Text outside script and style, which the parser itself tracks as its
    raw-text state; character references are decoded by the parser."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_data(self, data: str) -> None:
        if self.cdata_elem not in ("script", "style"):
            self.found.append(data)


def visible_text(markup: str | None) -> str | None:
    """T1 of one document by the HTML rules (any markup, all entities)."""
    if markup is None:
        return None
    page = _Visible()
    page.feed(markup)
    page.close()
    return " ".join(word for part in page.found for word in part.split())


@F.pandas_udf(T.StringType())
def html_to_text_udf(s: pd.Series) -> pd.Series:
    """T1, Arrow-batched; one parser per value."""
    return s.map(visible_text, na_action="ignore")


def html_to_text(c) -> Column:
    """Visible text with entities decoded and whitespace collapsed. Simple
    markup is converted in the JVM; only the other values reach the parser (the
    rest pass it as nulls)."""
    x = _c(c)
    native = simple_html_to_text(x)
    return F.coalesce(native, html_to_text_udf(F.when(native.isNull(), x)))


def clean_message(c) -> Column:
    """HTML-to-text when the value looks like HTML, then collapse
    whitespace and strip."""
    x = _c(c)
    html = is_html(x)
    native = F.when(html, simple_html_to_text(x)).otherwise(x)
    return collapse_ws(F.coalesce(native, html_to_text_udf(F.when(native.isNull(), x))))


def may_contain_url(x: Column) -> Column:
    """Cheap pre-test: a URL match needs 'http' or 'www.' in some case."""
    return F.ilike(x, F.lit("%http%")) | F.ilike(x, F.lit("%www.%"))


def extract_urls(c) -> Column:
    """T4: ordered list of URLs in the text; NULL text gives []. Texts
    without 'http' / 'www.' skip the regex scan."""
    x = F.coalesce(_c(c), F.lit(""))
    found = F.regexp_extract_all(x, F.lit(URL_PATTERN), 0)
    urls = F.transform(found, lambda u: F.regexp_replace(u, URL_TRAILING, ""))
    return F.when(may_contain_url(x), urls).otherwise(F.array().cast("array<string>"))


def extract_urls_ui(c) -> Column:
    """UI variant of the extractor (stops at quotes, no trailing trim)."""
    return F.regexp_extract_all(F.coalesce(_c(c), F.lit("")), F.lit(UI_URL_PATTERN), 0)


def route_input(c) -> Column:
    """No whitespace and a URL prefix -> 'url', else 'email'."""
    x = py_strip(c)
    return F.when(
        ~x.rlike(WS) & F.lower(x).rlike(r"^(https?://|www\.)"), F.lit("url")
    ).otherwise(F.lit("email"))


WORD_SPLIT = r"[^\p{L}\p{N}_]+"


def all_words(c, already_lower: bool = False) -> Column:
    """Word-character runs of the lowercased text (split once, no regex
    word boundaries, whose Unicode meaning differs between engines)."""
    x = F.coalesce(_c(c), F.lit(""))
    return F.split(x if already_lower else F.lower(x), WORD_SPLIT)


def words(c) -> Column:
    """P5: lowercase words of three or more ASCII letters, in order."""
    return F.filter(all_words(c), lambda w: w.rlike("^[a-z]{3,}$"))


def whitespace_words(c) -> Column:
    """Number of whitespace-separated words (str.split())."""
    x = collapse_ws(F.coalesce(_c(c), F.lit("")))
    return F.when(x == "", F.lit(0)).otherwise(F.size(F.split(x, " ")))


def char_count(c, ch: str) -> Column:
    """Occurrences of a single character."""
    x = F.coalesce(_c(c), F.lit(""))
    return F.length(x) - F.length(F.replace(x, F.lit(ch), F.lit("")))


def substring_count(c, needle: str) -> Column:
    """Non-overlapping occurrences of a literal substring."""
    x = F.coalesce(_c(c), F.lit(""))
    return ((F.length(x) - F.length(F.replace(x, F.lit(needle), F.lit("")))) / F.lit(len(needle))).cast("long")
