"""URL splitting, normalisation and domain extraction as native expressions.

The normaliser follows the stdlib semantics the scoring path relies on
(``urlsplit`` / ``unquote`` / ``quote`` / ``parse_qsl`` / ``urlencode`` /
``urlunsplit`` of Python 3.13), but is written with Spark built-ins only: no
Python worker is involved. Stages are bound once with ``let`` so the split
regex and decoding run once per URL.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from threatsift.functions.text import let, py_strip
from threatsift.settings import DEFAULT, USES_NETLOC, Settings

# RFC 3986 appendix-B style split, with the stdlib's scheme rule (letters
# first, then letters/digits/+/-/.); applied to lowercased input.
SPLIT_PATTERN = r"(?s)^(?:([a-z][a-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"
STRAY_PERCENT = r"%(?![0-9a-fA-F]{2})"
SURROGATE_BYTES = r"(?i)%ed%[ab][0-9a-f]%[89ab][0-9a-f]"
REPLACEMENT = "%EF%BF%BD"


def _ipv6_pattern() -> str:
    """IPv6address of RFC 3986 (section 3.2.2), built from its grammar, plus
    an optional zone id; lowercase hex (input is lowercased)."""
    h16 = "[0-9a-f]{1,4}"
    dec = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    ipv4 = rf"{dec}(?:\.{dec}){{3}}"
    ls32 = f"(?:{h16}:{h16}|{ipv4})"
    forms = [f"(?:{h16}:){{6}}{ls32}", f"::(?:{h16}:){{5}}{ls32}"]
    for k in range(0, 7):  # [ *k( h16 ":" ) h16 ] "::" ...
        pre = f"(?:(?:{h16}:){{0,{k}}}{h16})?" if k else f"(?:{h16})?"
        tail = {0: f"(?:{h16}:){{4}}{ls32}", 1: f"(?:{h16}:){{3}}{ls32}", 2: f"(?:{h16}:){{2}}{ls32}",
                3: f"{h16}:{ls32}", 4: ls32, 5: h16, 6: ""}[k]
        forms.append(f"{pre}::{tail}")
    return "^(?:" + "|".join(forms) + ")(?:%[^%]+)?\\z"


IPV6_PATTERN = _ipv6_pattern()
IPVFUTURE_PATTERN = r"^v[0-9a-f]+\..+\z"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _part(x: Column, idx: int) -> Column:
    return F.regexp_extract(x, SPLIT_PATTERN, idx)


BARE_HOST = r"^(?:[^/?#:@\s\[\]]+\.)+[a-z]{2,}(?::[0-9]+)?(?:[/?#]|$)"


def prepare(c, bare_host: bool = False) -> Column:
    """strip + lowercase, 'www.' gets https:// (with ``bare_host``, so does a
    dotted host without a scheme, port or not), then the splitter's own
    cleaning (leading C0/space removed, tab/CR/LF dropped)."""
    x = F.lower(py_strip(c))
    hostlike = x.startswith("www.") | x.rlike(BARE_HOST) if bare_host else x.startswith("www.")
    x = F.when(hostlike, F.concat(F.lit("https://"), x)).otherwise(x)
    x = F.regexp_replace(x, r"^[\x{0}-\x{20}]+", "")
    return F.regexp_replace(x, r"[\t\r\n]", "")


def split_url(c) -> Column:
    """struct(scheme, netloc, path, query, fragment) of an (already
    lowercased) URL, like urlsplit."""
    x = _c(c)
    return F.struct(
        _part(x, 1).alias("scheme"),
        _part(x, 2).alias("netloc"),
        _part(x, 3).alias("path"),
        _part(x, 4).alias("query"),
        _part(x, 5).alias("fragment"),
    )


def _decode(x: Column, plus_is_space: bool) -> Column:
    # An escaped surrogate half is three undecodable bytes, one mark each.
    x = F.regexp_replace(x, SURROGATE_BYTES, REPLACEMENT * 3)
    x = F.regexp_replace(x, STRAY_PERCENT, "%25")
    if not plus_is_space:
        x = F.replace(x, F.lit("+"), F.lit("%2B"))
    return F.url_decode(x)


def recode_path(c) -> Column:
    """Percent-decode once, re-encode with '/', ':' and '%' kept."""
    enc = F.url_encode(_decode(_c(c), plus_is_space=False))
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/"), ("%3A", ":"), ("%25", "%")):
        enc = F.replace(enc, F.lit(a), F.lit(b))
    return enc


def _encode_plus(x: Column) -> Column:
    enc = F.url_encode(x)
    return F.replace(F.replace(enc, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def strip_tracking(c, settings: Settings = DEFAULT) -> Column:
    """Parse the query (split on '&', skip empty segments, blank values
    kept), drop tracking keys, re-encode the rest in order."""
    segs = F.filter(F.split(_c(c), "&"), lambda s: s != "")
    pairs = F.transform(
        segs,
        lambda s: F.struct(
            _decode(F.substring_index(s, "=", 1), plus_is_space=True).alias("k"),
            _decode(
                F.when(F.instr(s, "=") > 0, F.substring(s, F.instr(s, "=") + 1, 1 << 30)).otherwise(F.lit("")),
                plus_is_space=True,
            ).alias("v"),
        ),
    )

    def keep(p):
        k = F.lower(p["k"])
        cond = ~k.isin(*settings.tracking_keys)
        for pre in settings.tracking_prefixes:
            cond = cond & ~k.startswith(pre)
        return cond

    kept = F.filter(pairs, keep)
    return F.array_join(
        F.transform(kept, lambda p: F.concat(_encode_plus(p["k"]), F.lit("="), _encode_plus(p["v"]))),
        "&",
    )


def _assemble(scheme: Column, netloc: Column, path: Column, query: Column) -> Column:
    rooted = (path == "") | path.startswith("/")
    body = (
        F.when(netloc != "", F.concat(F.lit("//"), netloc,
                                       F.when(rooted, path).otherwise(F.concat(F.lit("/"), path))))
        .when(path.startswith("//"), F.concat(F.lit("//"), path))
        .when(scheme.isin(*USES_NETLOC) & rooted, F.concat(F.lit("//"), path))
        .otherwise(path)
    )
    return F.concat(scheme, F.lit(":"), body,
                    F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


@functools.lru_cache(maxsize=1)
def delimiter_lookalikes() -> str:
    """Regex class of the characters whose compatibility form (NFKC) holds a
    URL delimiter: a host with one of them would change its meaning when
    normalised, and is rejected."""
    found = [c for c in range(0x80, 0x110000) if not 0xD800 <= c <= 0xDFFF
             and any(d in unicodedata.normalize("NFKC", chr(c)) for d in "/?#@:")]
    return "[" + "".join(f"\\x{{{c:X}}}" for c in found) + "]"


def _netloc_problem(netloc: Column) -> Column:
    """Reason a network location is rejected; NULL when it is fine."""
    host = F.regexp_extract(netloc, r"^[^\[]*\[([^\]]*)", 1)
    bracketed_ok = host.rlike(IPV6_PATTERN) | host.rlike(IPVFUTURE_PATTERN)
    return (F.when(netloc.contains("[") != netloc.contains("]"), F.lit("Invalid IPv6 URL"))
            .when(netloc.contains("[") & ~bracketed_ok, F.lit("Invalid bracketed host"))
            .when(netloc.rlike(delimiter_lookalikes()), F.lit("Invalid characters under NFKC")))


def url_error(c) -> Column:
    """Why a URL cannot be normalised (the stdlib raises); NULL when fine.
    Brackets must pair, a bracketed host must be IPv6 or IPvFuture, and no
    character may turn into a delimiter under NFKC."""
    return F.coalesce(F.when(_c(c).isNull(), F.lit("null url")), _netloc_problem(_part(prepare(c), 2)))


def normalize_url(c, settings: Settings = DEFAULT) -> Column:
    """Canonical form used for allowlisting and scoring. NULL for input
    the stdlib would reject (see ``url_error``). Each stage (prepared
    string, split parts, recoded parts) is computed once."""
    def recode(p):
        scheme = F.when(p["scheme"] == "", F.lit("https")).otherwise(p["scheme"])
        return F.struct(scheme.alias("scheme"), p["netloc"].alias("netloc"),
                        recode_path(p["path"]).alias("path"), strip_tracking(p["query"], settings).alias("query"))

    def finish(q):
        return F.when(_netloc_problem(q["netloc"]).isNull(), _assemble(q["scheme"], q["netloc"], q["path"], q["query"]))

    def from_prepared(x):
        parts = F.struct(_part(x, 1).alias("scheme"), _part(x, 2).alias("netloc"),
                         _part(x, 3).alias("path"), _part(x, 4).alias("query"))
        return let(parts, lambda p: let(recode(p), finish))

    return F.when(_c(c).isNotNull(), let(prepare(c, settings.bare_host), from_prepared))


def url_netloc(c) -> Column:
    """Network location of a URL string (urlsplit(...).netloc)."""
    return _part(F.lower(_c(c)), 2)


def url_domain(normalized, strict: bool = False) -> Column:
    """Netloc of the normalised URL with every 'www.' removed. ``strict``
    closes the gaps of that rule: userinfo and port go, and only a leading
    'www.' is removed."""
    if strict:
        return strict_domain(normalized)
    return F.replace(_part(_c(normalized), 2), F.lit("www."), F.lit(""))


def strict_domain(normalized) -> Column:
    """Option: host only (no userinfo/port), one leading 'www.' removed."""
    host = F.regexp_replace(_part(_c(normalized), 2), r"^.*@", "")
    host = F.regexp_replace(host, r":[0-9]*\z", "")
    return F.regexp_replace(host, r"^www\.", "")


def is_allowlisted(domain, settings: Settings = DEFAULT) -> Column:
    """J1 for a literal allowlist: an In-set lookup compiled into codegen."""
    return F.coalesce(_c(domain).isin(*settings.safe_domains), F.lit(False))
