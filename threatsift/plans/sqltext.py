"""ANSI-SQL (DuckDB dialect) fragments mirroring the native expressions.

Used only to build the oracle SQL that cross-checks every Spark query. Each
builder takes SQL expression text and returns SQL expression text, so the
oracle for a query reads like its DataFrame plan.
"""

from __future__ import annotations

from threatsift.functions.text import URL_PATTERN, URL_TRAILING, UI_URL_PATTERN
from threatsift.functions.urls import IPV6_PATTERN, IPVFUTURE_PATTERN, SPLIT_PATTERN
from threatsift.settings import (
    DEFAULT,
    EMAIL_CUE_CHARS,
    EMAIL_CUE_WORDS,
    EMAIL_PRIORS,
    MSG_ALLOWLIST,
    MSG_PHISHING,
    MSG_SAFE,
    MSG_SPAM,
    MSG_UNKNOWN,
    MSG_URL_ONLY_DEFAULT,
    MSG_URL_OVERRIDE_NO_SCORES,
    PY_WS_CHARS,
    PY_WS_CLASS,
    REASON_EMAIL,
    REASON_EMAIL_BODY,
    REASON_URL,
    REASON_URL_OVERRIDE,
    URL_CUE_WEIGHT,
    URL_CUES,
    URL_PRIORS,
    USES_NETLOC,
    Settings,
)

WS = f"[{PY_WS_CLASS}]"
DUCK_SPLIT = SPLIT_PATTERN  # same pattern in RE2 (no look-arounds in it)


def lit(s) -> str:
    if s is None:
        return "NULL"
    if isinstance(s, bool):
        return "TRUE" if s else "FALSE"
    if isinstance(s, (int, float)):
        return f"CAST({s!r} AS DOUBLE)" if isinstance(s, float) else str(s)
    return "'" + str(s).replace("'", "''") + "'"


def in_list(e: str, values) -> str:
    return f"{e} IN ({', '.join(lit(v) for v in values)})"


def strip(e: str) -> str:
    return f"trim({e}, {lit(PY_WS_CHARS)})"


WORD_SPLIT = r"[^\p{L}\p{N}_]+"


def all_words(e: str) -> str:
    return f"string_split_regex(lower(coalesce({e}, '')), {lit(WORD_SPLIT)})"


def collapse(e: str) -> str:
    return strip(f"regexp_replace({e}, {lit(WS + '+')}, ' ', 'g')")


def extract_urls(e: str) -> str:
    return (f"list_transform(regexp_extract_all(coalesce({e}, ''), {lit(URL_PATTERN)}, 0), "
            f"lambda u: regexp_replace(u, {lit(URL_TRAILING)}, ''))")


def extract_urls_ui(e: str) -> str:
    return f"regexp_extract_all(coalesce({e}, ''), {lit(UI_URL_PATTERN)}, 0)"


def substring_count(e: str, needle: str) -> str:
    x = f"coalesce({e}, '')"
    return f"CAST((length({x}) - length(replace({x}, {lit(needle)}, ''))) // {len(needle)} AS BIGINT)"


def char_count(e: str, ch: str) -> str:
    x = f"coalesce({e}, '')"
    return f"(length({x}) - length(replace({x}, {lit(ch)}, '')))"


def prepare_url(e: str) -> str:
    x = f"lower({strip(e)})"
    x = f"CASE WHEN starts_with({x}, 'www.') THEN concat('https://', {x}) ELSE {x} END"
    x = f"regexp_replace({x}, '^[\\x{{0}}-\\x{{20}}]+', '')"
    return f"regexp_replace({x}, '[\\t\\r\\n]', '', 'g')"


def url_part(e: str, idx: int) -> str:
    return f"regexp_extract({e}, {lit(DUCK_SPLIT)}, {idx})"


def recode_path(e: str) -> str:
    x = f"url_encode(url_decode({e}))"
    for a, b in (("%2F", "/"), ("%3A", ":"), ("%25", "%")):
        x = f"replace({x}, {lit(a)}, {lit(b)})"
    return x


def _enc_plus(e: str) -> str:
    return f"replace(url_encode({e}), '%20', '+')"


def strip_tracking(e: str, settings: Settings = DEFAULT) -> str:
    key = "CASE WHEN strpos(s, '=') > 0 THEN s[1:strpos(s, '=') - 1] ELSE s END"
    val = "CASE WHEN strpos(s, '=') > 0 THEN s[strpos(s, '=') + 1:] ELSE '' END"
    pairs = (f"list_transform(list_filter(string_split({e}, '&'), lambda s: s <> ''), "
             f"lambda s: {{'k': url_decode(replace({key}, '+', ' ')), 'v': url_decode(replace({val}, '+', ' '))}})")
    conds = [f"NOT ({in_list('lower(p.k)', settings.tracking_keys)})"]
    conds += [f"NOT starts_with(lower(p.k), {lit(pre)})" for pre in settings.tracking_prefixes]
    kept = f"list_filter({pairs}, lambda p: {' AND '.join(conds)})"
    return f"coalesce(array_to_string(list_transform({kept}, lambda p: {_enc_plus('p.k')} || '=' || {_enc_plus('p.v')}), '&'), '')"


def normalize_url_select(src: str, keep: str, url_col: str, out: str = "norm_url",
                         settings: Settings = DEFAULT) -> str:
    """SELECT keep-columns + normalised URL from relation text ``src``."""
    s1 = f"SELECT {keep}, {url_col} AS _raw, {prepare_url(url_col)} AS _x FROM {src}"
    s2 = (f"SELECT {keep}, _raw, {url_part('_x', 1)} AS _scheme, {url_part('_x', 2)} AS _netloc, "
          f"{url_part('_x', 3)} AS _path, {url_part('_x', 4)} AS _query FROM ({s1}) s1")
    s3 = (f"SELECT {keep}, _raw, _netloc, CASE WHEN _scheme = '' THEN 'https' ELSE _scheme END AS _scheme, "
          f"{recode_path('_path')} AS _path, {strip_tracking('_query', settings)} AS _query FROM ({s2}) s2")
    rooted = "(_path = '' OR starts_with(_path, '/'))"
    body = (f"CASE WHEN _netloc <> '' THEN '//' || _netloc || CASE WHEN {rooted} THEN _path ELSE '/' || _path END "
            f"WHEN starts_with(_path, '//') THEN '//' || _path "
            f"WHEN {in_list('_scheme', USES_NETLOC)} AND {rooted} THEN '//' || _path ELSE _path END")
    full = f"_scheme || ':' || {body} || CASE WHEN _query <> '' THEN '?' || _query ELSE '' END"
    host = "regexp_extract(_netloc, '^[^\\[]*\\[([^\\]]*)', 1)"
    ok = f"(regexp_matches({host}, {lit(IPV6_PATTERN)}) OR regexp_matches({host}, {lit(IPVFUTURE_PATTERN)}))"
    bad = (f"(_raw IS NULL OR (strpos(_netloc, '[') > 0) <> (strpos(_netloc, ']') > 0) "
           f"OR (strpos(_netloc, '[') > 0 AND NOT {ok}))")
    return f"SELECT {keep}, _raw AS raw_url, CASE WHEN {bad} THEN NULL ELSE {full} END AS {out} FROM ({s3}) s3"


def url_domain(e: str) -> str:
    return f"replace({url_part(e, 2)}, 'www.', '')"


def allowlisted(e: str, settings: Settings = DEFAULT) -> str:
    return f"coalesce({in_list(e, settings.safe_domains)}, FALSE)"


def lexical_scores(e: str, kind: str = "email") -> dict[str, str]:
    if kind == "email":
        counts = {}
        for k, ws in EMAIL_CUE_WORDS.items():
            c = f"coalesce(list_sum(list_transform({all_words(e)}, lambda w: CASE WHEN {in_list('w', ws)} THEN 1 ELSE 0 END)), 0)"
            for ch in EMAIL_CUE_CHARS[k]:
                c += f" + {char_count(e, ch)}"
            counts[k] = f"({c})"
        priors, w = EMAIL_PRIORS, 1
    else:
        counts = {k: f"({' + '.join(substring_count(e, c) for c in URL_CUES[k])})" for k in URL_CUES}
        priors, w = URL_PRIORS, URL_CUE_WEIGHT
    num = {k: f"({priors[k]} + {w} * {counts[k]})" for k in counts}
    den = " + ".join(num.values())
    return {k: f"(CAST({num[k]} AS DOUBLE) / CAST(({den}) AS DOUBLE))" for k in counts}


def decide_email(l: str, s: str, p: str, settings: Settings = DEFAULT) -> dict[str, str]:
    t = lit(float(settings.email_threshold))
    is_ph = f"({p} >= {t})"
    is_sp = f"(NOT {is_ph} AND {s} >= {t})"
    return {
        "is_phishing": is_ph,
        "confidence": f"round(CASE WHEN {is_ph} THEN {p} WHEN {is_sp} THEN {s} ELSE CAST(1.0 AS DOUBLE) - greatest({p}, {s}) END, 4)",
        "message": f"CASE WHEN {is_ph} THEN {lit(MSG_PHISHING)} WHEN {is_sp} THEN {lit(MSG_SPAM)} ELSE {lit(MSG_SAFE)} END",
        "p_phishing": f"round({p}, 4)",
        "p_spam": f"round({s}, 4)",
        "p_legitimate": f"round({l}, 4)",
    }


def decide_url(l: str, p: str, settings: Settings = DEFAULT) -> dict[str, str]:
    t = lit(float(settings.url_threshold))
    is_ph = f"({p} >= {t})"
    return {
        "is_phishing": is_ph,
        "confidence": f"round(CASE WHEN {is_ph} THEN {p} ELSE {l} END, 4)",
        "message": f"CASE WHEN {is_ph} THEN {lit(MSG_PHISHING)} ELSE {lit(MSG_SAFE)} END",
        "p_phishing": f"round({p}, 4)",
        "p_legitimate": f"round({l}, 4)",
    }


def allow_pred(settings: Settings = DEFAULT) -> dict[str, str]:
    return {
        "is_phishing": "FALSE",
        "confidence": lit(float(settings.allowlist_confidence)),
        "message": lit(MSG_ALLOWLIST),
        "p_phishing": "CAST(NULL AS DOUBLE)",
        "p_legitimate": "CAST(NULL AS DOUBLE)",
    }


def pct(e: str) -> str:
    n = f"CAST(round({e} * 10000) AS BIGINT)"
    return f"concat(CAST({n} // 100 AS VARCHAR), '.', lpad(CAST({n} % 100 AS VARCHAR), 2, '0'))"


def reason_parts(*named) -> str:
    parts = [f"CASE WHEN {e} IS NOT NULL THEN {lit(n.capitalize() + ': ')} || {pct(e)} || '%' END" for n, e in named]
    return f"concat_ws(', ', {', '.join(parts)})"


URL_FIELDS = ("is_phishing", "confidence", "message", "p_phishing", "p_legitimate")


def url_aggregates(src: str, key: str = "msg_id", settings: Settings = DEFAULT) -> str:
    st = "{" + ", ".join(f"'{f}': {f}" for f in URL_FIELDS) + ", 'url_pos': url_pos}"
    t = lit(float(settings.url_override_threshold))
    conf = "coalesce(confidence, CAST(0.0 AS DOUBLE))"
    return (f"SELECT {key}, arg_min({st}, url_pos) FILTER (WHERE coalesce(is_phishing, FALSE) AND {conf} >= {t}) AS ovr, "
            f"arg_max({st}, ({conf}, -url_pos)) AS top, count(*) AS n_urls FROM {src} GROUP BY {key}")


def verdict_columns(e_present: str, e: dict, ovr: str = "ovr", top: str = "top") -> dict[str, str]:
    """V6 as four CASE expressions over e_* columns and the two URL structs."""
    ovr_scored = f"({ovr}.p_phishing IS NOT NULL OR {ovr}.p_legitimate IS NOT NULL)"
    v1_reason = (f"CASE WHEN {ovr_scored} THEN {lit(REASON_URL_OVERRIDE)} || "
                 f"{reason_parts(('phishing', f'{ovr}.p_phishing'), ('legitimate', f'{ovr}.p_legitimate'))} "
                 f"ELSE {lit(MSG_URL_OVERRIDE_NO_SCORES)} END")
    has = f"({e['p_phishing']} IS NOT NULL OR {e['p_spam']} IS NOT NULL OR {e['p_legitimate']} IS NOT NULL)"
    zero = "CAST(0.0 AS DOUBLE)"
    p, s, l_ = (f"coalesce({e[k]}, {zero})" for k in ("p_phishing", "p_spam", "p_legitimate"))
    v2_label = f"CASE WHEN {p} >= {s} AND {p} >= {l_} THEN 'Phishing' WHEN {s} >= {l_} THEN 'Spam' ELSE 'Legitimate' END"
    v2_reason = f"{lit(REASON_EMAIL)} || {reason_parts(('phishing', e['p_phishing']), ('spam', e['p_spam']), ('legitimate', e['p_legitimate']))}"
    v3_label = (f"CASE WHEN coalesce({e['is_phishing']}, FALSE) THEN 'Phishing' "
                f"WHEN strpos(lower(coalesce({e['message']}, '')), 'spam') > 0 THEN 'Spam' ELSE 'Legitimate' END")
    e_label = f"CASE WHEN {has} THEN {v2_label} ELSE {v3_label} END"
    e_reason = f"CASE WHEN {has} THEN {v2_reason} ELSE {lit(REASON_EMAIL_BODY)} || {v3_label} END"
    top_scored = f"({top}.p_phishing IS NOT NULL OR {top}.p_legitimate IS NOT NULL)"
    top_ph = f"coalesce({top}.is_phishing, FALSE)"
    v4_reason = (f"CASE WHEN {top_scored} THEN {lit(REASON_URL)} || "
                 f"{reason_parts(('phishing', f'{top}.p_phishing'), ('legitimate', f'{top}.p_legitimate'))} "
                 f"ELSE coalesce({top}.message, {lit(MSG_URL_ONLY_DEFAULT)}) END")
    b1, b2, b4 = f"{ovr} IS NOT NULL", f"coalesce({e_present}, FALSE)", f"{top} IS NOT NULL"

    def case(v1, v2, v4, v5):
        return f"CASE WHEN {b1} THEN {v1} WHEN {b2} THEN {v2} WHEN {b4} THEN {v4} ELSE {v5} END"

    return {
        "label": case("'Phishing'", e_label, f"CASE WHEN {top_ph} THEN 'Phishing' ELSE 'Legitimate' END", "'Unknown'"),
        "confidence": case(f"CAST({ovr}.confidence AS DOUBLE)", f"CAST(coalesce({e['confidence']}, {zero}) AS DOUBLE)",
                           f"CAST(coalesce({top}.confidence, {zero}) AS DOUBLE)", zero),
        "is_phishing": case("TRUE", f"({e_label}) = 'Phishing'", top_ph, "FALSE"),
        "reason": case(v1_reason, e_reason, v4_reason, lit(MSG_UNKNOWN)),
    }
