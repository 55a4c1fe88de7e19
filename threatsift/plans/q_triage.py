"""Queries for the scoring paths and verdict rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatsift.functions.text import trim_input
from threatsift.operators.scoring import LexicalScorer, decide_email, decide_url, lexical_scores
from threatsift.operators.verdict import E_FIELDS, email_columns, url_aggregates, verdict
from threatsift.plans import sqltext as S
from threatsift.plans.catalog import query
from threatsift.plans.triage import (
    email_predictions,
    triage_messages,
    triage_requests,
    triage_urls,
    url_occurrences,
    url_predictions,
)
from threatsift.plans.views import sub, view
from threatsift.settings import DEFAULT

VERDICT_OUT = ("msg_id", "label", "confidence", "is_phishing", "reason")


# --------------------------------------------------------------------------
# Shared oracle building blocks
# --------------------------------------------------------------------------

def sql_messages(src: str | None = None) -> str:
    src = src or f"{sub('v_messages')} vm"
    return f"SELECT msg_id, {S.strip('text')} AS clean FROM {src}"


def sql_email_preds(src: str) -> str:
    """msg_id + e_* columns from relation with ``clean``."""
    sc = S.lexical_scores("lower(clean)", "email")
    inner = (f"SELECT msg_id, {sc['legitimate']} AS pl, {sc['spam']} AS ps, {sc['phishing']} AS pp FROM {src}")
    d = S.decide_email("pl", "ps", "pp")
    cols = ", ".join(f"{d[c]} AS e_{c}" for c, _ in E_FIELDS)
    return f"SELECT msg_id, TRUE AS _e, {cols} FROM ({inner}) es"


def sql_occurrences(src: str) -> str:
    """msg_id, url_pos, raw_url, norm_url, domain, allowlisted."""
    ex = f"SELECT msg_id, {S.extract_urls('clean')} AS _u FROM {src}"
    un = f"SELECT msg_id, generate_subscripts(_u, 1) - 1 AS url_pos, unnest(_u) AS _ru FROM ({ex}) ex"
    norm = S.normalize_url_select(f"({un}) un", "msg_id, url_pos", "_ru")
    dom = f"SELECT *, {S.url_domain('norm_url')} AS domain FROM ({norm}) nm"
    return f"SELECT *, {S.allowlisted('domain')} AS allowlisted FROM ({dom}) dm"


def sql_url_preds(occ: str) -> str:
    sc = S.lexical_scores("norm_url", "url")
    inner = f"SELECT *, {sc['legitimate']} AS pl, {sc['phishing']} AS pp FROM {occ}"
    d = S.decide_url("pl", "pp")
    a = S.allow_pred()
    cols = ", ".join(f"CASE WHEN allowlisted THEN {a[c]} ELSE {d[c]} END AS {c}" for c in S.URL_FIELDS)
    return f"SELECT msg_id, url_pos, norm_url, allowlisted, {cols} FROM ({inner}) us WHERE norm_url IS NOT NULL"


def sql_verdict_select(src: str) -> str:
    e = {c: f"e_{c}" for c, _ in E_FIELDS}
    v = S.verdict_columns("_e", e)
    return f"SELECT msg_id, {', '.join(f'{x} AS {k}' for k, x in v.items())} FROM {src}"


def oracle_triage_messages(src: str | None = None) -> str:
    return (
        f"WITH m AS ({sql_messages(src)}), e AS ({sql_email_preds('m')}), "
        f"occ AS ({sql_occurrences('m')}), p AS ({sql_url_preds('occ')}), "
        f"agg AS ({S.url_aggregates('p')}), j AS (SELECT e.*, agg.ovr, agg.top FROM e LEFT JOIN agg ON agg.msg_id = e.msg_id) "
        f"{sql_verdict_select('j')}"
    )


@query("triage_messages", oracle_triage_messages, headline=True)
def q_triage_messages(spark, sf_dir):
    """V7: the whole email path over every message."""
    return triage_messages(view(spark, sf_dir, "v_messages"))


# V8: each page URL is one URL-mode request.
def oracle_triage_urls() -> str:
    src = f"(SELECT page_id AS msg_id, 0 AS url_pos, url AS _ru FROM pages) pg"
    norm = S.normalize_url_select(src, "msg_id, url_pos", S.strip("_ru"))
    occ = f"(SELECT *, {S.allowlisted(S.url_domain('norm_url'))} AS allowlisted FROM ({norm}) nm)"
    p = sql_url_preds(occ)
    agg = S.url_aggregates(f"({p}) p")
    j = (f"(SELECT a.msg_id, CAST(NULL AS BOOLEAN) AS _e, "
         + ", ".join(f"CAST(NULL AS {t.upper()}) AS e_{c}" for c, t in E_FIELDS)
         + f", a.ovr, a.top FROM ({agg}) a)")
    return sql_verdict_select(j)


@query("triage_urls", oracle_triage_urls, headline=True)
def q_triage_urls(spark, sf_dir):
    """V8: URL path over every page URL."""
    pages = view(spark, sf_dir, "pages").select(F.col("page_id").alias("msg_id"), F.col("url").alias("text"))
    return triage_urls(pages)


# Requests of both input types, some asking for an explanation, some invalid.
def requests(spark, sf_dir):
    m = view(spark, sf_dir, "v_messages").select("msg_id", "text")
    kind = F.when(F.col("msg_id") % 10 == 9, "sms").otherwise("email")
    mails = m.select(F.col("msg_id") * 2, "text", kind.alias("input_type"), (F.col("msg_id") % 3 == 0).alias("explain"))
    urls = view(spark, sf_dir, "pages").select(F.col("page_id") * 2 + 1, F.col("url").alias("text"), F.lit("url").alias("input_type"),
                                               (F.col("page_id") % 2 == 0).alias("explain"))
    return mails.toDF("msg_id", "text", "input_type", "explain").unionByName(urls.toDF("msg_id", "text", "input_type", "explain"))


def _oracle_requests() -> str:
    from threatsift.plans.q_explain import sql_importance, sql_target, sql_tokens
    m, mails, urls = f"{sub('v_messages')} vm", oracle_triage_messages(), oracle_triage_urls()
    unknown = "'Unknown' AS label, CAST(0.0 AS DOUBLE) AS confidence, FALSE AS is_phishing, 'No valid text or URLs provided to analyze.' AS reason"
    cols = "label, confidence, is_phishing, reason"
    of_v = "v.label, v.confidence, v.is_phishing, v.reason"
    rows = (f"SELECT v.msg_id * 2 AS msg_id, vm.text, 'email' AS input_type, v.msg_id % 3 = 0 AS explain, {of_v} FROM ({mails}) v JOIN {m} USING (msg_id) "
            f"WHERE v.msg_id % 10 <> 9 UNION ALL "
            f"SELECT vm.msg_id * 2, vm.text, 'sms', vm.msg_id % 3 = 0, {unknown} FROM {m} WHERE vm.msg_id % 10 = 9 UNION ALL "
            f"SELECT v.msg_id * 2 + 1, p.url, 'url', v.msg_id % 2 = 0, {of_v} FROM ({urls}) v JOIN pages p ON p.page_id = v.msg_id")
    imp = sql_importance("t", sql_target("label")).replace("CAST(CASE", "(CAST(CASE", 1) + ")"
    return (f"SELECT msg_id, input_type, {cols}, CASE WHEN explain THEN CAST(len({sql_tokens('text')}) AS INTEGER) END AS n_words, "
            f"CASE WHEN explain THEN round(coalesce(list_sum(list_transform({sql_tokens('text')}, lambda t: {imp})), 0.0), 6) END AS importance_sum "
            f"FROM ({rows}) r")


@query("triage_requests", _oracle_requests)
def q_triage_requests(spark, sf_dir):
    """One request transform over both input types, with explanations."""
    v = triage_requests(requests(spark, sf_dir), explain_col="explain", carry=("input_type",))
    total = F.aggregate("word_importances", F.lit(0.0), lambda a, w: a + w["importance"])
    return v.select("msg_id", "input_type", "label", "confidence", "is_phishing", "reason",
                    F.size("word_importances").alias("n_words"), F.round(total, 6).alias("importance_sum")) \
        .withColumn("n_words", F.when(F.col("importance_sum").isNotNull(), F.col("n_words")))


# --------------------------------------------------------------------------
# Allowlist join forms, regather, distinct-then-join scoring
# --------------------------------------------------------------------------

def _occ(spark, sf_dir):
    msgs = view(spark, sf_dir, "v_messages").select("msg_id", trim_input(F.col("text")).alias("clean"))
    return url_occurrences(msgs, "clean")


def _oracle_occ() -> str:
    return f"WITH m AS ({sql_messages()}), occ AS ({sql_occurrences('m')}) "


@query("allowlist_match", lambda: _oracle_occ() + "SELECT msg_id, url_pos, norm_url, domain, allowlisted FROM occ")
def q_allowlist_match(spark, sf_dir):
    """Flag each URL occurrence whose domain is in the allowlist."""
    return _occ(spark, sf_dir).select("msg_id", "url_pos", "norm_url", "domain", "allowlisted")


def _allow_values() -> str:
    return "(SELECT d FROM (VALUES " + ", ".join(f"('{d}')" for d in DEFAULT.safe_domains) + ") t(d))"


@query("allowlist_semi", lambda: _oracle_occ() + f"SELECT msg_id, url_pos, norm_url FROM occ WHERE domain IN {_allow_values()}")
def q_allowlist_semi(spark, sf_dir):
    """J2 (known-safe side) as a left-semi join with the allowlist table."""
    from threatsift.operators.joins import allowlist_table, semi_by_allowlist
    occ = _occ(spark, sf_dir)
    return semi_by_allowlist(occ, allowlist_table(spark), "domain", how="left_semi").select("msg_id", "url_pos", "norm_url")


@query("allowlist_anti", lambda: _oracle_occ()
       + f"SELECT msg_id, url_pos, norm_url FROM occ WHERE domain IS NULL OR domain NOT IN {_allow_values()}")
def q_allowlist_anti(spark, sf_dir):
    """J2 (to-be-scored side) as a left-anti join with the allowlist table."""
    from threatsift.operators.joins import allowlist_table, semi_by_allowlist
    occ = _occ(spark, sf_dir)
    return semi_by_allowlist(occ, allowlist_table(spark), "domain", how="left_anti").select("msg_id", "url_pos", "norm_url")


def _oracle_preds() -> str:
    return f"WITH m AS ({sql_messages()}), occ AS ({sql_occurrences('m')}), p AS ({sql_url_preds('occ')}) "


@query("score_dedup", lambda: _oracle_preds() + "SELECT msg_id, url_pos, norm_url, is_phishing, confidence, message FROM p")
def q_score_dedup(spark, sf_dir):
    """Each distinct URL scored once, predictions joined back to every
    occurrence (the plan used for expensive scorers)."""
    from threatsift.session import cut_lineage
    preds = url_predictions(cut_lineage(_occ(spark, sf_dir)), LexicalScorer("url"), dedupe=True)
    return preds.select("msg_id", "url_pos", "norm_url", "is_phishing", "confidence", "message")


@query("regather_predictions", lambda: _oracle_preds()
       + "SELECT m.msg_id, count(p.url_pos) AS n_urls, CAST(coalesce(sum(CASE WHEN p.is_phishing THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_phishing_urls, "
         "min(p.url_pos) FILTER (WHERE p.is_phishing) AS first_phishing_pos FROM m LEFT JOIN p ON p.msg_id = m.msg_id GROUP BY m.msg_id")
def q_regather(spark, sf_dir):
    """Predictions returned to their message by an equi left join on
    msg_id, summarised per message."""
    occ = _occ(spark, sf_dir)
    preds = url_predictions(occ, LexicalScorer("url"))
    msgs = view(spark, sf_dir, "v_messages").select("msg_id")
    j = msgs.join(preds, "msg_id", "left")
    return j.groupBy("msg_id").agg(
        F.count("url_pos").alias("n_urls"),
        F.coalesce(F.sum(F.when(F.col("is_phishing"), 1).otherwise(0)), F.lit(0)).cast("long").alias("n_phishing_urls"),
        F.min(F.when(F.col("is_phishing"), F.col("url_pos"))).alias("first_phishing_pos"),
    )


# --------------------------------------------------------------------------
# Verdict branches, each over real predictions of the message corpus
# --------------------------------------------------------------------------

def _verdict_inputs(spark, sf_dir):
    msgs = view(spark, sf_dir, "v_messages").select("msg_id", trim_input(F.col("text")).alias("clean"))
    e = email_predictions(msgs, LexicalScorer("email"), "clean")
    preds = url_predictions(url_occurrences(msgs, "clean"), LexicalScorer("url"))
    return msgs, e, preds


def _narrow_triage(spark, sf_dir, with_email: bool = True):
    """The branch queries run the single-scan triage projection (native
    scorers: no URL explode, no join back) and keep one verdict branch."""
    return triage_messages(view(spark, sf_dir, "v_messages"), with_email=with_email)


def _oracle_branch(where: str, url_only: bool = False) -> str:
    base = (f"WITH m AS ({sql_messages()}), e AS ({sql_email_preds('m')}), occ AS ({sql_occurrences('m')}), "
            f"p AS ({sql_url_preds('occ')}), agg AS ({S.url_aggregates('p')}), ")
    if url_only:
        e_cols = "CAST(NULL AS BOOLEAN) AS _e, " + ", ".join(f"CAST(NULL AS {t.upper()}) AS e_{c}" for c, t in E_FIELDS)
        j = f"j AS (SELECT m.msg_id, {e_cols}, agg.ovr, agg.top FROM m LEFT JOIN agg ON agg.msg_id = m.msg_id) "
    else:
        j = "j AS (SELECT e.*, agg.ovr, agg.top FROM e LEFT JOIN agg ON agg.msg_id = e.msg_id) "
    return base + j + f"SELECT * FROM ({sql_verdict_select('j')}) v WHERE {where}"


@query("url_override", lambda: _oracle_branch("reason LIKE 'High-confidence%'"))
def q_url_override(spark, sf_dir):
    """V1: messages decided by a high-confidence phishing URL."""
    return _narrow_triage(spark, sf_dir).filter(F.col("reason").startswith("High-confidence"))


@query("email_argmax", lambda: _oracle_branch("reason LIKE 'Email analysis%'"))
def q_email_argmax(spark, sf_dir):
    """V2: messages decided by the email model's class scores."""
    return _narrow_triage(spark, sf_dir).filter(F.col("reason").startswith("Email analysis"))


def _oracle_fallback() -> str:
    # email predictions without class scores (mock scorer) and no URLs
    mk = "(strpos(lower(clean), 'fake-bank') > 0 OR strpos(lower(clean), 'phishing') > 0)"
    e = (f"SELECT msg_id, TRUE AS _e, {mk} AS e_is_phishing, CASE WHEN {mk} THEN CAST(0.95 AS DOUBLE) ELSE CAST(0.10 AS DOUBLE) END AS e_confidence, "
         f"CASE WHEN {mk} THEN 'Phishing detected' ELSE 'Content appears safe' END AS e_message, "
         "CAST(NULL AS DOUBLE) AS e_p_phishing, CAST(NULL AS DOUBLE) AS e_p_spam, CAST(NULL AS DOUBLE) AS e_p_legitimate FROM m")
    j = ("SELECT e.*, CAST(NULL AS STRUCT(is_phishing BOOLEAN, confidence DOUBLE, message VARCHAR, p_phishing DOUBLE, p_legitimate DOUBLE, url_pos INTEGER)) AS ovr, "
         "CAST(NULL AS STRUCT(is_phishing BOOLEAN, confidence DOUBLE, message VARCHAR, p_phishing DOUBLE, p_legitimate DOUBLE, url_pos INTEGER)) AS top FROM e")
    return f"WITH m AS ({sql_messages()}), e AS ({e}), j AS ({j}) {sql_verdict_select('j')}"


@query("email_message_fallback", _oracle_fallback)
def q_email_fallback(spark, sf_dir):
    """V3: email predictions without class scores (the mock scorer), no URL
    model: flag, then message text decide."""
    from threatsift.operators.scoring import RuleScorer
    msgs = view(spark, sf_dir, "v_messages").select("msg_id", trim_input(F.col("text")).alias("clean"))
    e = email_predictions(msgs, RuleScorer(("fake-bank", "phishing")), "clean")
    return verdict(e, None)


@query("url_only", lambda: _oracle_branch("reason NOT LIKE 'No valid%'", url_only=True))
def q_url_only(spark, sf_dir):
    """V1/V4 without an email model: highest-confidence URL, first on ties."""
    return _narrow_triage(spark, sf_dir, with_email=False).filter(~F.col("reason").startswith("No valid"))


@query("unknown_verdict", lambda: _oracle_branch("label = 'Unknown'", url_only=True))
def q_unknown(spark, sf_dir):
    """V5: messages with neither an email prediction nor a URL."""
    return _narrow_triage(spark, sf_dir, with_email=False).filter(F.col("label") == "Unknown")


@query("verdict", lambda: _oracle_branch("TRUE"))
def q_verdict(spark, sf_dir):
    """V6: the full precedence over email and URL predictions."""
    msgs, e, preds = _verdict_inputs(spark, sf_dir)
    return verdict(e, preds)
