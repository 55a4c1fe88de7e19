"""Queries for token explanations (W2-W4, J7) over conversations and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatsift.functions.text import UI_URL_PATTERN, trim_input
from threatsift.functions.urls import let
from threatsift.operators import explain as XP
from threatsift.operators.scoring import LexicalScorer
from threatsift.operators.verdict import E_FIELDS, URL_STRUCT, email_columns, verdict_struct
from threatsift.plans import sqltext as S
from threatsift.plans.catalog import query
from threatsift.plans.q_triage import oracle_triage_messages, sql_email_preds, sql_verdict_select
from threatsift.plans.triage import triage_messages
from threatsift.plans.views import sub, view
from threatsift.settings import EMAIL_CUE_WORDS, TOP_IMPORTANCE_WORDS

CONV_KEY = ["conv_id", "turn"]


# ---------------------------------------------------------------- SQL mirrors

def sql_tokens(e: str) -> str:
    return f"regexp_extract_all(coalesce({e}, ''), {S.lit(XP.TOKEN_PATTERN)}, 0)"


def sql_importance(tok: str, target: str) -> str:
    w = f"lower(regexp_replace({tok}, '[^\\p{{L}}\\p{{N}}_]', '', 'g'))"
    whens = " ".join(
        f"WHEN {S.in_list(w, words)} THEN CASE WHEN {target} = {S.lit(cls)} THEN 1.0 ELSE -0.5 END"
        for cls, words in EMAIL_CUE_WORDS.items())
    return f"CAST(CASE {whens} ELSE 1.0 / CAST(length({tok}) + 1 AS DOUBLE) END AS DOUBLE)"


def sql_target(label: str) -> str:
    return f"CASE WHEN {label} = 'Phishing' THEN 'phishing' WHEN {label} = 'Spam' THEN 'spam' ELSE 'legitimate' END"


def sql_spans(e: str) -> str:
    """[start, end) list of URL matches, via split segments and prefix sums."""
    x = f"coalesce({e}, '')"
    urls = f"regexp_extract_all({x}, {S.lit(UI_URL_PATTERN)}, 0)"
    segs = f"string_split_regex({x}, {S.lit(UI_URL_PATTERN)})"
    start = (f"coalesce(list_sum(list_transform({segs}[1:k + 1], lambda s: length(s))), 0) + "
             f"coalesce(list_sum(list_transform({urls}[1:k], lambda u: length(u))), 0)")
    return (f"list_transform(range(len({urls})), lambda k: {{'start': {start}, "
            f"'end': {start} + length({urls}[k + 1])}})")


def sql_token_rows(src: str, key: str, text: str, extra: str = "") -> str:
    """key, pos (0-based), token, spans, char_offset, importance inputs."""
    t = (f"SELECT {key}{extra}, {sql_spans(text)} AS spans, generate_subscripts(tk, 1) - 1 AS pos, unnest(tk) AS token "
         f"FROM (SELECT *, {sql_tokens(text)} AS tk FROM {src}) s")
    return (f"SELECT *, coalesce(sum(length(token)) OVER (PARTITION BY {key} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) "
            f"AS char_offset FROM ({t}) t")


def sql_conv_verdicts() -> str:
    m = "(SELECT conv_id, turn, {'conv_id': conv_id, 'turn': turn} AS msg_id, " + S.strip("text") + " AS clean, text FROM conversations) c"
    e = f"(SELECT * FROM ({sql_email_preds(m)}) ep)"
    j = ("(SELECT e.*, CAST(NULL AS STRUCT(is_phishing BOOLEAN, confidence DOUBLE, message VARCHAR, p_phishing DOUBLE, "
         "p_legitimate DOUBLE, url_pos INTEGER)) AS ovr, CAST(NULL AS STRUCT(is_phishing BOOLEAN, confidence DOUBLE, message VARCHAR, "
         f"p_phishing DOUBLE, p_legitimate DOUBLE, url_pos INTEGER)) AS top FROM {e} e)")
    return f"SELECT msg_id.conv_id AS conv_id, msg_id.turn AS turn, label, is_phishing FROM ({sql_verdict_select(j)}) v"


def _conv_verdicts(spark, sf_dir):
    """Conversation turns with their email-model verdict, in one projection;
    the pair of ids is the message key."""
    conv = view(spark, sf_dir, "conversations").select(F.struct(*CONV_KEY).alias("msg_id"), "text")
    e = conv.select("msg_id", "text", trim_input(F.col("text"), lowercase=True).alias("_body"))
    preds = LexicalScorer("email", lowercased=True).predict(e, "_body")
    rows = preds.select("msg_id", "text", *email_columns(preds))
    nothing = F.lit(None).cast(URL_STRUCT)
    v = verdict_struct(F.col("_e"), {c: F.col(f"e_{c}") for c, _ in E_FIELDS}, nothing, nothing)
    return (rows.select("msg_id", "text", v.alias("v"))
            .select("msg_id.conv_id", "msg_id.turn", "text", "v.label", "v.is_phishing"))


def _sql_conv_tokens() -> str:
    src = f"(SELECT c.*, v.label, v.is_phishing FROM conversations c JOIN ({sql_conv_verdicts()}) v USING (conv_id, turn)) cv"
    rows = sql_token_rows(src, "conv_id, turn", "text", ", label, is_phishing")
    return f"SELECT *, {sql_importance('token', sql_target('label'))} AS importance FROM ({rows}) r"


@query("url_spans", lambda: (
    f"SELECT msg_id, CAST(k AS INTEGER) AS url_idx, s['start'] AS start, s['end'] AS \"end\" FROM "
    f"(SELECT msg_id, generate_subscripts(sp, 1) - 1 AS k, unnest(sp) AS s FROM "
    f"(SELECT msg_id, {sql_spans('text')} AS sp FROM {sub('v_messages')} m) a) b"))
def q_url_spans(spark, sf_dir):
    """Character ranges of the URL matches of every message (J7's spans)."""
    return XP.url_span_rows(view(spark, sf_dir, "v_messages"), ["msg_id"], "text").select(
        "msg_id", "url_idx", "start", "end")


@query("token_offsets", lambda: (
    f"SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, length(token) AS token_len, CAST(char_offset AS BIGINT) AS char_offset "
    f"FROM ({sql_token_rows('conversations', 'conv_id, turn', 'text')}) t"))
def q_token_offsets(spark, sf_dir):
    """Running character offset of every token of every turn."""
    rows = XP.piece_rows(view(spark, sf_dir, "conversations"), CONV_KEY, "text")
    return rows.select(*CONV_KEY, "pos", F.length("token").alias("token_len"), "char_offset")


@query("top_importances", lambda: (
    f"SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, token, round(importance, 6) AS importance, imp_rank FROM "
    f"(SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY abs(importance) DESC, pos) AS imp_rank "
    f"FROM ({_sql_conv_tokens()}) t) r WHERE imp_rank <= {TOP_IMPORTANCE_WORDS}"))
def q_top_importances(spark, sf_dir):
    """The 7 most important tokens of every turn (stable by position)."""
    t = XP.top_rows(_conv_verdicts(spark, sf_dir), CONV_KEY, "text", "label")
    return t.select(*CONV_KEY, "pos", "token", F.round("importance", 6).alias("importance"), "imp_rank")


def _sql_msg_tokens() -> str:
    src = f"(SELECT m.msg_id, m.text, v.label, v.is_phishing FROM {sub('v_messages')} m JOIN ({oracle_triage_messages()}) v USING (msg_id)) mv"
    rows = sql_token_rows(src, "msg_id", "text", ", label, is_phishing")
    return f"SELECT *, {sql_importance('token', sql_target('label'))} AS importance FROM ({rows}) r"


SQL_OVERLAP = "len(list_filter(spans, lambda s: char_offset < s['end'] AND char_offset + length(token) > s['start'])) > 0"


@query("span_overlap", lambda: (
    f"SELECT msg_id, CAST(pos AS INTEGER) AS pos, token, CAST(char_offset AS BIGINT) AS char_offset FROM "
    f"({sql_token_rows(sub('v_messages'), 'msg_id', 'text')}) t WHERE {SQL_OVERLAP}"))
def q_span_overlap(spark, sf_dir):
    """Tokens whose character range overlaps a URL span of their message."""
    m = view(spark, sf_dir, "v_messages").select("msg_id", "text")
    hit = let(XP.url_spans(F.col("text")), lambda spans: XP.overlapping(XP.tokens(F.col("text")), spans))
    return m.select("msg_id", F.inline(hit))


@query("highlight_tokens", lambda: (
    f"SELECT msg_id, CAST(pos AS INTEGER) AS pos, token, round(importance, 6) AS importance, imp_rank <= {TOP_IMPORTANCE_WORDS} AS is_top, "
    f"{SQL_OVERLAP} AS is_url, CASE WHEN is_phishing THEN 'red' ELSE 'green' END AS color FROM "
    f"(SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY abs(importance) DESC, pos) AS imp_rank FROM ({_sql_msg_tokens()}) t) r "
    f"WHERE imp_rank <= {TOP_IMPORTANCE_WORDS} OR {SQL_OVERLAP}"), headline=True)
def q_highlight_tokens(spark, sf_dir):
    """Tokens to highlight per message (top-7 or inside a URL) and the
    verdict colour."""
    v = triage_messages(view(spark, sf_dir, "v_messages"), carry=("text",)).select("msg_id", "text", "label", "is_phishing")
    h = XP.highlight(v, ["msg_id"], "text", "label")
    return h.select("msg_id", "pos", "token", F.round("importance", 6).alias("importance"), "is_top", "is_url", "color")
