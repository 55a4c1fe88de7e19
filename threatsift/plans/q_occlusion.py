"""Queries for importances by occlusion (M7) with the native scorers."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatsift.operators import occlusion as OC
from threatsift.operators.explain import TOKEN_PATTERN
from threatsift.operators.scoring import EMAIL_CLASSES, URL_CLASSES, LexicalScorer
from threatsift.plans import sqltext as S
from threatsift.plans.catalog import query
from threatsift.plans.views import view
from threatsift.settings import EMAIL_MAX_TOKENS, URL_MAX_TOKENS


def sql_occlusion(src: str, key: str, text: str, pattern: str, kind: str, classes: tuple, most: int) -> str:
    """Every variant of every text, scored by itself and joined to the whole."""
    names = ", ".join(f"p_{c}" for c in classes)
    scored = lambda e: ", ".join(f"{v} AS p_{k}" for k, v in S.lexical_scores(e, kind).items())
    pieces = f"(regexp_extract_all(coalesce({text}, ''), {S.lit(pattern)}, 0))[1:{most}]"
    t = f"(SELECT {key}, {pieces} AS ps FROM {src} q0)"
    whole = f"(SELECT {key}, {scored('x')} FROM (SELECT {key}, array_to_string(ps, '') AS x FROM {t} q1) q2)"
    best = " ".join(f"WHEN p_{c} = greatest({names}) THEN '{c}'" for c in classes)
    target = f"(SELECT *, CASE {best} END AS target FROM {whole} q3)"
    each = (f"(SELECT {key}, generate_subscripts(ps, 1) AS i, ps FROM {t} q4)")
    rest = "array_to_string(list_concat(ps[1:i - 1], ps[i + 1:]), '')"
    variants = (f"(SELECT {key}, i, token, {scored('x')} FROM "
                f"(SELECT {key}, i, ps[i] AS token, {rest} AS x FROM {each} q5) q6)")
    of = lambda a: "CASE w.target " + " ".join(f"WHEN '{c}' THEN {a}.p_{c}" for c in classes) + " END"
    keys = ", ".join(f"w.{k.strip()}" for k in key.split(","))
    return (f"SELECT {keys}, w.target, CAST(v.i - 1 AS INTEGER) AS pos, v.token, "
            f"round(abs({of('w')} - {of('v')}), 9) AS importance FROM {target} w JOIN {variants} v USING ({key})")


def _rounded(t, *key):
    return t.select(*key, "target", "pos", "token", F.round("importance", 9).alias("importance"))


@query("occlusion_importance", lambda: sql_occlusion(
    "conversations", "conv_id, turn", "text", TOKEN_PATTERN, "email", EMAIL_CLASSES, EMAIL_MAX_TOKENS - 2))
def q_occlusion_importance(spark, sf_dir):
    """M7 for any scorer: what each token of a conversation turn does to the
    score of the turn's best class, with the email scorer that is served."""
    c = view(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return _rounded(OC.occlusion(c, ["conv_id", "turn"], "text", LexicalScorer("email")), "conv_id", "turn")


@query("occlusion_url_importance", lambda: sql_occlusion(
    "pages", "page_id", "url", OC.URL_PIECE_PATTERN, "url", URL_CLASSES, URL_MAX_TOKENS - 2))
def q_occlusion_url_importance(spark, sf_dir):
    """M7 for URLs: pieces between separators, with the URL scorer."""
    p = view(spark, sf_dir, "pages").select("page_id", "url")
    return _rounded(OC.occlusion(p, ["page_id"], "url", LexicalScorer("url"), pieces=OC.url_pieces,
                                 max_pieces=URL_MAX_TOKENS - 2), "page_id")
