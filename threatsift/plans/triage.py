"""Whole scoring paths as DataFrame transforms (V7 email path, V8 URL path).

The same transforms serve batch tables and streaming micro-batches.

Plan shapes for ``triage_messages`` (one row per message in, one out):

* native scorers (default): ONE narrow projection over ONE scan. Every URL of
  a message lives in that message's row, so the URL predictions are an
  array built with ``transform`` and V1 / V4 are array reductions
  (``filter`` + first element, and a running max). No shuffle, no sort, no
  join; the stage is a single map task per input split.
* expensive scorers (pandas UDF models): URL occurrences are exploded once
  and reliably checkpointed; each distinct URL is scored once (J4) and the
  predictions are joined back and reduced per message with partial
  ``min_by`` / ``max_by`` aggregation, then joined to the email side.

Only fixed-width prediction columns cross shuffles; message text never does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatsift.functions.text import extract_urls, trim_input
from threatsift.functions.urls import is_allowlisted, normalize_url, url_domain
from threatsift.operators.explain import scored, target_class
from threatsift.operators.scoring import LexicalScorer, Scorer
from threatsift.operators.verdict import E_FIELDS, URL_STRUCT, VERDICT_COLUMNS, email_columns, verdict, verdict_struct
from threatsift.session import cut_lineage
from threatsift.settings import DEFAULT, MSG_ALLOWLIST, Settings

URL_PRED_COLUMNS = ("is_phishing", "confidence", "message", "p_phishing", "p_legitimate")


def url_occurrences(df: DataFrame, text_col: str = "text", key: str = "msg_id",
                    settings: Settings = DEFAULT, carry: tuple[str, ...] = ()) -> DataFrame:
    """T4 + T5 + T7 + T11 + J1: one row per URL occurrence with its
    position, normalised form, domain and allowlist flag, and the ``carry``
    columns of its message."""
    occ = df.select(key, *carry, F.posexplode(extract_urls(F.col(text_col))).alias("url_pos", "raw_url"))
    occ = occ.withColumn("norm_url", normalize_url(F.col("raw_url"), settings))
    occ = occ.withColumn("domain", url_domain(F.col("norm_url"), settings.strict_host))
    return occ.withColumn("allowlisted", is_allowlisted(F.col("domain"), settings))


def allowlisted_prediction(settings: Settings = DEFAULT) -> dict:
    return {
        "is_phishing": F.lit(False),
        "confidence": F.lit(settings.allowlist_confidence),
        "message": F.lit(MSG_ALLOWLIST),
        "p_phishing": F.lit(None).cast("double"),
        "p_legitimate": F.lit(None).cast("double"),
    }


def url_predictions(occ: DataFrame, scorer: Scorer, key: str = "msg_id",
                    settings: Settings = DEFAULT, dedupe: bool | None = None) -> DataFrame:
    """J2 + J3 + J4: allowlisted occurrences get the fixed safe prediction;
    the rest are scored. Expensive scorers see each distinct URL once and
    their predictions are joined back; cheap native ones score in place."""
    dedupe = scorer.expensive if dedupe is None else dedupe
    allow = allowlisted_prediction(settings)
    occ = occ.filter(F.col("norm_url").isNotNull())  # unparseable URLs are not scored
    if dedupe:
        distinct_urls = occ.filter(~F.col("allowlisted")).select("norm_url").distinct()
        scored = scorer.predict(distinct_urls, "norm_url", settings).select(
            "norm_url", *[F.col(c).alias(f"s_{c}") for c in URL_PRED_COLUMNS])
        # known-safe occurrences go around the join: their domains are its hottest keys
        joined = occ.filter(~F.col("allowlisted")).join(scored, "norm_url", "left")
        known = occ.filter(F.col("allowlisted")).select(key, "url_pos", "norm_url", "allowlisted", *[allow[c].alias(c) for c in URL_PRED_COLUMNS])
        return joined.select(key, "url_pos", "norm_url", "allowlisted",
                             *[F.col(f"s_{c}").alias(c) for c in URL_PRED_COLUMNS]).unionByName(known)
    scored = scorer.predict(occ, "norm_url", settings)
    cols = [F.when(F.col("allowlisted"), allow[c]).otherwise(F.col(c)).alias(c) for c in URL_PRED_COLUMNS]
    return scored.select(key, "url_pos", "norm_url", "allowlisted", *cols)


def email_predictions(df: DataFrame, scorer: Scorer, text_col: str = "text", key: str = "msg_id",
                      settings: Settings = DEFAULT) -> DataFrame:
    """Email model over the stripped, lowercased body: key + e_* columns."""
    body = df.select(key, trim_input(F.col(text_col), lowercase=True).alias("_body"))
    preds = scorer.predict(body, "_body", settings)
    return preds.select(key, *email_columns(preds))


def _prediction_from_norm(norm: Column, pos: Column, scorer: Scorer, settings: Settings) -> Column:
    """The prediction of one normalised URL; cues and host are looked up once."""
    allow = is_allowlisted(url_domain(norm, settings.strict_host), settings)
    safe = allowlisted_prediction(settings)

    def chosen(d):
        return F.struct(*[d[c].alias(c) for c in URL_PRED_COLUMNS], pos.cast("int").alias("url_pos")).cast(URL_STRUCT)
    return F.when(allow, chosen(safe)).otherwise(scorer.column_struct(norm, settings, chosen))


def url_prediction_array(urls: Column, scorer: Scorer, settings: Settings = DEFAULT) -> Column:
    """In-row URL predictions (T7 + T11 + J1 + M3) of an array of raw URLs,
    in order; unparseable URLs are dropped. Normalisation runs once per URL
    into a lambda variable that the scoring step then references, so the
    expression is not copied per use."""
    norms = F.transform(urls, lambda u, i: F.struct(normalize_url(u, settings).alias("norm"), i.alias("pos")))
    valid = F.filter(norms, lambda n: n["norm"].isNotNull())
    return F.transform(valid, lambda n: _prediction_from_norm(n["norm"], n["pos"], scorer, settings))


def url_reductions(preds: Column, settings: Settings = DEFAULT) -> tuple[Column, Column]:
    """V1 and V4 inputs from an in-row array of URL predictions: the first
    qualifying phishing URL in order, and the highest-confidence URL (first
    on ties)."""
    thr = F.lit(settings.url_override_threshold)
    conf = lambda p: F.coalesce(p["confidence"], F.lit(0.0))
    ovr = F.try_element_at(F.filter(preds, lambda p: F.coalesce(p["is_phishing"], F.lit(False)) & (conf(p) >= thr)), F.lit(1))
    first = F.try_element_at(preds, F.lit(1))
    top = F.aggregate(F.slice(preds, 2, F.greatest(F.size(preds), F.lit(1))), first,
                      lambda acc, p: F.when(conf(p) > conf(acc), p).otherwise(acc))
    return ovr, top


def _finish(df: DataFrame, key: str, e_present: Column, e: dict, settings: Settings,
            carry: tuple[str, ...] = ()) -> DataFrame:
    """_preds -> (ovr, top) -> verdict, one projection each."""
    ovr, top = url_reductions(F.col("_preds"), settings)
    keep = [c for c in df.columns if c not in (key, "_preds", *carry)]
    r = df.select(key, *carry, *keep, ovr.alias("_ovr"), top.alias("_top"))
    v = verdict_struct(e_present, e, F.col("_ovr"), F.col("_top"))
    r = r.select(key, *carry, v.alias("_v"))
    # The verdict columns come out of a one-row generator: a filter on them
    # (e.g. one verdict branch) stays above it, instead of being pushed down
    # and inlining the whole staged scoring expression into the predicate.
    out = F.struct(*[F.col("_v")[c].alias(c) for c in VERDICT_COLUMNS])
    return r.select(key, F.inline(F.array(out)), *carry)


def _narrow(scorer: Scorer | None) -> bool:
    return scorer is not None and not scorer.expensive and scorer.column_predict(F.lit("")) is not None


def triage_messages(df: DataFrame, email_scorer: Scorer | None = None, url_scorer: Scorer | None = None,
                    text_col: str = "text", key: str = "msg_id", settings: Settings = DEFAULT,
                    carry: tuple[str, ...] = (), with_email: bool = True) -> DataFrame:
    """V7: verdict per message from its body and every URL in it.
    Output: key, label, confidence, is_phishing, reason, then the ``carry``
    columns of the input passed through unchanged. ``with_email=False`` runs
    the URL model alone (no email prediction: V1/V4/V5)."""
    email_scorer = email_scorer or LexicalScorer("email", lowercased=True)
    url_scorer = url_scorer or LexicalScorer("url")
    carry = tuple(carry)
    msgs = df.select(key, *carry, trim_input(F.col(text_col)).alias("_clean"))
    if not with_email:
        if not _narrow(url_scorer):
            base = msgs.select(key, *email_columns(None))
            preds = url_predictions(cut_lineage(url_occurrences(msgs.select(key, "_clean"), "_clean", key, settings)),
                                    url_scorer, key, settings)
            v = verdict(base, preds, settings, key)
            return v.join(df.select(key, *carry), key) if carry else v
        u = msgs.select(key, *carry,
                        url_prediction_array(extract_urls(F.col("_clean")), url_scorer, settings).alias("_preds"))
        return _finish(u, key, F.lit(None).cast("boolean"), {c: F.lit(None).cast(t) for c, t in E_FIELDS},
                       settings, carry)
    if _narrow(url_scorer):
        body = msgs.select(key, *carry, "_clean", F.lower(F.col("_clean")).alias("_body"))
        e = email_scorer.predict(body, "_body", settings)
        ecols = [c for c, _ in E_FIELDS]
        # successive projections keep each intermediate a named column
        e = e.select(key, *carry, *ecols,
                     url_prediction_array(extract_urls(F.col("_clean")), url_scorer, settings).alias("_preds"))
        return _finish(e, key, F.lit(True), {c: F.col(c) for c in ecols}, settings, carry)
    msgs_only = msgs.select(key, "_clean")
    e = email_predictions(msgs_only, email_scorer, "_clean", key, settings)
    occ = cut_lineage(url_occurrences(msgs_only, "_clean", key, settings))
    preds = url_predictions(occ, url_scorer, key, settings)
    v = verdict(e, preds, settings, key)
    # expensive scorers: the verdict is keyed by message; carried columns join back on the key
    return v.join(df.select(key, *carry), key) if carry else v


def triage_requests(df: DataFrame, email_scorer: Scorer | None = None, url_scorer: Scorer | None = None,
                    text_col: str = "text", key: str = "msg_id", type_col: str = "input_type", explain_col: str | None = None,
                    settings: Settings = DEFAULT, carry: tuple[str, ...] = ()) -> DataFrame:
    """Verdict per request of either input type, in one projection for native
    scorers: a ``url`` request is one URL judged by the URL model, an ``email``
    request a message judged with every URL in it; another type gets the
    Unknown verdict. With ``explain_col``, requests that ask for it carry
    ``word_importances``: every token of the text in order with its importance
    toward the verdict's class (null for the others)."""
    email_scorer = email_scorer or LexicalScorer("email", lowercased=True)
    url_scorer = url_scorer or LexicalScorer("url")
    carry = tuple(dict.fromkeys([*carry, *([text_col, explain_col] if explain_col else [])]))
    kind = F.coalesce(F.col(type_col), F.lit(""))
    if _narrow(url_scorer) and not email_scorer.expensive:
        body = df.select(key, *carry, kind.alias("_kind"), trim_input(F.col(text_col)).alias("_clean"))
        body = body.withColumn("_body", F.lower("_clean"))
        e = email_scorer.predict(body, "_body", settings)
        ecols = [c for c, _ in E_FIELDS]
        urls = (F.when(F.col("_kind") == "url", F.array(F.col("_clean"))).when(F.col("_kind") == "email", extract_urls(F.col("_clean")))
                .otherwise(F.array().cast("array<string>")))
        is_email = F.col("_kind") == "email"
        e = e.select(key, *carry, *[F.when(is_email, F.col(c)).alias(c) for c in ecols], is_email.alias("_is_email"),
                     url_prediction_array(urls, url_scorer, settings).alias("_preds"))
        out = _finish(e, key, F.col("_is_email"), {c: F.col(c) for c in ecols}, settings, carry)
    else:
        parts = [triage_messages(df.filter(kind == "email"), email_scorer, url_scorer, text_col, key, settings, carry),
                 triage_urls(df.filter(kind == "url"), url_scorer, text_col, key, settings, carry)]
        rest = df.filter(~kind.isin("email", "url"))
        parts.append(_finish(rest.select(key, *carry, F.array().cast(f"array<{URL_STRUCT}>").alias("_preds")), key,
                             F.lit(False), {c: F.lit(None).cast(t) for c, t in E_FIELDS}, settings, carry))
        out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    if not explain_col:
        return out
    words = F.transform(scored(F.col(text_col), target_class(F.col("label"))),
                        lambda t: F.struct(t["token"].alias("word"), t["importance"].alias("importance")))
    return out.withColumn("word_importances", F.when(F.col(explain_col), words))


def triage_urls(df: DataFrame, url_scorer: Scorer | None = None, text_col: str = "text",
                key: str = "msg_id", settings: Settings = DEFAULT, carry: tuple[str, ...] = ()) -> DataFrame:
    """V8: each input is one URL; verdict from the URL model alone (narrow
    for native scorers: one prediction per row, no grouping). ``carry``
    columns pass through as in ``triage_messages``."""
    url_scorer = url_scorer or LexicalScorer("url")
    carry = tuple(carry)
    if _narrow(url_scorer):
        one = url_prediction_array(F.array(trim_input(F.col(text_col))), url_scorer, settings)
        u = df.select(key, *carry, one.alias("_preds"))
        return _finish(u, key, F.lit(None).cast("boolean"), {c: F.lit(None).cast(t) for c, t in E_FIELDS},
                       settings, carry)
    if carry:
        return triage_urls(df, url_scorer, text_col, key, settings).join(df.select(key, *carry), key)
    occ = df.select(key, F.lit(0).alias("url_pos"), F.col(text_col).alias("raw_url"))
    occ = occ.withColumn("norm_url", normalize_url(trim_input(F.col("raw_url")), settings))
    occ = occ.withColumn("domain", url_domain(F.col("norm_url"), settings.strict_host))
    occ = occ.withColumn("allowlisted", is_allowlisted(F.col("domain"), settings))
    preds = url_predictions(occ, url_scorer, key, settings)
    msgs = df.select(key, *email_columns(None))
    return verdict(msgs, preds, settings, key)
