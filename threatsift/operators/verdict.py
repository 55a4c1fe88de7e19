"""Per-message verdict by precedence (V1-V6).

Inputs are flat prediction tables:

* email predictions: ``msg_id, is_phishing, confidence, message,
  p_phishing, p_spam, p_legitimate`` (scores nullable = no class scores);
* URL predictions: ``msg_id, url_pos, is_phishing, confidence, message,
  p_phishing, p_legitimate``.

The URL side is reduced with one hash aggregation per message using
``min_by`` / ``max_by`` (partial + final, so a message with millions of URLs
never gathers them in one place); the email side joins on ``msg_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatsift.settings import (
    DEFAULT,
    MSG_UNKNOWN,
    MSG_URL_ONLY_DEFAULT,
    MSG_URL_OVERRIDE_NO_SCORES,
    REASON_EMAIL,
    REASON_EMAIL_BODY,
    REASON_URL,
    REASON_URL_OVERRIDE,
    Settings,
)

VERDICT_COLUMNS = ("label", "confidence", "is_phishing", "reason")
URL_PRED_FIELDS = ("is_phishing", "confidence", "message", "p_phishing", "p_legitimate")


def pct(c) -> Column:
    """'12.34' for 0.1234: fixed two decimals of c*100 via integer
    arithmetic, so the text is identical in every engine."""
    n = F.round(c * F.lit(10000)).cast("long")
    return F.format_string("%d.%02d", (n / F.lit(100)).cast("long"), n % F.lit(100))


def score_part(name: str, c) -> Column:
    """'Phishing: 12.34%' or NULL when the score is missing."""
    return F.when(c.isNotNull(), F.concat(F.lit(f"{name.capitalize()}: "), pct(c), F.lit("%")))


def reason_parts(*named) -> Column:
    """Present scores in fixed class order, comma-joined."""
    return F.concat_ws(", ", *[score_part(n, c) for n, c in named])


def url_aggregates(url_preds: DataFrame, settings: Settings = DEFAULT, key: str = "msg_id") -> DataFrame:
    """V1 + V4 inputs per message: first qualifying phishing URL in order,
    and the highest-confidence URL (first on ties)."""
    pred = F.struct(*[F.col(c) for c in URL_PRED_FIELDS], F.col("url_pos"))
    conf = F.coalesce(F.col("confidence"), F.lit(0.0))
    qualifies = F.coalesce(F.col("is_phishing"), F.lit(False)) & (conf >= F.lit(settings.url_override_threshold))
    return url_preds.groupBy(key).agg(
        F.min_by(pred, F.when(qualifies, F.col("url_pos"))).alias("ovr"),
        F.max_by(pred, F.struct(conf, -F.col("url_pos"))).alias("top"),
        F.count(F.lit(1)).alias("n_urls"),
    )


def _branch(label, confidence, is_phishing, reason) -> Column:
    return F.struct(
        label.alias("label"),
        confidence.cast("double").alias("confidence"),
        is_phishing.alias("is_phishing"),
        reason.alias("reason"),
    )


def verdict_struct(e_present: Column, e: dict, ovr: Column, top: Column) -> Column:
    """V6 as one expression: V1 -> V2/V3 -> V4 -> V5."""
    # V1: URL override
    ovr_scored = ovr["p_phishing"].isNotNull() | ovr["p_legitimate"].isNotNull()
    v1 = _branch(
        F.lit("Phishing"), ovr["confidence"], F.lit(True),
        F.when(ovr_scored, F.concat(F.lit(REASON_URL_OVERRIDE),
                                    reason_parts(("phishing", ovr["p_phishing"]), ("legitimate", ovr["p_legitimate"]))))
        .otherwise(F.lit(MSG_URL_OVERRIDE_NO_SCORES)),
    )
    # V2: argmax of class scores (missing keys count as 0; ties phishing > spam)
    has_scores = e["p_phishing"].isNotNull() | e["p_spam"].isNotNull() | e["p_legitimate"].isNotNull()
    p = F.coalesce(e["p_phishing"], F.lit(0.0))
    s = F.coalesce(e["p_spam"], F.lit(0.0))
    l_ = F.coalesce(e["p_legitimate"], F.lit(0.0))
    v2_label = F.when((p >= s) & (p >= l_), F.lit("Phishing")).when(s >= l_, F.lit("Spam")).otherwise(F.lit("Legitimate"))
    v2_reason = F.concat(F.lit(REASON_EMAIL), reason_parts(
        ("phishing", e["p_phishing"]), ("spam", e["p_spam"]), ("legitimate", e["p_legitimate"])))
    # V3: no scores -> flag, then message text
    v3_label = (F.when(F.coalesce(e["is_phishing"], F.lit(False)), F.lit("Phishing"))
                .when(F.lower(F.coalesce(e["message"], F.lit(""))).contains("spam"), F.lit("Spam"))
                .otherwise(F.lit("Legitimate")))
    e_label = F.when(has_scores, v2_label).otherwise(v3_label)
    e_reason = F.when(has_scores, v2_reason).otherwise(F.concat(F.lit(REASON_EMAIL_BODY), v3_label))
    v2v3 = _branch(e_label, F.coalesce(e["confidence"], F.lit(0.0)), e_label == F.lit("Phishing"), e_reason)
    # V4: URL only
    top_scored = top["p_phishing"].isNotNull() | top["p_legitimate"].isNotNull()
    top_ph = F.coalesce(top["is_phishing"], F.lit(False))
    v4 = _branch(
        F.when(top_ph, F.lit("Phishing")).otherwise(F.lit("Legitimate")),
        F.coalesce(top["confidence"], F.lit(0.0)), top_ph,
        F.when(top_scored, F.concat(F.lit(REASON_URL),
                                    reason_parts(("phishing", top["p_phishing"]), ("legitimate", top["p_legitimate"]))))
        .otherwise(F.coalesce(top["message"], F.lit(MSG_URL_ONLY_DEFAULT))),
    )
    v5 = _branch(F.lit("Unknown"), F.lit(0.0), F.lit(False), F.lit(MSG_UNKNOWN))
    return (F.when(ovr.isNotNull(), v1)
            .when(F.coalesce(e_present, F.lit(False)), v2v3)
            .when(top.isNotNull(), v4)
            .otherwise(v5))


E_FIELDS = (("is_phishing", "boolean"), ("confidence", "double"), ("message", "string"),
            ("p_phishing", "double"), ("p_spam", "double"), ("p_legitimate", "double"))
URL_STRUCT = ("struct<is_phishing:boolean,confidence:double,message:string,"
              "p_phishing:double,p_legitimate:double,url_pos:int>")


def email_columns(preds: DataFrame | None = None) -> list[Column]:
    """The e_* columns a verdict reads, from prediction columns of the same
    row (``preds`` None -> typed NULLs, i.e. no email model)."""
    if preds is None:
        return [F.lit(None).cast("boolean").alias("_e")] + [
            F.lit(None).cast(t).alias(f"e_{c}") for c, t in E_FIELDS]
    return [F.lit(True).alias("_e")] + [F.col(c).cast(t).alias(f"e_{c}") for c, t in E_FIELDS]


def verdict(messages: DataFrame, url_preds: DataFrame | None,
            settings: Settings = DEFAULT, key: str = "msg_id") -> DataFrame:
    """V6 over tables. ``messages`` has the key and the e_* columns (see
    ``email_columns``); ``url_preds`` one row per URL occurrence."""
    base = messages
    if url_preds is not None:
        base = base.join(url_aggregates(url_preds, settings, key), key, "left")
    else:
        base = base.select("*", F.lit(None).cast(URL_STRUCT).alias("ovr"), F.lit(None).cast(URL_STRUCT).alias("top"),
                           F.lit(0).cast("long").alias("n_urls"))
    e = {c: F.col(f"e_{c}") for c, _ in E_FIELDS}
    v = verdict_struct(F.col("_e"), e, F.col("ovr"), F.col("top"))
    return base.select(key, v.alias("v")).select(key, *[F.col("v")[c].alias(c) for c in VERDICT_COLUMNS])
