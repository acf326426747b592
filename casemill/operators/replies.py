"""Model replies as an input table: parsed, capped and brought to the score bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.operators.decision import Policy

# ---- fixed values ----------------------------------------------------------
REPLY = ("decision STRING, confidence STRING, equivalency_score INT, evidence_quality_score INT, "
         "bridge_plan ARRAY<STRING>, bridge_plan_items ARRAY<STRUCT<text: STRING>>, missing_info_requests ARRAY<STRING>")
NO_CREDITS_CUT, NO_LAB_CUT = 20, 10
# ----------------------------------------------------------------------------


def score_caps(facts: DataFrame, targets: DataFrame) -> DataFrame:
    """Highest score a reply may give per case: 20 less without known credits, 10 less without a needed lab's proof."""
    known = ~F.col("is_unknown")
    seen = facts.groupBy("request_id").agg(
        F.bool_or((F.col("fact_key") == "credits_or_units") & known).alias("_credits"),
        F.bool_or(F.col("fact_key").isin("lab_component", "contact_hours_lab") & known).alias("_lab"))
    no_credits = ~F.coalesce("_credits", F.lit(False))
    no_lab = F.col("target_lab_required") & ~F.coalesce("_lab", F.lit(False))
    cap = 100 - F.when(no_credits, NO_CREDITS_CUT).otherwise(0) - F.when(no_lab, NO_LAB_CUT).otherwise(0)
    return targets.join(seen, "request_id", "left").select("request_id", cap.alias("score_cap"))


def banded(score: Column, policy: Policy) -> Column:
    return (F.when(score >= policy.approve_threshold, "APPROVE").when(score >= policy.bridge_threshold, "APPROVE_WITH_BRIDGE")
            .when(score >= policy.needs_info_threshold, "NEEDS_MORE_INFO").otherwise("DENY"))


def finish_replies(replies: DataFrame, policy: Policy) -> DataFrame:
    """Replies (reply JSON, score_cap, fallback_quality) with capped score, band decision and quality.

    The band overrides the decision the reply states, hard gaps or not.
    """
    r = replies.withColumn("_r", F.from_json("reply", REPLY))
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.least(F.coalesce("_r.equivalency_score", F.lit(0)), F.col("score_cap"))))
    own = F.coalesce("_r.evidence_quality_score", F.lit(0))
    quality = F.when(F.col("fallback_quality") > 0, F.col("fallback_quality")).otherwise(own)
    plan = F.when(F.size("_r.bridge_plan") > 0, F.col("_r.bridge_plan")).otherwise(
        F.coalesce(F.transform("_r.bridge_plan_items", lambda b: b["text"]), F.array().cast("array<string>")))
    return r.withColumns({
        "stated_decision": F.col("_r.decision"), "confidence": F.coalesce("_r.confidence", F.lit("MEDIUM")),
        "equivalency_score": score, "decision": banded(score, policy),
        "evidence_quality_score": F.greatest(F.lit(0), F.least(F.lit(100), quality)), "bridge_plan": plan,
    }).drop("_r")
