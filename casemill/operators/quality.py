"""Integrity checks that a database would enforce; each returns the offending rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.operators.common import newest_per

# ---- fixed values ----------------------------------------------------------
CASE_STATUSES = (
    "uploaded", "extracting", "ready_for_decision", "ai_recommendation", "needs_info", "review_pending", "reviewed",
    "pending_committee", "committee_decided", "invalid",
)
DECIDABLE_STATUSES = ("ready_for_decision", "ai_recommendation")
# ----------------------------------------------------------------------------


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys held by more than one row (Q1)."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphans(child: DataFrame, parent: DataFrame, key: list[str]) -> DataFrame:
    """Child rows whose non-null key has no parent (Q2)."""
    present = F.lit(True)
    for k in key:
        present = present & F.col(k).isNotNull()
    return child.filter(present).join(parent.select(*key), key, "left_anti")


def double_votes(votes: DataFrame) -> DataFrame:
    """Voters with more than one vote in a cycle (Q3)."""
    return duplicate_keys(votes, ["request_id", "review_cycle", "voter_id"])


def self_votes(votes: DataFrame, requests: DataFrame) -> DataFrame:
    """Votes cast by the case's assigned reviewer (Q3)."""
    assigned = requests.select("request_id", F.col("assigned_reviewer_id").alias("voter_id"))
    return votes.join(assigned, ["request_id", "voter_id"], "left_semi")


def foreign_reviews(actions: DataFrame, requests: DataFrame) -> DataFrame:
    """Review actions by someone other than the assigned reviewer (Q3)."""
    assigned = requests.filter("assigned_reviewer_id IS NOT NULL").select("request_id", "assigned_reviewer_id")
    return actions.join(assigned, "request_id").filter("reviewer_id <> assigned_reviewer_id")


def outside_domain(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """Rows whose value is not an allowed one (Q4)."""
    return df.filter(~F.col(column).isin(*allowed))


def illegal_votes(votes: DataFrame, requests: DataFrame) -> DataFrame:
    """Votes on cases that are not pending a committee (Q4)."""
    closed = requests.filter("status <> 'pending_committee'").select("request_id")
    return votes.join(closed, "request_id", "left_semi")


def undecidable(requests: DataFrame) -> DataFrame:
    """Cases that a decision run is refused for: only those ready for a decision or with one may be decided (Q4)."""
    return requests.filter(~F.coalesce(F.col("status").isin(*DECIDABLE_STATUSES), F.lit(False)))


def parse_checks(pages: DataFrame, case: str, least: int = 100, empty: int = 50) -> DataFrame:
    """Per case: documents whose text could be read, those that could not, and those that need OCR."""
    n = F.length(F.coalesce("text", F.lit("")))
    docs = pages.groupBy(case, "doc_id").agg((F.sum(n) >= least).alias("ok"), F.bool_and(n < empty).alias("ocr"))
    return docs.groupBy(case).agg(F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"), F.count_if("ocr").alias("needs_ocr"))


def run_validation(runs: DataFrame, chunks: DataFrame, evidence: DataFrame, citations: DataFrame) -> DataFrame:
    """Counts and verdict of the newest extraction run of each case (A4)."""
    run = "extraction_run_id"
    newest = newest_per(runs.select("request_id", run, "status", "created_at"), ["request_id"], ["created_at", run])
    per_chunk = chunks.groupBy(run).agg(F.count(F.lit(1)).alias("n_chunks"))
    cited = citations.select("evidence_id").distinct().withColumn("_cited", F.lit(True))
    per_fact = evidence.join(cited, "evidence_id", "left").groupBy(run).agg(
        F.count(F.lit(1)).alias("n_evidence"), F.count_if("is_unknown").alias("n_unknown"),
        F.count_if(F.col("_cited").isNull()).alias("n_uncited"))
    out = newest.join(per_chunk, run, "left").join(per_fact, run, "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_chunks", "n_evidence", "n_unknown", "n_uncited")}
    return out.withColumns(zero).withColumn("passed", F.col("n_uncited") == 0).select(
        "request_id", run, "status", *zero, "passed")
