"""Integrity checks over the case tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill.operators import quality as Q
from casemill.plans.registry import query


@query("duplicate_keys", "Q1", """SELECT 'facts' AS tab, count(*) AS n FROM (SELECT request_id, ordinal FROM @facts GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT 'courses', count(*) FROM (SELECT course_code FROM @courses GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'committee', count(*) FROM (SELECT 1 FROM @committee GROUP BY request_id, reviewer_id, review_cycle HAVING count(*) > 1)""")
def duplicate_keys(t):
    parts = [("facts", t.facts, ["request_id", "ordinal"]), ("courses", t.courses, ["course_code"]),
             ("committee", t.committee, ["request_id", "reviewer_id", "review_cycle"])]
    out = None
    for name, df, key in parts:
        n = Q.duplicate_keys(df, key).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tab"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("voters_off_committee", "Q2", """SELECT vote_id, request_id FROM @votes v WHERE NOT EXISTS (SELECT 1 FROM @committee c
  WHERE c.request_id = v.request_id AND c.review_cycle = v.review_cycle AND c.reviewer_id = v.voter_id)""")
def voters_off_committee(t):
    votes = t.votes.withColumn("reviewer_id", F.col("voter_id"))
    return Q.orphans(votes, t.committee, ["request_id", "review_cycle", "reviewer_id"]).select("vote_id", "request_id")


@query("orphan_documents", "Q2", """SELECT doc_id, request_id FROM @case_documents d WHERE request_id NOT IN (SELECT request_id FROM @facts)""")
def orphan_documents(t):
    return Q.orphans(t.case_documents, t.facts, ["request_id"]).select("doc_id", "request_id")


@query("double_votes", "Q3", """SELECT request_id, review_cycle, voter_id, count(*) AS n FROM @votes GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def double_votes(t):
    return Q.double_votes(t.votes)


@query("conflicted_voters", "Q3", """SELECT v.vote_id, 'vote' AS kind FROM @votes v JOIN @requests r ON r.request_id = v.request_id AND r.assigned_reviewer_id = v.voter_id
UNION ALL SELECT a.review_action_id, 'review' FROM @review_actions a JOIN @requests r ON r.request_id = a.request_id AND r.assigned_reviewer_id <> a.reviewer_id""")
def conflicted_voters(t):
    votes = Q.self_votes(t.votes, t.requests).select("vote_id", F.lit("vote").alias("kind"))
    reviews = Q.foreign_reviews(t.review_actions, t.requests).select(F.col("review_action_id").alias("vote_id"), F.lit("review").alias("kind"))
    return votes.unionByName(reviews)


@query("illegal_states", "Q4", """SELECT request_id, 'status' AS problem FROM @requests WHERE status = 'archived'
UNION ALL SELECT vote_id, 'vote' FROM @votes v JOIN @requests r ON r.request_id = v.request_id WHERE r.status <> 'pending_committee'
UNION ALL SELECT request_id, 'decide' FROM @requests WHERE coalesce(status NOT IN ('ready_for_decision', 'ai_recommendation'), true)""")
def illegal_states(t):
    bad = Q.outside_domain(t.requests, "status", Q.CASE_STATUSES).select("request_id", F.lit("status").alias("problem"))
    votes = Q.illegal_votes(t.votes, t.requests).select(F.col("vote_id").alias("request_id"), F.lit("vote").alias("problem"))
    closed = Q.undecidable(t.requests).select("request_id", F.lit("decide").alias("problem"))
    return bad.unionByName(votes).unionByName(closed)


@query("run_validation", "A4 Q5", """WITH latest AS (SELECT request_id, extraction_run_id, status FROM @extraction_runs
  QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY created_at DESC, extraction_run_id DESC) = 1),
runs AS (SELECT request_id, extraction_run_id FROM latest),
ev AS (SELECT r.extraction_run_id, count(*) AS n_evidence, count(*) FILTER (WHERE is_unknown) AS n_unknown, count(*) FILTER (WHERE ordinal % 7 = 0) AS n_uncited
  FROM @facts f JOIN runs r ON r.request_id = f.request_id GROUP BY 1),
ch AS (SELECT r.extraction_run_id, count(*) AS n_chunks FROM @doc_pages p JOIN runs r ON r.request_id = p.request_id GROUP BY 1)
SELECT l.request_id, l.extraction_run_id, l.status, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_evidence, 0) AS n_evidence,
  coalesce(n_unknown, 0) AS n_unknown, coalesce(n_uncited, 0) AS n_uncited, coalesce(n_uncited, 0) = 0 AS passed
FROM latest l LEFT JOIN ev ON ev.extraction_run_id = l.extraction_run_id LEFT JOIN ch ON ch.extraction_run_id = l.extraction_run_id""")
def run_validation(t):
    from casemill.operators.common import newest_per

    runs = newest_per(t.extraction_runs.select("request_id", "extraction_run_id", "created_at"), ["request_id"],
                      ["created_at", "extraction_run_id"]).select("request_id", "extraction_run_id")
    evidence = t.facts.join(runs, "request_id")
    chunks = t.doc_pages.join(runs, "request_id")
    return Q.run_validation(t.extraction_runs, chunks, evidence, t.facts.filter("ordinal % 7 <> 0").select("evidence_id"))
