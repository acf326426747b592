"""Review, committee, audit and retention queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill.operators import review as R
from casemill.plans.cases import ACTIONS_SQL, actions
from casemill.plans.registry import query


ADMITTED_SQL = """adm AS (SELECT v.* FROM @votes v WHERE EXISTS (SELECT 1 FROM @committee c WHERE c.request_id = v.request_id AND c.review_cycle = v.review_cycle
  AND c.reviewer_id = v.voter_id) QUALIFY row_number() OVER (PARTITION BY request_id, review_cycle, voter_id ORDER BY created_at, vote_id) = 1)"""


def admitted(t):
    return R.admitted_votes(t.votes, t.committee)


@query("admitted_votes", "Q3 ST4", f"WITH {ADMITTED_SQL} SELECT vote_id, request_id, review_cycle, voter_id, action FROM adm")
def admitted_votes(t):
    return admitted(t).select("vote_id", "request_id", "review_cycle", "voter_id", "action")


@query("committee_plurality", "A1", f"""WITH {ADMITTED_SQL}, tally AS (SELECT request_id, review_cycle, action, count(*) AS n FROM adm GROUP BY ALL)
SELECT request_id, review_cycle, CAST(sum(n) OVER (PARTITION BY request_id, review_cycle) AS BIGINT) AS n_votes, action AS committee_decision FROM tally
QUALIFY row_number() OVER (PARTITION BY request_id, review_cycle ORDER BY n DESC,
  list_position(['deny', 'needs_more_info', 'approve_with_bridge', 'approve'], action)) = 1""")
def committee_plurality(t):
    return R.plurality_decision(admitted(t))


@query("committee_final", "A2", f"""WITH {ADMITTED_SQL}, c AS (SELECT request_id, review_cycle, count(*) AS n_votes, count(*) FILTER (WHERE action = 'approve') AS a,
  count(*) FILTER (WHERE action = 'approve_with_bridge') AS b, count(*) FILTER (WHERE action = 'deny') AS d,
  count(*) FILTER (WHERE action = 'needs_more_info') AS n FROM adm GROUP BY 1, 2)
SELECT request_id, review_cycle, n_votes, CASE WHEN n > a + b AND n > d THEN 'needs_more_info' WHEN b > a AND b > d AND b > n THEN 'approve_with_bridge'
  WHEN a + b > d AND a + b > n THEN 'approve' ELSE 'deny' END AS final_decision FROM c""")
def committee_final(t):
    return R.final_decision(admitted(t))


@query("completed_votes", "A3", f"""WITH {ADMITTED_SQL}, m AS (SELECT request_id, review_cycle, count(*) AS n_members FROM @committee GROUP BY 1, 2),
v AS (SELECT request_id, review_cycle, count(*) AS n_votes FROM adm GROUP BY 1, 2)
SELECT m.request_id, m.review_cycle, n_members, n_votes FROM m JOIN v ON m.request_id = v.request_id AND m.review_cycle = v.review_cycle WHERE n_votes >= n_members""")
def completed_votes(t):
    return R.completed_votes(t.committee, admitted(t))


@query("committee_members", "J13", """SELECT c.request_id, c.review_cycle, c.reviewer_id, s.reviewer_name, EXISTS (SELECT 1 FROM @votes v WHERE v.request_id = c.request_id
  AND v.review_cycle = c.review_cycle AND v.voter_id = c.reviewer_id) AS has_voted FROM @committee c LEFT JOIN @reviewers s ON s.reviewer_id = c.reviewer_id""")
def committee_members(t):
    return R.committee_view(t.committee, t.votes, t.reviewers)


@query("drawn_committees", "W9 L5", """WITH r AS (SELECT reviewer_id, row_number() OVER (ORDER BY ('0x' || substr(md5('7:r:' || reviewer_id), 1, 12))::BIGINT, reviewer_id) - 1 AS seat, count(*) OVER () AS n FROM @reviewers),
c AS (SELECT request_id, assigned_reviewer_id, ('0x' || substr(md5('7:c:' || request_id), 1, 12))::BIGINT % (SELECT count(*) FROM @reviewers) AS start FROM @requests),
w AS (SELECT request_id, assigned_reviewer_id, k, (start + k) % (SELECT count(*) FROM @reviewers) AS seat FROM c, range(0, 4) t(k)),
j AS (SELECT w.request_id, r.reviewer_id, row_number() OVER (PARTITION BY w.request_id ORDER BY k) AS place FROM w JOIN r ON r.seat = w.seat
  WHERE w.assigned_reviewer_id IS NULL OR r.reviewer_id <> w.assigned_reviewer_id)
SELECT request_id, reviewer_id, CAST(place AS INTEGER) AS place FROM j WHERE place <= 3""")
def drawn_committees(t):
    return R.draw_committee(t.requests, t.reviewers, seed="7")


@query("review_cycles", "W10", f"""WITH {ACTIONS_SQL} SELECT review_action_id, request_id,
  CAST(row_number() OVER (PARTITION BY request_id ORDER BY created_at, review_action_id) AS INTEGER) AS review_cycle FROM acts""")
def review_cycles(t):
    return R.cycle_numbers(actions(t)).select("review_action_id", "request_id", "review_cycle")


@query("action_decision_links", "J19", f"""WITH {ACTIONS_SQL} SELECT a.request_id, a.review_action_id, d.decision_run_id FROM acts a
ASOF LEFT JOIN @decision_runs d ON d.request_id = a.request_id AND a.created_at >= d.created_at""")
def action_decision_links(t):
    return R.link_actions_to_runs(actions(t), t.decision_runs)


TIMELINE_SQL = f"""WITH {ACTIONS_SQL}
SELECT request_id, created_at AS at, 'AGENT' AS actor, 'EXTRACTION' AS kind, extraction_run_id AS ref_id,
  'Extraction run ' || status || coalesce(': ' || error_message, '') AS message, NULL AS decision FROM @extraction_runs
UNION ALL SELECT d.request_id, d.created_at, 'AGENT', 'DECISION', d.decision_run_id, 'Decision run ' || status || coalesce(': ' || error_message, ''), r.decision
  FROM @decision_runs d LEFT JOIN @decision_results r ON r.decision_run_id = d.decision_run_id
UNION ALL SELECT request_id, created_at, 'REVIEWER', upper(action), review_action_id, coalesce(nullif(comment, ''), 'Reviewer action: ' || action), NULL FROM acts
"""


@query("audit_timeline", "U1 J16", TIMELINE_SQL + " UNION ALL SELECT request_id, created_at, 'COMMITTEE', 'VOTE', vote_id, action, NULL FROM @votes")
def audit_timeline(t):
    return R.audit_timeline(t.extraction_runs, t.decision_runs, t.decision_results, actions(t), t.votes).orderBy("request_id", "at", "ref_id")


@query("activity_log", "U1", TIMELINE_SQL)
def activity_log(t):
    return R.audit_timeline(t.extraction_runs, t.decision_runs, t.decision_results, actions(t)).orderBy("request_id", "at", "ref_id")


EXPIRY_SQL = r"""lines AS (SELECT file_name, line_no, trim(line) AS line, CASE WHEN TRY_CAST(line AS JSON) IS NOT NULL AND json_valid(line) THEN json_extract_string(line, '$.expires_at') END AS x
  FROM @log_lines WHERE trim(line) <> ''),
marked AS (SELECT *, coalesce(CASE WHEN regexp_matches(x, '(Z|[+-]\d{2}:?\d{2})$') THEN CAST(x AS TIMESTAMPTZ) END < TIMESTAMPTZ '2024-05-01 00:00:00+00', false) AS expired FROM lines)"""


@query("expired_log_lines", "S6 ST6", f"WITH {EXPIRY_SQL} SELECT file_name, line_no, line, expired FROM marked")
def expired_log_lines(t):
    return R.mark_expired(t.log_lines, "2024-05-01").select("file_name", "line_no", "line", "expired")


@query("log_retention", "A16", f"""WITH {EXPIRY_SQL} SELECT file_name, count(*) AS n_lines, count(*) FILTER (WHERE expired) AS n_removed,
  bool_and(expired) AS emptied FROM marked GROUP BY file_name""")
def log_retention(t):
    return R.retention_counts(t.log_lines, "2024-05-01")


@query("document_retention", "ST7", """SELECT doc_id, coalesce(expires_at < DATE '2024-03-01', false) AND storage_uri <> '' AS purged,
  CASE WHEN coalesce(expires_at < DATE '2024-03-01', false) AND storage_uri <> '' THEN NULL ELSE storage_uri END AS storage_uri FROM @case_documents""")
def document_retention(t):
    return R.purge_documents(t.case_documents, F.lit("2024-03-01").cast("date")).select("doc_id", "purged", "storage_uri")
