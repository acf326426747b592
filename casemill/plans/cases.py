"""Case, course and document queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from casemill.functions import text as X
from casemill.operators import cases as C
from casemill.operators import evidence as E
from casemill.operators import review as R
from casemill.operators.common import newest_per
from casemill.plans.registry import query
from casemill.session import shared_dir
from casemill.sources import buckets as B


def actions(t):
    """Review actions in stored form; submissions with an unknown action are refused."""
    return t.review_actions.withColumn("action", R.stored_action(F.col("action_api"))).filter("action IS NOT NULL")


ACTION_SQL = """CASE action_api WHEN 'APPROVE' THEN 'approve' WHEN 'DENY' THEN 'deny' WHEN 'REQUEST_INFO' THEN 'request_info'
  WHEN 'NEEDS_MORE_INFO' THEN 'request_info' WHEN 'APPROVE_WITH_BRIDGE' THEN 'approve_with_bridge' END"""
ACTIONS_SQL = f"acts AS (SELECT *, {ACTION_SQL} AS action FROM @review_actions WHERE action_api <> 'ESCALATE')"


@query("case_listing", "P1 L1", """SELECT request_id, student_id, status, created_at FROM @requests
WHERE status = 'reviewed' ORDER BY created_at DESC, request_id DESC""")
def case_listing(t):
    return C.list_cases(t.requests, status="reviewed").select("request_id", "student_id", "status", "created_at")


@query("committee_cases", "P1 J3", """SELECT r.request_id, r.status, r.created_at FROM @requests r WHERE EXISTS (
  SELECT 1 FROM @committee c WHERE c.request_id = r.request_id AND c.review_cycle = r.review_cycle AND c.reviewer_id = 7)""")
def committee_cases(t):
    return C.list_cases(t.requests, committee=t.committee, reviewer=7).select("request_id", "status", "created_at")


@query("department_courses", "P2", """SELECT course_code, display_name, credits FROM @courses
WHERE department ILIKE 'brand#1%' ORDER BY course_code""")
def department_courses(t):
    return t.courses.filter(F.col("department").ilike("brand#1%")).orderBy("course_code").select(
        "course_code", "display_name", "credits")


@query("course_search", "P3 P5", """SELECT course_id, course_code, display_name FROM @courses
WHERE (contains(lower(course_code), 'ring') OR contains(lower(display_name), 'ring')) AND credits = 3 AND NOT lab_required""")
def course_search(t):
    return C.search_courses(t.courses, "Ring", credits=3, lab=False).select("course_id", "course_code", "display_name")


@query("prerequisite_search", "P4", """SELECT course_id, prerequisites FROM @courses
WHERE (contains(lower(course_code), 'promo') OR contains(lower(display_name), 'promo') OR contains(lower(coalesce(prerequisites, '')), 'promo'))
  AND coalesce(prerequisites, '') <> ''""")
def prerequisite_search(t):
    return C.search_courses(t.courses, "PROMO", has_prerequisites=True, in_prerequisites=True).select("course_id", "prerequisites")


@query("reviewer_worklist", "P6", """SELECT v.reviewer_id, w.list, r.request_id, r.status, assigned_reviewer_id IS NULL AS unassigned FROM @requests r,
  (VALUES (3), (7)) v(reviewer_id), (VALUES ('pending'), ('reviewed'), ('all')) w(list) WHERE (assigned_reviewer_id IS NULL OR assigned_reviewer_id = v.reviewer_id)
  AND (list = 'all' OR list = 'pending' AND status IN ('ai_recommendation', 'ready_for_decision') OR list = 'reviewed' AND status = 'reviewed')""")
def reviewer_worklist(t):
    out = None
    for reviewer in (3, 7):
        for which in C.WORKLISTS:
            part = C.reviewer_worklist(t.requests, reviewer, which).select(
                F.lit(reviewer).alias("reviewer_id"), F.lit(which).alias("list"), "request_id", "status", F.col("assigned_reviewer_id").isNull().alias("unassigned"))
            out = part if out is None else out.unionByName(part)
    return out


@query("committee_worklist", "P7", """SELECT c.request_id, c.review_cycle, c.reviewer_id, r.status, NOT EXISTS (SELECT 1 FROM @votes v
  WHERE v.request_id = c.request_id AND v.review_cycle = c.review_cycle AND v.voter_id = c.reviewer_id) AS needs_vote
FROM @committee c JOIN @requests r ON r.request_id = c.request_id AND r.review_cycle = c.review_cycle""")
def committee_worklist(t):
    return R.committee_worklist(t.requests, t.committee, t.votes)


@query("ready_cases", "P8 J18", """WITH latest AS (SELECT request_id, extraction_run_id FROM @extraction_runs
  QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY created_at DESC, extraction_run_id DESC) = 1)
SELECT r.request_id, l.extraction_run_id FROM @requests r JOIN latest l ON l.request_id = r.request_id WHERE r.status = 'ready_for_decision'""")
def ready_cases(t):
    latest = newest_per(t.extraction_runs.select("request_id", "extraction_run_id", "created_at"), ["request_id"],
                        ["created_at", "extraction_run_id"])
    return t.requests.filter("status = 'ready_for_decision'").join(latest, "request_id").select("request_id", "extraction_run_id")


@query("status_counts", "A5 P9", """SELECT CASE status WHEN 'ready_for_decision' THEN status WHEN 'needs_info' THEN status
  WHEN 'review_pending' THEN status WHEN 'archived' THEN status ELSE upper(status) END AS status, count(*) AS n FROM @requests GROUP BY 1""")
def status_counts(t):
    return t.requests.groupBy(C.display_status(F.col("status")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("shown_statuses", "P10 W1", f"""WITH {ACTIONS_SQL},
la AS (SELECT request_id, action FROM acts QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY created_at DESC, review_action_id DESC) = 1),
tally AS (SELECT request_id, review_cycle, action, count(*) AS n FROM @votes GROUP BY ALL),
cd AS (SELECT request_id, review_cycle, action AS committee FROM tally QUALIFY row_number() OVER (PARTITION BY request_id, review_cycle
  ORDER BY n DESC, list_position(['deny', 'needs_more_info', 'approve_with_bridge', 'approve'], action)) = 1)
SELECT r.request_id, CASE WHEN r.status = 'committee_decided' AND committee IS NOT NULL THEN CASE committee WHEN 'approve' THEN 'APPROVED'
    WHEN 'deny' THEN 'DENIED' WHEN 'approve_with_bridge' THEN 'APPROVED WITH BRIDGE' ELSE 'NEEDS MORE INFO' END
  WHEN r.status IN ('committee_decided', 'reviewed') AND action IS NOT NULL THEN CASE action WHEN 'approve' THEN 'APPROVED'
    WHEN 'deny' THEN 'DENIED' WHEN 'approve_with_bridge' THEN 'APPROVED WITH BRIDGE' ELSE 'NEEDS MORE INFO' END
  ELSE upper(r.status) END AS shown
FROM @requests r LEFT JOIN la ON la.request_id = r.request_id
LEFT JOIN cd ON cd.request_id = r.request_id AND cd.review_cycle = r.review_cycle""")
def shown_statuses(t):
    latest = newest_per(actions(t).select("request_id", "action", "created_at", "review_action_id"), ["request_id"],
                        ["created_at", "review_action_id"]).select("request_id", "action")
    committee = R.plurality_decision(t.votes).select("request_id", "review_cycle", "committee_decision")
    return t.requests.join(latest, "request_id", "left").join(committee, ["request_id", "review_cycle"], "left").select(
        "request_id", C.resolved_status(F.col("status"), F.col("committee_decision"), F.col("action")).alias("shown"))


@query("review_actions_mapped", "P11 F16", f"""SELECT review_action_id, {ACTION_SQL} AS action, CASE {ACTION_SQL} WHEN 'approve' THEN 'APPROVE'
  WHEN 'deny' THEN 'DENY' WHEN 'request_info' THEN 'NEEDS_MORE_INFO' WHEN 'approve_with_bridge' THEN 'APPROVE_WITH_BRIDGE' END AS shown,
  {ACTION_SQL} IS NULL AS refused, CASE WHEN length(comment) > 160 THEN substr(comment, 1, 160) || '…' ELSE comment END AS preview
FROM @review_actions""")
def review_actions_mapped(t):
    stored = R.stored_action(F.col("action_api"))
    return t.review_actions.select("review_action_id", stored.alias("action"), R.api_action(stored).alias("shown"),
                                   stored.isNull().alias("refused"), X.clip(F.col("comment"), 160, "…").alias("preview"))


@query("document_kinds", "P13 L1 P16", """SELECT doc_id, filename, CASE WHEN contains(lower(filename), 'syllabus') THEN 'syllabus'
  WHEN contains(lower(filename), 'transcript') THEN 'transcript' ELSE 'catalog' END AS kind, lower(filename) LIKE '%.pdf' AS accepted,
  CASE WHEN contains(lower(filename), 'syllabus') THEN 0 WHEN contains(lower(filename), 'transcript') THEN 2 ELSE 1 END AS place FROM @case_documents""")
def document_kinds(t):
    kind = C.classify_document(F.col("filename"))
    return t.case_documents.select("doc_id", "filename", kind.alias("kind"), C.is_pdf(F.col("filename")).alias("accepted"),
                                   C.document_rank(kind).alias("place"))


@query("active_documents", "S5", """SELECT doc_id, request_id, filename FROM @case_documents WHERE is_active ORDER BY request_id, created_at, doc_id""")
def active_documents(t):
    return C.active_documents(t.case_documents).select("doc_id", "request_id", "filename")


@query("file_inventory", "S7", """SELECT doc_id, sha256(text) AS sha256, length(text) AS n_chars, strlen(text) AS size_bytes FROM @documents""")
def file_inventory(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha256"), F.length("text").alias("n_chars"),
                              F.octet_length("text").alias("size_bytes"))


@query("course_patches", "P14", """SELECT course_id, course_code, coalesce(CASE WHEN course_id % 3 = 0 THEN 'Renamed ' || course_code END, display_name) AS display_name,
  CASE WHEN course_id % 6 = 0 THEN NULL ELSE prerequisites END AS prerequisites FROM @courses""")
def course_patches(t):
    changes = t.courses.filter("course_id % 3 = 0").select(
        "course_id", F.concat(F.lit("Renamed "), "course_code").alias("display_name"),
        F.when(F.col("course_id") % 6 == 0, "").alias("prerequisites"))
    return C.patch(t.courses, changes, "course_id", ("prerequisites",)).select(
        "course_id", "course_code", "display_name", "prerequisites")


@query("usable_reviewers", "P15", """SELECT reviewer_id, reviewer_name, role FROM @reviewers
WHERE NOT is_deleted AND (expires_at IS NULL OR expires_at > DATE '2024-06-01')""")
def usable_reviewers(t):
    return C.usable_accounts(t.reviewers, F.lit("2024-06-01").cast("date")).select("reviewer_id", "reviewer_name", "role")


LINKS_SQL = """links AS (SELECT evidence_id, p_partkey AS chunk_uuid FROM @facts f JOIN @part ON f.request_id % (SELECT count(*) FROM @part) = p_partkey AND NOT is_unknown),
chunks AS (SELECT p_partkey AS chunk_uuid, p_size AS page_num, p_name AS snippet_text FROM @part)"""


def links(t):
    """What is known cites a chunk; an unknown fact has nothing to cite."""
    place = F.when(~F.col("is_unknown"), F.col("request_id") % t.part.agg(F.count(F.lit(1))).scalar())
    return t.facts.join(t.part, place == F.col("p_partkey")).select(
        "evidence_id", F.col("p_partkey").alias("chunk_uuid"))


@query("evidence_chunks", "J1", f"""WITH {LINKS_SQL} SELECT l.evidence_id, c.chunk_uuid, c.page_num, c.snippet_text FROM links l
JOIN chunks c ON c.chunk_uuid = l.chunk_uuid WHERE l.evidence_id IN (SELECT evidence_id FROM @facts WHERE fact_key = 'topics')""")
def evidence_chunks(t):
    chunks = t.part.select(F.col("p_partkey").alias("chunk_uuid"), F.col("p_size").alias("page_num"),
                           F.col("p_name").alias("snippet_text"))
    return E.chunks_of_evidence(t.facts.filter("fact_key = 'topics'"), links(t), chunks)


@query("uncited_evidence", "J2 Q5", f"""WITH {LINKS_SQL} SELECT evidence_id, fact_type, fact_key FROM @facts f
WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.evidence_id = f.evidence_id)""")
def uncited_evidence(t):
    return E.uncited(t.facts, links(t)).select("evidence_id", "fact_type", "fact_key")


@query("latest_decisions", "J4 W1", """SELECT d.request_id, d.decision_run_id, r.decision, r.equivalency_score FROM @decision_runs d
JOIN @decision_results r ON r.decision_run_id = d.decision_run_id WHERE d.status = 'completed'
QUALIFY row_number() OVER (PARTITION BY d.request_id ORDER BY d.created_at DESC, d.decision_run_id DESC) = 1""")
def latest_decisions(t):
    return C.latest_completed(t.decision_runs, t.decision_results).select(
        "request_id", "decision_run_id", "decision", "equivalency_score")


@query("new_courses", "J11 W2 S2", """WITH rows AS (SELECT l_linenumber, l_orderkey, ' CPSC-' || (l_partkey * 2) || ' ' AS code, l_shipdate, l_suppkey FROM @lineitem),
firsts AS (SELECT trim(code) AS course_code, l_orderkey * 100000 + l_suppkey * 10 + l_linenumber AS pos FROM rows
  WHERE NOT EXISTS (SELECT 1 FROM @courses c WHERE c.course_code = trim(code)))
SELECT course_code, min(pos) AS pos, course_code AS display_name, 'General' AS department, 3 AS credits FROM firsts GROUP BY course_code""")
def new_courses(t):
    rows = t.lineitem.select(
        F.concat(F.lit(" CPSC-"), (F.col("l_partkey") * 2).cast("string"), F.lit(" ")).alias("course_code"),
        (F.col("l_orderkey") * 100000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("pos"))
    blank = F.lit("  ")
    rows = rows.select("course_code", "pos", blank.alias("title"), blank.alias("subject"), F.lit("n/a").alias("credits_min"),
                       blank.alias("prerequisites"), F.col("pos").cast("string").alias("description"))
    return C.import_courses(t.courses, rows, "pos").select(
        "course_code", F.col("description").cast("long").alias("pos"), "display_name", "department", "credits")


@query("courses_with_outcomes", "J7 S3 W2 T16", """WITH o AS (SELECT 'CPSC-' || (l_partkey * 2) AS course_code, 'Know line ' || l_linenumber || '., Use order ' || l_orderkey || '..' AS lo,
  l_shipdate, l_orderkey, l_suppkey, l_linenumber FROM @lineitem),
latest AS (SELECT course_code, lo FROM o QUALIFY row_number() OVER (PARTITION BY course_code ORDER BY l_shipdate DESC, l_orderkey DESC, l_suppkey DESC, l_linenumber DESC) = 1)
SELECT c.course_code, coalesce(lo, '') AS learning_outcomes, CASE WHEN lo IS NULL THEN '' ELSE
  array_to_string(list_transform(string_split(lo, '., '), lambda x: rtrim(trim(x), '.') || '.'), ' | ') END AS outcomes
FROM @courses c LEFT JOIN latest l ON l.course_code = c.course_code""")
def courses_with_outcomes(t):
    rows = t.lineitem.select(
        F.concat(F.lit("CPSC-"), (F.col("l_partkey") * 2).cast("string")).alias("course_code"),
        F.concat(F.lit("Know line "), F.col("l_linenumber").cast("string"), F.lit("., Use order "),
                 F.col("l_orderkey").cast("string"), F.lit("..")).alias("learning_outcomes"),
        F.struct("l_shipdate", "l_orderkey", "l_suppkey", "l_linenumber").alias("pos"))
    out = C.with_outcomes(t.courses.select("course_code"), rows, "pos")
    return out.select("course_code", "learning_outcomes",
                      F.array_join(X.outcome_list(F.col("learning_outcomes")), " | ").alias("outcomes"))


@query("round_robin_reviewers", "J17", """WITH r AS (SELECT request_id, row_number() OVER (ORDER BY request_id) - 1 AS i FROM @requests),
v AS (SELECT reviewer_id, row_number() OVER (ORDER BY reviewer_id) - 1 AS slot, count(*) OVER () AS n FROM @reviewers)
SELECT request_id, reviewer_id FROM r JOIN v ON r.i % v.n = v.slot""")
def round_robin_reviewers(t):
    return C.round_robin(t.requests, t.reviewers)


@query("remaining_after_delete", "J14", """WITH gone AS (SELECT request_id FROM @requests WHERE status = 'invalid'),
x AS (SELECT 'votes' AS child, request_id FROM @votes UNION ALL SELECT 'review_actions', request_id FROM @review_actions
  UNION ALL SELECT 'case_documents', request_id FROM @case_documents UNION ALL SELECT 'facts', request_id FROM @facts)
SELECT child, count(*) AS n FROM x WHERE request_id NOT IN (SELECT request_id FROM gone) GROUP BY child""")
def remaining_after_delete(t):
    gone = t.requests.filter("status = 'invalid'")
    names = ("votes", "review_actions", "case_documents", "facts")
    kept = C.delete_cases(gone, {n: getattr(t, n).select("request_id") for n in names})
    out = None
    for name, df in kept.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("child"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("forgotten_reviewers", "J14", """SELECT request_id, CASE WHEN assigned_reviewer_id IN (SELECT reviewer_id FROM @reviewers WHERE is_deleted)
  THEN NULL ELSE assigned_reviewer_id END AS reviewer_id FROM @requests""")
def forgotten_reviewers(t):
    rows = t.requests.select("request_id", F.col("assigned_reviewer_id").alias("reviewer_id"))
    return C.forget(rows, t.reviewers.filter("is_deleted"), "reviewer_id")


@query("latest_run_votes", "J18 W1", """WITH latest AS (SELECT request_id, extraction_run_id FROM @extraction_runs
  QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY created_at DESC, extraction_run_id DESC) = 1)
SELECT e.request_id, e.extraction_run_id, e.status FROM @extraction_runs e JOIN latest l
  ON l.request_id = e.request_id AND l.extraction_run_id = e.extraction_run_id""")
def latest_run_votes(t):
    return C.latest_run_rows(t.extraction_runs, t.extraction_runs).select("request_id", "extraction_run_id", "status")


BUCKETS = 64


def bucketed(t, name: str, rows, key: list[str]) -> str:
    path = f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"
    B.write_buckets(rows, path, key, BUCKETS)
    return path


@query("chunk_upserts", "S12", """WITH n AS (SELECT doc_id + CASE WHEN n_chars % 4 = 0 THEN 1000000 ELSE 0 END AS doc_id, 'v2 ' || source AS snippet_text FROM @documents WHERE lang = 'en')
SELECT d.doc_id, coalesce(n.snippet_text, d.source) AS snippet_text FROM @documents d LEFT JOIN n ON n.doc_id = d.doc_id
UNION ALL SELECT doc_id, snippet_text FROM n WHERE doc_id NOT IN (SELECT doc_id FROM @documents)""")
def chunk_upserts(t):
    """Upserts into a bucketed table; the second, repeated run changes nothing."""
    path = bucketed(t, "chunks", t.documents.select("doc_id", F.col("source").alias("snippet_text")), ["doc_id"])
    moved = F.when(F.col("n_chars") % 4 == 0, 1000000).otherwise(0)
    new = t.documents.filter("lang = 'en'").select((F.col("doc_id") + moved).alias("doc_id"), F.concat(F.lit("v2 "), "source").alias("snippet_text"))
    for _ in range(2):
        B.change_buckets(t.spark, path, new, ["doc_id"], BUCKETS, lambda old, more: C.upsert(old, more, ["doc_id"], ["snippet_text"]))
    return B.read_buckets(t.spark, path)


@query("citation_inserts", "S12", """SELECT request_id, reviewer_id, 'old' AS origin FROM @committee WHERE review_cycle = 1
UNION ALL SELECT DISTINCT request_id, reviewer_id, 'new' FROM @committee c WHERE NOT EXISTS (SELECT 1 FROM @committee o
  WHERE o.review_cycle = 1 AND o.request_id = c.request_id AND o.reviewer_id = c.reviewer_id)""")
def citation_inserts(t):
    key = ["request_id", "reviewer_id"]
    path = bucketed(t, "citations", t.committee.filter("review_cycle = 1").select(*key, F.lit("old").alias("origin")), key)
    new = t.committee.select(*key).distinct().withColumn("origin", F.lit("new"))
    B.change_buckets(t.spark, path, new, key, BUCKETS, lambda old, more: C.upsert(old, more, key))
    return B.read_buckets(t.spark, path)


@query("reuploaded_documents", "S13", """WITH incoming AS (SELECT doc_id + 1000000 AS doc_id, request_id, filename, true AS is_active FROM @case_documents WHERE filename LIKE '%SYLLABUS%')
SELECT doc_id, request_id, filename, is_active AND request_id NOT IN (SELECT request_id FROM incoming) AS is_active FROM @case_documents
UNION ALL SELECT * FROM incoming""")
def reuploaded_documents(t):
    docs = t.case_documents.select("doc_id", "request_id", "filename", "is_active")
    path = bucketed(t, "documents", docs, ["request_id"])
    incoming = docs.filter("filename LIKE '%SYLLABUS%'").withColumns({"doc_id": F.col("doc_id") + 1000000, "is_active": F.lit(True)})
    B.change_buckets(t.spark, path, incoming, ["request_id"], BUCKETS, C.deactivate_previous)
    return B.read_buckets(t.spark, path)


@query("next_case_id", "A18", """SELECT 'CASE-' || CAST(max(request_id) + 1 AS VARCHAR) AS next_id FROM @requests""")
def next_case_id(t):
    ids = t.requests.select(F.concat(F.lit("CASE-"), F.lpad(F.col("request_id").cast("string"), 9, "0")).alias("case_id"))
    return C.next_id(ids, "case_id")


@query("course_page", "L2 L4", """SELECT course_code, department FROM @courses ORDER BY department, course_code LIMIT 25 OFFSET 50""")
def course_page(t):
    path, order = f"{shared_dir(t.spark)}/listing-{uuid.uuid4().hex}", ["department", "course_code"]
    C.write_listing(t.courses.select("course_code", "department"), order, path)
    return C.page(t.spark, path, order, 3, 25)


@query("next_course_page", "L2", """SELECT course_code, department FROM @courses WHERE (department, course_code) > (SELECT (department, course_code) FROM @courses ORDER BY department, course_code LIMIT 1 OFFSET 49)
ORDER BY department, course_code LIMIT 25""")
def next_course_page(t):
    rows, order = t.courses.select("course_code", "department"), ["department", "course_code"]
    last = None
    for _ in range(2):
        shown = C.page_after(rows, order, last, 25).collect()
        last = [shown[-1][c] for c in order]
    return C.page_after(rows, order, last, 25)


@query("course_facets", "L4", """SELECT DISTINCT 'department' AS facet, department AS value FROM @courses
UNION ALL SELECT DISTINCT 'credits', CAST(credits AS VARCHAR) FROM @courses""")
def course_facets(t):
    dept = t.courses.select(F.lit("department").alias("facet"), F.col("department").alias("value")).distinct()
    cred = t.courses.select(F.lit("credits").alias("facet"), F.col("credits").cast("string").alias("value")).distinct()
    return dept.unionByName(cred).orderBy("facet", "value")


@query("topic_previews", "F24 P14", """WITH c AS (SELECT course_id, list_filter(list_transform(string_split(topics_text, ','), lambda x: trim(x)), lambda x: x <> '') AS items FROM @courses)
SELECT course_id, CAST(len(items) AS INTEGER) AS n_items, array_to_string(items[1:2], ', ') || CASE WHEN len(items) > 2 THEN ' +' || (len(items) - 2) || ' more' ELSE '' END AS preview FROM c""")
def topic_previews(t):
    items = X.split_list(F.col("topics_text"))
    return t.courses.select("course_id", F.size(items).alias("n_items"), X.preview_list(items, 2).alias("preview"))


@query("case_code_union", "U2 F1 F2", """SELECT request_id, 'CPSC ' || student_id AS code FROM @requests
UNION SELECT request_id, 'CPSC ' || l_partkey FROM @facts JOIN @lineitem ON request_id = l_orderkey WHERE fact_key = 'grade'""")
def case_code_union(t):
    own = t.requests.select("request_id", X.catalog_code(F.concat(F.lit(" CPSC   "), F.col("student_id").cast("string"))).alias("code"))
    found = t.facts.filter("fact_key = 'grade'").select("request_id").join(
        t.lineitem.select(F.col("l_orderkey").alias("request_id"), "l_partkey"), "request_id").select(
        "request_id", F.concat(F.lit("CPSC "), F.col("l_partkey").cast("string")).alias("code"))
    return own.unionByName(found).distinct()


@query("case_details", "J20", f"""WITH {ACTIONS_SQL}, x AS (SELECT d.request_id, 'decision' AS section, d.decision_run_id AS ref_id, r.decision AS main FROM @decision_runs d JOIN @decision_results r
    ON r.decision_run_id = d.decision_run_id WHERE status = 'completed' QUALIFY row_number() OVER (PARTITION BY d.request_id ORDER BY d.created_at DESC, d.decision_run_id DESC) = 1),
p AS (SELECT request_id, 'case' AS section, CAST(request_id AS VARCHAR) AS ref_id, status AS main FROM @requests UNION ALL SELECT request_id, 'document', CAST(doc_id AS VARCHAR), filename FROM @case_documents
  UNION ALL SELECT request_id, 'evidence', evidence_id, fact_key FROM @facts UNION ALL SELECT request_id, section, CAST(ref_id AS VARCHAR), main FROM x
  UNION ALL SELECT request_id, 'audit', CAST(extraction_run_id AS VARCHAR), 'EXTRACTION' FROM @extraction_runs UNION ALL SELECT request_id, 'audit', CAST(decision_run_id AS VARCHAR), 'DECISION' FROM @decision_runs
  UNION ALL SELECT request_id, 'audit', CAST(review_action_id AS VARCHAR), upper(action) FROM acts UNION ALL SELECT request_id, 'audit', CAST(vote_id AS VARCHAR), 'VOTE' FROM @votes)
SELECT * FROM p WHERE request_id IN (SELECT request_id FROM @requests)""")
def case_details(t):
    audit = R.audit_timeline(t.extraction_runs, t.decision_runs, t.decision_results, actions(t), t.votes)
    rows = C.case_detail(t.requests.select("request_id", "status"),
                         t.case_documents.select("request_id", "created_at", "doc_id", "filename"),
                         t.facts.select("request_id", "ordinal", "evidence_id", "fact_key", "fact_value"),
                         C.latest_completed(t.decision_runs, t.decision_results).select("request_id", "decision_run_id", "decision"),
                         audit.drop("decision"))
    # One field of each body is read, by its section.
    main = F.coalesce(*[F.when(F.col("section") == name, F.get_json_object("body", f"$.{k}")) for name, k in zip(
        C.SECTIONS, ("status", "filename", "fact_key", "decision", "kind"))])
    return rows.select("request_id", "section", "ref_id", main.alias("main"))


PARTS_SQL = f"""{ACTIONS_SQL}, x AS (SELECT d.request_id, d.decision_run_id FROM @decision_runs d JOIN @decision_results r
    ON r.decision_run_id = d.decision_run_id WHERE status = 'completed' QUALIFY row_number() OVER (PARTITION BY d.request_id ORDER BY d.created_at DESC, d.decision_run_id DESC) = 1),
p AS (SELECT request_id, 0 AS place, NULL::TIMESTAMP AS tm, NULL::BIGINT AS seq, CAST(request_id AS VARCHAR) AS ref_id FROM @requests UNION ALL SELECT request_id, 1, created_at, doc_id, CAST(doc_id AS VARCHAR) FROM @case_documents
  UNION ALL SELECT request_id, 2, NULL, ordinal, evidence_id FROM @facts UNION ALL SELECT request_id, 3, NULL, NULL, CAST(decision_run_id AS VARCHAR) FROM x
  UNION ALL SELECT request_id, 4, created_at, NULL, CAST(extraction_run_id AS VARCHAR) FROM @extraction_runs UNION ALL SELECT request_id, 4, created_at, NULL, CAST(decision_run_id AS VARCHAR) FROM @decision_runs
  UNION ALL SELECT request_id, 4, created_at, NULL, CAST(review_action_id AS VARCHAR) FROM acts UNION ALL SELECT request_id, 4, created_at, NULL, CAST(vote_id AS VARCHAR) FROM @votes),
k AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY place, tm, seq, ref_id) - 1 AS i, count(*) OVER (PARTITION BY request_id) AS n FROM p WHERE request_id IN (SELECT request_id FROM @requests))"""


@query("case_objects", "J20", f"""WITH {PARTS_SQL} SELECT request_id, i // 40 AS chunk, CAST(ceil(any_value(n) / 40) AS BIGINT) AS n_chunks, any_value(n) AS n_parts,
  {", ".join(f"coalesce(string_agg(ref_id, ',' ORDER BY i) FILTER (WHERE place = {k}), '') AS {name}_refs" for k, name in enumerate(C.SECTIONS))} FROM k GROUP BY request_id, i // 40""")
def case_objects(t):
    audit = R.audit_timeline(t.extraction_runs, t.decision_runs, t.decision_results, actions(t), t.votes)
    parts = C.case_parts(t.requests.select("request_id", "status"),
                         t.case_documents.select("request_id", "created_at", "doc_id", "filename"),
                         t.facts.select("request_id", "ordinal", "evidence_id", "fact_key", "fact_value"),
                         C.latest_completed(t.decision_runs, t.decision_results).select("request_id", "decision_run_id", "decision"),
                         audit.drop("decision"))
    objects = C.case_objects(parts, 40)
    return objects.select("request_id", "chunk", "n_chunks", "n_parts", *[
        F.array_join(F.transform(f"{name}_rows", lambda r: r["ref_id"]), ",").alias(f"{name}_refs") for name in C.SECTIONS])
