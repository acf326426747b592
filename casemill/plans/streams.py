"""Stream jobs run to the end over the driver's event table; each has a batch twin as its oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from casemill.operators import decision as D
from casemill.operators import evidence as E
from casemill.plans import decisions as Q
from casemill.plans.registry import query
from casemill.plans.standins import DEFS
from casemill.session import shared_dir
from casemill.sources import buckets as B
from casemill.sources import readers, writers
from casemill.streaming import jobs as J


def events(t):
    """The event table as a stream."""
    return t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/events*.parquet")


def out(t, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def from_stream(t, name: str):
    """A stand-in over the event stream rather than the event table."""
    view = f"cm_stream_{name}"
    events(t).createOrReplaceTempView(view)
    return t.spark.sql(DEFS[name].replace("@events", view))


@query("status_stream", "ST5", """SELECT user_id AS request_id, arg_max(event_type, ts) AS status, max(ts) AS since FROM @events GROUP BY user_id""")
def status_stream(t):
    path = out(t, "status")
    rows = events(t).withColumnRenamed("user_id", "request_id")
    J.run_updates(J.current_status(rows, "request_id", "event_type", "ts", "400 days", "400 days"), path).awaitTermination()
    return J.latest_updates(t.spark, path, ["request_id"])


@query("retention_stream", "ST6", """WITH l AS (SELECT line_no, trim(line) AS line FROM @log_lines WHERE trim(line) <> ''),
x AS (SELECT *, CASE WHEN json_valid(line) THEN json_extract_string(line, '$.expires_at') END AS x FROM l)
SELECT line_no, line FROM x WHERE NOT coalesce(CASE WHEN regexp_matches(x, '(Z|[+-]\\d{2}:?\\d{2})$') THEN CAST(x AS TIMESTAMPTZ) END < TIMESTAMPTZ '2024-05-01 00:00:00+00', false)""")
def retention_stream(t):
    path = out(t, "retention")
    J.run_to_table(J.unexpired(from_stream(t, "log_lines"), "2024-05-01"), path).awaitTermination()
    return t.spark.read.parquet(f"{path}/data").select("line_no", "line")


@query("packet_stream", "ST3", """SELECT DISTINCT user_id AS request_id, md5(event_type) AS inputs_hash FROM @events""")
def packet_stream(t):
    path = out(t, "packets")
    packets = events(t).select(F.col("user_id").alias("request_id"), F.md5("event_type").alias("inputs_hash"), F.col("ts").cast("timestamp").alias("ts"))
    J.run_to_table(J.once_per_input(packets, "ts", "400 days"), path).awaitTermination()
    return t.spark.read.parquet(f"{path}/data").select("request_id", "inputs_hash")


@query("vote_stream", "ST4 A2 A3", """WITH v AS (SELECT * FROM @votes QUALIFY row_number() OVER (PARTITION BY request_id, review_cycle, voter_id ORDER BY created_at, vote_id) = 1),
c AS (SELECT v.request_id, v.review_cycle, count(*) AS n_votes, count(*) FILTER (WHERE action = 'approve') AS a, count(*) FILTER (WHERE action = 'approve_with_bridge') AS b,
  count(*) FILTER (WHERE action = 'deny') AS d, count(*) FILTER (WHERE action = 'needs_more_info') AS n FROM v JOIN @committee k
  ON k.request_id = v.request_id AND k.review_cycle = v.review_cycle AND k.reviewer_id = v.voter_id GROUP BY 1, 2),
m AS (SELECT request_id, review_cycle, count(*) AS n_members FROM @committee GROUP BY 1, 2),
r AS (SELECT request_id, review_cycle, count(*) AS n_all FROM @votes GROUP BY 1, 2),
k AS (SELECT request_id, review_cycle FROM m UNION SELECT request_id, review_cycle FROM r),
x AS (SELECT k.request_id, k.review_cycle, coalesce(c.n_votes, 0) AS n_votes, coalesce(n_all, 0) - coalesce(c.n_votes, 0) AS n_rejected, coalesce(n_members, 0) AS n_members,
  coalesce(c.n_votes, 0) >= coalesce(n_members, 0) AND coalesce(n_members, 0) > 0 AS complete, a, b, d, n
  FROM k LEFT JOIN m ON m.request_id = k.request_id AND m.review_cycle = k.review_cycle LEFT JOIN c ON c.request_id = k.request_id AND c.review_cycle = k.review_cycle
  LEFT JOIN r ON r.request_id = k.request_id AND r.review_cycle = k.review_cycle)
SELECT request_id, review_cycle, n_votes, n_rejected, n_members, complete, CASE WHEN complete THEN CASE WHEN n > a + b AND n > d THEN 'needs_more_info'
  WHEN b > a AND b > d AND b > n THEN 'approve_with_bridge' WHEN a + b > d AND a + b > n THEN 'approve' ELSE 'deny' END END AS final_decision FROM x""")
def vote_stream(t):
    path = out(t, "votes")
    e = events(t).filter("event_type IN ('error', 'signup')")
    action = F.element_at(F.array(*[F.lit(a) for a in ("approve", "approve_with_bridge", "deny", "needs_more_info")]),
                          (F.floor(F.col("value") * 100) % 4 + 1).cast("int"))
    rows = e.select(F.col("user_id").alias("request_id"), (F.col("event_id") % 2 + 1).cast("int").alias("review_cycle"),
                    F.when(F.col("event_type") == "signup", "member").otherwise("vote").alias("kind"),
                    F.when(F.col("event_type") == "signup", F.col("event_id") % 10).otherwise((F.col("event_id") + F.floor(F.col("value") * 10)) % 12).alias("person"), action.alias("action"), F.col("ts").alias("at"), F.col("event_id").alias("ref_id"))
    J.run_updates(J.vote_results(rows, "400 days", "400 days"), path, "append").awaitTermination()
    return J.latest_tallies(t.spark, path)


@query("event_log_stream", "ST1 S11", """SELECT event_id AS request_id, event_type AS event, ts FROM @events""")
def event_log_stream(t):
    path = out(t, "log")
    rows = t.events.select("ts", F.col("event_type").alias("event"), F.col("event_id").cast("string").alias("request_id"))
    writers.append_events(rows, f"{path}/in")
    J.run_to_table(J.read_events(t.spark, f"{path}/in"), f"{path}/out").awaitTermination()
    log = t.spark.read.parquet(f"{path}/out/data")
    return log.select(F.col("request_id").cast("long").alias("request_id"), "event", F.col("ts").cast("timestamp_ntz").alias("ts"))


FACT_BUCKETS = 64
STREAMED = Q.WITH + "," + Q.scored_sql(D.SHIPPED_POLICY)


@query("decision_stream", "ST2 D10", STREAMED + "SELECT request_id, decision, equivalency_score FROM result WHERE request_id IN (SELECT user_id FROM events)")
def decision_stream(t):
    path, stored = out(t, "decisions"), out(t, "facts")
    B.write_buckets(Q.facts(t), stored, ["request_id"], FACT_BUCKETS)

    def decide_cases(ids):
        mine = B.rows_of_keys(t.spark, stored, ids, ["request_id"], FACT_BUCKETS)
        asked = t.requests.select("request_id", "course_requested")
        wide = D.with_target(E.pivot_facts(mine).join(asked, "request_id"), Q.profiles(t))
        return D.decide(wide, D.SHIPPED_POLICY, Q.YEAR).select("request_id", "decision", "equivalency_score")

    J.decide_on_arrival(events(t).select(F.col("user_id").alias("request_id")), path, decide_cases).awaitTermination()
    return J.latest_updates(t.spark, path, ["request_id"])


@query("ingested_decisions", "S14 D10", STREAMED + """SELECT r.request_id, x.extraction_run_id, decision, equivalency_score FROM result r
JOIN (SELECT request_id, extraction_run_id FROM @extraction_runs WHERE status IN ('queued', 'running')
  QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY created_at DESC, extraction_run_id DESC) = 1) x ON x.request_id = r.request_id""")
def ingested_decisions(t):
    rows = readers.active_run_facts(Q.facts(t), t.extraction_runs)
    runs = rows.select("request_id", "extraction_run_id").distinct()
    wide = D.with_target(E.pivot_facts(rows).join(t.requests.select("request_id", "course_requested"), "request_id"), Q.profiles(t))
    return D.decide(wide, D.SHIPPED_POLICY, Q.YEAR).join(runs, "request_id").select(
        "request_id", "extraction_run_id", "decision", "equivalency_score")


@query("run_manifests", "S10 A11", """WITH c AS (SELECT doc_id % 7 AS run_id, count(DISTINCT doc_id) AS documents, count(*) AS pages FROM @doc_pages GROUP BY 1),
m AS (SELECT run_id, CAST(to_json({'run_id': run_id, 'documents': documents, 'pages': pages}) AS VARCHAR) AS manifest FROM c)
SELECT run_id, manifest, sha256(manifest) AS manifest_sha256 FROM m""")
def run_manifests(t):
    pages = t.doc_pages.withColumn("run_id", F.col("doc_id") % 7)
    return writers.manifest({"documents": pages.select("run_id", "doc_id").distinct(), "pages": pages}, "run_id")
