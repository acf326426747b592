"""Human review: actions, committees, votes, audit timeline, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.operators.cases import lookup
from casemill.operators.common import carry_forward, dense_index

# ---- fixed values ----------------------------------------------------------
ACTION_OF_API = {
    "APPROVE": "approve",
    "DENY": "deny",
    "REQUEST_INFO": "request_info",
    "NEEDS_MORE_INFO": "request_info",
    "APPROVE_WITH_BRIDGE": "approve_with_bridge",
}
API_OF_ACTION = {
    "approve": "APPROVE",
    "deny": "DENY",
    "request_info": "NEEDS_MORE_INFO",
    "approve_with_bridge": "APPROVE_WITH_BRIDGE",
}
# Most conservative first: ties go to the earliest.
VOTE_PRIORITY = ("deny", "needs_more_info", "approve_with_bridge", "approve")
COMMITTEE_SIZE = 3
# ----------------------------------------------------------------------------

CYCLE = ["request_id", "review_cycle"]


def stored_action(api: Column) -> Column:
    """Stored form of a submitted action; null marks an invalid one."""
    return lookup(ACTION_OF_API, api)


def api_action(stored: Column) -> Column:
    return F.coalesce(lookup(API_OF_ACTION, stored), stored)


def admitted_votes(votes: DataFrame, committee: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """The first vote of each member in a cycle; votes of others and second votes are refused (Q3, A1–A3).

    With ``requests``, only votes in the present cycle of cases that wait for their committee are let in.
    """
    seats = committee.select(*CYCLE, F.col("reviewer_id").alias("voter_id")).distinct()
    inside = votes.join(seats, [*CYCLE, "voter_id"], "left_semi")
    if requests is not None:
        waiting = requests.filter("status = 'pending_committee'").select(*CYCLE)
        inside = inside.join(waiting, CYCLE, "left_semi")
    first = F.min_by(F.struct(*[c for c in votes.columns if c not in (*CYCLE, "voter_id")]), F.struct("created_at", "vote_id"))
    return inside.groupBy(*CYCLE, "voter_id").agg(first.alias("_v")).select(*CYCLE, "voter_id", "_v.*")


def _tally(votes: DataFrame) -> DataFrame:
    count = lambda a: F.count_if(F.col("action") == a).alias(a)
    return votes.groupBy(*CYCLE).agg(*[count(a) for a in VOTE_PRIORITY], F.count(F.lit(1)).alias("n_votes"))


def plurality_decision(votes: DataFrame) -> DataFrame:
    """Most frequent action per case and cycle, ties to the most conservative (A1)."""
    top = F.greatest(*VOTE_PRIORITY)
    pick = F.coalesce(*[F.when(F.col(a) == top, F.lit(a)) for a in VOTE_PRIORITY])
    return _tally(votes).select(*CYCLE, "n_votes", pick.alias("committee_decision"))


def final_pick() -> Column:
    """Committee result from the counts of the four actions, approve and bridge pooled (A2)."""
    a, b, d, n = (F.col(x) for x in ("approve", "approve_with_bridge", "deny", "needs_more_info"))
    pooled = a + b
    return (
        F.when((n > pooled) & (n > d), "needs_more_info")
        .when((b > a) & (b > d) & (b > n), "approve_with_bridge")
        .when((pooled > d) & (pooled > n), "approve")
        .otherwise("deny")
    )


def final_decision(votes: DataFrame) -> DataFrame:
    return _tally(votes).select(*CYCLE, "n_votes", final_pick().alias("final_decision"))


def completed_votes(committee: DataFrame, votes: DataFrame) -> DataFrame:
    """Cycles in which every member has voted (A3); give it the admitted votes."""
    members = committee.select(*CYCLE, "reviewer_id").distinct().groupBy(*CYCLE).agg(F.count(F.lit(1)).alias("n_members"))
    cast = votes.groupBy(*CYCLE).agg(F.count(F.lit(1)).alias("n_votes"))
    return members.join(cast, CYCLE).filter(F.col("n_votes") >= F.col("n_members"))


def committee_view(committee: DataFrame, votes: DataFrame, reviewers: DataFrame) -> DataFrame:
    """Members with a voted flag, never the vote itself."""
    voted = votes.select(*CYCLE, F.col("voter_id").alias("reviewer_id")).distinct().withColumn("_voted", F.lit(True))
    return (
        committee.join(voted, [*CYCLE, "reviewer_id"], "left")
        .join(reviewers.select("reviewer_id", "reviewer_name"), "reviewer_id", "left")
        .select(*CYCLE, "reviewer_id", "reviewer_name", F.coalesce("_voted", F.lit(False)).alias("has_voted"))
    )


def committee_worklist(requests: DataFrame, committee: DataFrame, votes: DataFrame) -> DataFrame:
    """Each member's cases in the current cycle with whether they still owe a vote."""
    seats = requests.select("request_id", "review_cycle", "status").join(committee, CYCLE)
    voted = votes.select(*CYCLE, F.col("voter_id").alias("reviewer_id")).distinct().withColumn("_voted", F.lit(True))
    return seats.join(voted, [*CYCLE, "reviewer_id"], "left").select(
        *CYCLE, "reviewer_id", "status", F.col("_voted").isNull().alias("needs_vote"))


def draw_committee(cases: DataFrame, reviewers: DataFrame, seed: str = "0", size: int = COMMITTEE_SIZE) -> DataFrame:
    """``size`` reviewers per case in seeded hash order, never the assigned one.

    Reviewers sit on a ring by hash of their id; each case starts at the hash of its own id and takes the next
    ``size`` + 1 seats, which leaves ``size`` after the assigned reviewer is skipped. Every case yields that many
    rows at most, so no case × reviewer product is formed.
    """
    def spot(kind: str, c: str) -> Column:
        digest = F.md5(F.concat(F.lit(f"{seed}:{kind}:"), F.col(c).cast("string")))
        return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")

    ring = reviewers.select("reviewer_id", spot("r", "reviewer_id").alias("_spot"))
    seats = dense_index(ring, "_spot", "_seat").select("reviewer_id", "_seat")
    n = reviewers.agg(F.count(F.lit(1))).scalar()
    wanted = (
        cases.select("request_id", "assigned_reviewer_id", n.alias("_n"))
        .withColumn("_start", spot("c", "request_id") % F.col("_n"))
        .withColumn("_k", F.explode(F.sequence(F.lit(0), F.least(F.lit(size), F.col("_n") - 1).cast("int"))))
        .withColumn("_seat", (F.col("_start") + F.col("_k")) % F.col("_n"))
    )
    open_seats = wanted.join(seats, "_seat").filter(
        F.col("assigned_reviewer_id").isNull() | (F.col("reviewer_id") != F.col("assigned_reviewer_id")))
    order = Window.partitionBy("request_id").orderBy("_k")  # at most size + 1 rows per case
    return open_seats.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= size).select(
        "request_id", "reviewer_id", "place")


def cycle_numbers(actions: DataFrame) -> DataFrame:
    """Review cycle of each submitted action: the first opens cycle 1, each later one the next.

    The count of earlier actions is formed per day first, so a case with very many actions is spread over its days.
    """
    day = F.to_date("created_at")
    dated = actions.withColumn("_day", day)
    per_day = dated.groupBy("request_id", "_day").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("request_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_day.select("request_id", "_day", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("request_id", "_day").orderBy("created_at", "review_action_id"))
    return (
        dated.withColumn("_place", place).join(starts, ["request_id", "_day"])
        .withColumn("review_cycle", (F.col("_place") + F.col("_start")).cast("int"))
        .drop("_day", "_place", "_start")
    )


def link_actions_to_runs(actions: DataFrame, runs: DataFrame) -> DataFrame:
    """Each review action with the newest decision run at its time, null when there is none yet.

    An as-of join: both sides are laid on one time line and the last run is carried forward, day by day.
    """
    line = actions.select("request_id", F.col("created_at").alias("at"), F.lit(1).alias("side"),
                          "review_action_id", F.lit(None).cast("long").alias("run"))
    line = line.unionByName(runs.select("request_id", F.col("created_at").alias("at"), F.lit(0).alias("side"),
                                        F.lit(None).cast("long").alias("review_action_id"),
                                        F.col("decision_run_id").alias("run")))
    days = F.datediff(F.to_date("at"), F.lit("1970-01-01").cast("date"))
    carried = carry_forward(line, ["request_id"], days, ["at", "side", "run"], "run", "decision_run_id")
    return carried.filter("side = 1").select("request_id", "review_action_id", "decision_run_id")


def audit_timeline(extractions: DataFrame, decisions: DataFrame, results: DataFrame, actions: DataFrame,
                   votes: DataFrame | None = None) -> DataFrame:
    """All events of a case as one table: runs, reviews and, for the full form, votes."""
    def run_text(kind: str) -> Column:
        tail = F.when(F.col("error_message").isNotNull(), F.concat(F.lit(": "), "error_message")).otherwise("")
        return F.concat(F.lit(f"{kind} run "), "status", tail)

    none = F.lit(None).cast("string")
    parts = [
        extractions.select("request_id", F.col("created_at").alias("at"), F.lit("AGENT").alias("actor"),
                           F.lit("EXTRACTION").alias("kind"), F.col("extraction_run_id").alias("ref_id"),
                           run_text("Extraction").alias("message"), none.alias("decision")),
        decisions.join(results.select("decision_run_id", "decision").hint("merge"), "decision_run_id", "left").select(
            "request_id", F.col("created_at").alias("at"), F.lit("AGENT").alias("actor"), F.lit("DECISION").alias("kind"),
            F.col("decision_run_id").alias("ref_id"), run_text("Decision").alias("message"), "decision"),
        actions.select("request_id", F.col("created_at").alias("at"), F.lit("REVIEWER").alias("actor"),
                       F.upper("action").alias("kind"), F.col("review_action_id").alias("ref_id"),
                       F.coalesce(F.nullif("comment", F.lit("")), F.concat(F.lit("Reviewer action: "), "action")).alias("message"),
                       none.alias("decision")),
    ]
    if votes is not None:
        parts.append(votes.select("request_id", F.col("created_at").alias("at"), F.lit("COMMITTEE").alias("actor"),
                                  F.lit("VOTE").alias("kind"), F.col("vote_id").alias("ref_id"),
                                  F.col("action").alias("message"), none.alias("decision")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# ---- retention -------------------------------------------------------------

def log_expiry(line: Column) -> Column:
    """Expiry of a JSON log line; null for a malformed line and for one without a zoned expiry."""
    text = F.try_variant_get(F.try_parse_json(line), F.lit("$.expires_at"), "string")
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.when(zoned, text.try_cast("timestamp"))


def mark_expired(lines: DataFrame, as_of: str) -> DataFrame:
    """Non-blank log lines with an expired flag; lines that cannot be read are kept (S6, ST6)."""
    kept = lines.withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", "")).filter("line <> ''")
    return kept.withColumn("expired", F.coalesce(log_expiry(F.col("line")) < F.lit(as_of).cast("timestamp"), F.lit(False)))


def retention_counts(lines: DataFrame, as_of: str) -> DataFrame:
    """Per log file: lines read, lines to remove, and whether the file becomes empty."""
    return mark_expired(lines, as_of).groupBy("file_name").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if("expired").alias("n_removed"),
        (F.count_if("expired") == F.count(F.lit(1))).alias("emptied"))


def purge_documents(documents: DataFrame, as_of: Column) -> DataFrame:
    """Stored location removed from expired documents (ST7)."""
    due = F.col("expires_at").isNotNull() & (F.col("expires_at") < as_of) & (F.coalesce("storage_uri", F.lit("")) != "")
    return documents.withColumns({"purged": F.coalesce(due, F.lit(False)),
                                  "storage_uri": F.when(due, F.lit(None)).otherwise(F.col("storage_uri"))})
