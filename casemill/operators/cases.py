"""Case, course and document tables: listings, lookups, imports, cascades, nested detail."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casemill.functions import text as X
from casemill.operators.common import ROWS_PER_TASK, dense_index, newest_per, of_keys, saved, saved_ranges, tasks_for

# ---- fixed values ----------------------------------------------------------
DISPLAY_STATUS = {
    "uploaded": "UPLOADED",
    "extracting": "EXTRACTING",
    "ai_recommendation": "AI_RECOMMENDATION",
    "reviewed": "REVIEWED",
    "pending_committee": "PENDING_COMMITTEE",
    "committee_decided": "COMMITTEE_DECIDED",
    "invalid": "INVALID",
}
COMMITTEE_DISPLAY = {
    "approve": "APPROVED",
    "deny": "DENIED",
    "approve_with_bridge": "APPROVED WITH BRIDGE",
    "needs_more_info": "NEEDS MORE INFO",
}
ACTION_DISPLAY = {
    "approve": "APPROVED",
    "deny": "DENIED",
    "approve_with_bridge": "APPROVED WITH BRIDGE",
    "request_info": "NEEDS MORE INFO",
}
# ----------------------------------------------------------------------------


# ---- fixed values ----------------------------------------------------------
WORKLISTS = {"pending": ("ai_recommendation", "ready_for_decision"), "reviewed": ("reviewed",), "all": None}
# ----------------------------------------------------------------------------


def reviewer_worklist(requests: DataFrame, reviewer_id: int, which: str = "pending") -> DataFrame:
    """Cases that are nobody's or the reviewer's: those pending, those reviewed, or all."""
    mine = requests.filter(F.col("assigned_reviewer_id").isNull() | (F.col("assigned_reviewer_id") == reviewer_id))
    return mine if WORKLISTS[which] is None else mine.filter(F.col("status").isin(*WORKLISTS[which]))


def lookup(table: dict[str, str], c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def display_status(status: Column) -> Column:
    """Shown status; a status without a display form passes through."""
    return F.coalesce(lookup(DISPLAY_STATUS, status), status)


def resolved_status(status: Column, committee: Column, latest_action: Column) -> Column:
    """Upper-case status, replaced by the committee decision or else the latest review action (P10)."""
    up = F.upper(F.coalesce(display_status(status), F.lit("")))
    by_action = F.coalesce(lookup(ACTION_DISPLAY, latest_action), up)
    return (
        F.when((up == "COMMITTEE_DECIDED") & committee.isNotNull(), F.coalesce(lookup(COMMITTEE_DISPLAY, committee), up))
        .when((up == "COMMITTEE_DECIDED") & latest_action.isNotNull(), by_action)
        .when((up == "REVIEWED") & latest_action.isNotNull(), by_action)
        .otherwise(up)
    )


def list_cases(requests: DataFrame, status: str | None = None, student: int | None = None,
               committee: DataFrame | None = None, reviewer: int | None = None) -> DataFrame:
    """Cases newest first; with a reviewer, only those whose current cycle has them on the committee."""
    out = requests
    if status is not None:
        out = out.filter(F.col("status") == status)
    if student is not None:
        out = out.filter(F.col("student_id") == student)
    if committee is not None and reviewer is not None:
        seats = committee.filter(F.col("reviewer_id") == reviewer).select("request_id", "review_cycle")
        out = out.join(seats, ["request_id", "review_cycle"], "left_semi")
    return out.orderBy(F.col("created_at").desc(), F.col("request_id").desc())


def search_courses(courses: DataFrame, text: str = "", department: str | None = None, credits: int | None = None,
                   lab: bool | None = None, has_prerequisites: bool | None = None,
                   in_prerequisites: bool = False) -> DataFrame:
    """Course search over code and name, and over prerequisites when asked."""
    out, q = courses, text.lower()
    if q:
        hit = F.lower("course_code").contains(q) | F.lower("display_name").contains(q)
        if in_prerequisites:
            hit = hit | F.lower(F.coalesce("prerequisites", F.lit(""))).contains(q)
        out = out.filter(hit)
    if department:
        out = out.filter(F.col("department") == department)
    if credits is not None:
        out = out.filter(F.col("credits") == credits)
    if lab is not None:
        out = out.filter(F.col("lab_required") == lab)
    if has_prerequisites is not None:
        present = F.coalesce("prerequisites", F.lit("")) != ""
        out = out.filter(present if has_prerequisites else ~present)
    return out


def write_listing(df: DataFrame, order: Sequence[str], path: str, rows_per_range: int = 100_000) -> None:
    """An ordered listing cut into ranges of about ``rows_per_range`` rows, one folder each, with the size of each range (L2).

    ``order`` must name a row.
    """
    ranges = max(1, -(-df.count() // rows_per_range))
    cut = df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
    cut.write.mode("overwrite").partitionBy("_range").parquet(f"{path}/rows")
    sizes = df.sparkSession.read.parquet(f"{path}/rows").groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    sizes.write.mode("overwrite").parquet(f"{path}/sizes")


def page(spark: SparkSession, path: str, order: Sequence[str], number: int, size: int) -> DataFrame:
    """Page ``number`` of a listing (L2): the sizes of the ranges tell which one or two hold it, and only those are read."""
    first, last, seen, wanted = (number - 1) * size, number * size, 0, []
    skip = 0
    for r in sorted(spark.read.parquet(f"{path}/sizes").collect()):
        if seen < last and seen + r.n > first:
            if not wanted:
                skip = first - seen
            wanted.append(r["_range"])
        seen += r.n
    rows = spark.read.parquet(f"{path}/rows").filter(F.col("_range").isin(wanted)).drop("_range")
    return rows.orderBy(*order).offset(max(skip, 0)).limit(size)


def page_after(df: DataFrame, order: Sequence[str], last: Sequence | None, size: int) -> DataFrame:
    """The page behind the row whose ``order`` values are ``last``, the first page if None (L2).

    The bound on the first column reaches the scan; nothing before it is sorted.
    """
    if last is not None:
        low = [F.lit(v) for v in last]
        df = df.filter((F.col(order[0]) >= low[0]) & (F.struct(*order) > F.struct(*[v.alias(c) for v, c in zip(low, order)])))
    return df.orderBy(*order).limit(size)


def classify_document(filename: Column) -> Column:
    name = F.lower(filename)
    return F.when(name.contains("syllabus"), "syllabus").when(name.contains("transcript"), "transcript").otherwise("catalog")


def document_rank(kind: Column) -> Column:
    """Syllabi first, then catalogs, then transcripts (L1)."""
    return F.when(kind == "syllabus", 0).when(kind == "catalog", 1).otherwise(2)


def is_pdf(filename: Column) -> Column:
    return F.lower(filename).endswith(".pdf")


def active_documents(documents: DataFrame) -> DataFrame:
    """Active documents of each case by upload time."""
    return documents.filter("is_active").orderBy("request_id", "created_at", "doc_id")


def patch(table: DataFrame, changes: DataFrame, key: str, clearable: tuple[str, ...] = ()) -> DataFrame:
    """Apply non-null values of ``changes``; in ``clearable`` columns an empty text clears the value."""
    fields = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"_{c}") for c in fields])
    merged = table.join(new, key, "left")
    for c in fields:
        value = F.coalesce(f"_{c}", c)
        merged = merged.withColumn(c, F.when(F.col(f"_{c}") == "", F.lit(None)).otherwise(value) if c in clearable else value)
    return merged.select(*table.columns)


def usable_accounts(accounts: DataFrame, as_of: Column) -> DataFrame:
    return accounts.filter(~F.col("is_deleted") & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of)))


def upsert(old: DataFrame, new: DataFrame, key: list[str], overwrite: list[str] | None = None) -> DataFrame:
    """Insert new keys; on a known key do nothing, or take the ``overwrite`` columns from the new row.

    ``new`` must hold a key at most once. As the job of :func:`buckets.change_buckets` it only sees and writes touched buckets.
    """
    added = new.join(old.select(*key), key, "left_anti").select(*old.columns)
    if not overwrite:
        return old.unionByName(added)
    fresh = new.select(*key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in overwrite])
    kept = old.join(fresh, key, "left")
    for c in overwrite:
        kept = kept.withColumn(c, F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)))
    return kept.select(*old.columns).unionByName(added)


def deactivate_previous(documents: DataFrame, incoming: DataFrame) -> DataFrame:
    """Earlier uploads of a case become inactive when new ones arrive; then both are kept."""
    touched = incoming.select("request_id").distinct().withColumn("_touched", F.lit(True))
    old = documents.join(touched, "request_id", "left")
    old = old.withColumn("is_active", F.col("is_active") & F.col("_touched").isNull())
    return old.select(*documents.columns).unionByName(incoming.select(*documents.columns))


def import_courses(existing: DataFrame, rows: DataFrame, order: str) -> DataFrame:
    """New courses from catalog rows: first row per unseen code, with defaults filled in."""
    coded = rows.withColumn("course_code", X.strip(F.coalesce("course_code", F.lit("")))).filter("course_code <> ''")
    unseen = coded.join(existing.select("course_code"), "course_code", "left_anti")
    first = newest_per(unseen, ["course_code"], [order], oldest=True)
    number = F.coalesce(X.non_blank(F.col("credits_min")), F.lit("3")).try_cast("double")
    return first.select(
        "course_code",
        F.coalesce(X.non_blank(X.strip(F.col("title"))), "course_code").alias("display_name"),
        F.coalesce(X.non_blank(X.strip(F.col("subject"))), F.lit("General")).alias("department"),
        F.coalesce(number.cast("int"), F.lit(3)).alias("credits"),
        X.non_blank(X.strip(F.col("prerequisites"))).alias("prerequisites"),
        X.non_blank(X.strip(F.col("description"))).alias("description"),
    )


def with_outcomes(courses: DataFrame, outcomes: DataFrame, order: str) -> DataFrame:
    """Courses with their learning outcomes text, '' when there is none; the last row of a code wins."""
    coded = outcomes.withColumns({"course_code": X.strip(F.col("course_code")),
                                  "learning_outcomes": X.strip(F.col("learning_outcomes"))}).filter("course_code <> ''")
    last = newest_per(coded, ["course_code"], [order]).select("course_code", "learning_outcomes")
    return courses.join(last, "course_code", "left").withColumn(
        "learning_outcomes", F.coalesce("learning_outcomes", F.lit("")))


def round_robin(cases: DataFrame, reviewers: DataFrame, key: str = "request_id", reviewer: str = "reviewer_id") -> DataFrame:
    """Case i goes to reviewer i mod n, both in key order."""
    ranked = dense_index(reviewers.select(reviewer), reviewer, "_slot")
    n = reviewers.agg(F.count(F.lit(1))).scalar()
    numbered = dense_index(cases.select(key), key, "_i")
    return numbered.withColumn("_slot", F.col("_i") % n).join(ranked, "_slot").select(key, reviewer)


def delete_cases(doomed: DataFrame, children: dict[str, DataFrame], key: str = "request_id") -> dict[str, DataFrame]:
    """Every child table without the rows of the deleted cases."""
    return {name: child.join(doomed.select(key), key, "left_anti") for name, child in children.items()}


def forget(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows stay, references to deleted rows become null (J14, SET NULL)."""
    marks = gone.select(key).distinct().withColumn("_gone", F.lit(True))
    out = table.join(marks, key, "left")
    return out.withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).select(*table.columns)


def latest_completed(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Newest completed decision of each case that has a result."""
    done = runs.filter(F.col("status") == "completed").join(results.drop("created_at"), "decision_run_id")
    return newest_per(done, ["request_id"], ["created_at", "decision_run_id"])


def latest_run_rows(runs: DataFrame, rows: DataFrame, run: str = "extraction_run_id") -> DataFrame:
    """Rows that belong to the newest run of their case."""
    newest = newest_per(runs.select("request_id", run, "created_at"), ["request_id"], ["created_at", run])
    return rows.join(newest.select("request_id", run), ["request_id", run], "left_semi")


def next_id(ids: DataFrame, column: str, prefix: str = "CASE-", width: int = 3) -> DataFrame:
    """Prefix plus the greatest number so far + 1, zero-padded to at least ``width``."""
    number = F.coalesce(F.max(F.regexp_extract(column, r"(\d+)$", 1).cast("long")), F.lit(0)) + 1
    text = number.cast("string")
    return ids.agg(F.concat(F.lit(prefix), F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))).alias("next_id"))


def case_detail(requests: DataFrame, documents: DataFrame, evidence: DataFrame, decision: DataFrame, audit: DataFrame) -> DataFrame:
    """All parts of every case: documents, evidence, latest decision, audit log.

    One row per part with its section, sort key and JSON body instead of one nested row per case, so a case with very
    many rows is never gathered into one task. Rows of one case stand together when sorted by
    (request_id, section, sort_key).
    """
    def section(df: DataFrame, name: str, order: list[str], ref: str) -> DataFrame:
        body = F.to_json(F.struct(*[c for c in df.columns if c != "request_id"]))
        return df.select("request_id", F.lit(name).alias("section"), F.to_json(F.struct(*order)).alias("sort_key"),
                         F.col(ref).cast("string").alias("ref_id"), body.alias("body"))

    parts = [
        section(requests, "case", ["status"], "request_id"),
        section(documents, "document", ["created_at", "doc_id"], "doc_id"),
        section(evidence, "evidence", ["ordinal", "evidence_id"], "evidence_id"),
        section(decision, "decision", ["decision_run_id"], "decision_run_id"),
        section(audit, "audit", ["at", "kind", "ref_id"], "ref_id"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return of_keys(out, requests, "request_id", tasks_for(requests, documents, evidence, decision, audit))


#: Sections of a case in the order they are shown.
SECTIONS = ("case", "document", "evidence", "decision", "audit")
PARTS_PER_ROW = 1000


def case_parts(requests: DataFrame, documents: DataFrame, evidence: DataFrame, decision: DataFrame, audit: DataFrame) -> DataFrame:
    """The rows of :func:`case_detail` with the columns that order them: section, time, number, reference."""
    none = F.lit(None)
    at = lambda c: F.col(c).cast("timestamp").alias("at")

    def part(df: DataFrame, name: str, at: Column, seq: Column, ref: str) -> DataFrame:
        body = F.to_json(F.struct(*[c for c in df.columns if c != "request_id"]))
        return df.select("request_id", F.lit(SECTIONS.index(name)).alias("place"), at.alias("at"), seq.cast("long").alias("seq"),
                         F.col(ref).cast("string").alias("ref_id"), body.alias("body"))

    rows = part(requests, "case", none.cast("timestamp"), none, "request_id")
    for more in (part(documents, "document", at("created_at"), F.col("doc_id"), "doc_id"),
                 part(evidence, "evidence", none.cast("timestamp"), F.col("ordinal"), "evidence_id"),
                 part(decision, "decision", none.cast("timestamp"), none, "decision_run_id"),
                 part(audit, "audit", at("at"), none, "ref_id")):
        rows = rows.unionByName(more)
    return of_keys(rows, requests, "request_id", tasks_for(requests, documents, evidence, decision, audit))


def case_objects(parts: DataFrame, limit: int = PARTS_PER_ROW) -> DataFrame:
    """Each case as one nested row, with its parts by section in order; a case of more than ``limit`` parts as ordered
    chunk rows of that many (J20).

    Rows: request_id, chunk (from 0), n_chunks, n_parts of the whole case, and an array of parts for each section. Parts
    of a large case are ranked in ranges of the order, so neither its sorting nor its gathering is left to one task.
    """
    order = ["place", "at", "seq", "ref_id", "body"]
    sizes = saved(parts.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_parts")), "case-sizes")
    tasks = 1 + (sizes.agg(F.sum("n_parts")).first()[0] or 0) // ROWS_PER_TASK
    sized = parts.join(sizes.repartition(tasks, "request_id").hint("merge"), "request_id")
    small = sized.filter(F.col("n_parts") <= limit).withColumn("chunk", F.lit(0).cast("long"))
    large = saved_ranges(sized.filter(F.col("n_parts") > limit), ["request_id", *order], tasks)
    local = F.row_number().over(Window.partitionBy("_range", "request_id").orderBy(*order)) - 1
    counts = large.groupBy("request_id", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("request_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = counts.select("request_id", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ranked = large.withColumn("_i", local).join(starts.hint("merge"), ["request_id", "_range"])
    ranked = ranked.withColumn("chunk", F.floor((F.col("_start") + F.col("_i")) / limit)).drop("_range", "_i", "_start")
    rows = small.unionByName(ranked.select(*small.columns)).repartition(tasks, "request_id", "chunk")
    listed = F.array_sort(F.collect_list(F.struct(*order)))
    grouped = rows.groupBy("request_id", "chunk").agg(F.max("n_parts").alias("n_parts"), listed.alias("_parts"))
    section = lambda k: F.transform(F.filter("_parts", lambda x: x["place"] == k), lambda x: F.struct(x["ref_id"].alias("ref_id"), x["body"].alias("body")))
    return grouped.select("request_id", "chunk", F.ceil(F.col("n_parts") / limit).alias("n_chunks"), "n_parts",
                          *[section(k).alias(f"{name}_rows") for k, name in enumerate(SECTIONS)])
