"""Facts to one evidence row per case, evidence quality, and citation coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.functions import text as X

# ---- fixed values ----------------------------------------------------------
# Evidence field for each accepted fact key.
FIELD_OF_KEY = {
    "credits": "credits", "credit_hours": "credits", "units": "credits", "credits_or_units": "credits",
    "contact_hours_lecture": "contact_hours_lecture", "lecture_hours": "contact_hours_lecture",
    "lecture_contact_hours": "contact_hours_lecture",
    "contact_hours_lab": "contact_hours_lab", "lab_hours": "contact_hours_lab",
    "lab_contact_hours": "contact_hours_lab",
    "lab_component": "lab_component", "has_lab": "lab_component", "lab_required": "lab_component",
    "includes_lab": "lab_component",
    "topics": "topics", "course_topics": "topics",
    "outcomes": "outcomes", "learning_outcomes": "outcomes", "slos": "outcomes",
    "assessments": "assessments", "evaluation_methods": "assessments", "grading_components": "assessments",
    "grade": "grade",
    "term_taken": "term_taken", "semester": "term_taken",
}
SCALAR_FIELDS = ("credits", "contact_hours_lecture", "contact_hours_lab", "lab_component", "grade", "term_taken")
LIST_FIELDS = ("topics", "outcomes", "assessments")
FIELDS = SCALAR_FIELDS + LIST_FIELDS
QUALITY_FIELDS = (
    "credits", "contact_hours_lecture", "contact_hours_lab", "lab_component", "topics", "outcomes", "assessments",
)
ROW_QUALITY_KEYS = (
    "course_code", "title", "description", "credits_or_units", "contact_hours_lecture", "contact_hours_lab",
    "lab_component", "topics", "outcomes", "assessments", "prerequisites",
)
# ----------------------------------------------------------------------------

def no_chunks() -> Column:
    return F.array().cast("array<string>")


def with_field(facts: DataFrame) -> DataFrame:
    """Add the evidence field a fact speaks to (null when it maps to none)."""
    key = F.lower(X.strip(F.coalesce(F.when(F.col("fact_key") != "", F.col("fact_key")),
                                     F.when(F.col("fact_type") != "", F.col("fact_type")), F.lit(""))))
    field = F.create_map(*[F.lit(x) for kv in FIELD_OF_KEY.items() for x in kv])
    return facts.withColumn("field", F.element_at(field, key))


def pivot_facts(facts: DataFrame, case: str = "request_id", order: tuple[str, ...] = ("ordinal", "evidence_id")) -> DataFrame:
    """One evidence row per case; the last fact of a field wins.

    ``facts``: case, ordering columns, fact_type, fact_key, fact_value STRING, items ARRAY<STRING>,
    is_unknown BOOLEAN, and optionally ``citations`` ARRAY<STRING> of chunk ids.
    """
    cites = F.col("citations") if "citations" in facts.columns else no_chunks()
    # A list under a single-value field is kept as text that no number or flag parser accepts.
    as_text = F.when(F.col("items").isNotNull(), F.concat(F.lit("["), F.array_join("items", ", "), F.lit("]"))) \
        .otherwise(X.non_blank(F.col("fact_value")))
    as_list = F.coalesce(F.col("items"), F.when(X.non_blank(F.col("fact_value")).isNotNull(), F.array("fact_value")))
    rows = with_field(facts).select(
        case, "field", F.struct(*order).alias("ord"),
        F.struct(as_text.alias("text"), as_list.alias("list"),
                 F.coalesce("is_unknown", F.lit(False)).alias("unknown"), cites.alias("cites")).alias("val"),
    )
    last = [F.max_by("val", F.when(F.col("field") == f, F.col("ord"))).alias(f"_{f}") for f in FIELDS]
    wide = rows.groupBy(case).agg(*last)
    out = [F.col(case)]
    for f in FIELDS:
        part = "list" if f in LIST_FIELDS else "text"
        out += [
            F.col(f"_{f}")[part].alias(f),
            F.coalesce(F.col(f"_{f}")["unknown"], F.lit(True)).alias(f"{f}_unknown"),
            F.coalesce(F.col(f"_{f}")["cites"], no_chunks()).alias(f"{f}_cites"),
        ]
    return wide.select(*out)


def _is_empty(field: str) -> Column:
    c = F.col(field)
    empty = (F.size(c) == 0) if field in LIST_FIELDS else (c == "")
    return F.col(f"{field}_unknown") | c.isNull() | empty


def quality_score(policy) -> Column:
    """0/70/100 per field (missing, known, known and cited), averaged and cut to a whole number."""
    fields = list(QUALITY_FIELDS)
    if policy.min_grade:
        fields.append("grade")
    if policy.max_course_age_years > 0:
        fields.append("term_taken")
    total = F.lit(0)
    for f in fields:
        total = total + F.when(_is_empty(f), 0).when(F.size(f"{f}_cites") > 0, 100).otherwise(70)
    return (total / len(fields)).cast("int")


def row_quality(facts: DataFrame, citations: DataFrame, case: str = "request_id", extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """Evidence quality over fact rows rather than fields."""
    cited = citations.select("evidence_id").distinct().withColumn("_cited", F.lit(True))
    kept = facts.filter(F.col("fact_key").isin(*ROW_QUALITY_KEYS, *extra_keys)).join(cited, "evidence_id", "left")
    no_value = (F.coalesce("fact_value", F.lit("")) == "") & F.col("items").isNull()
    points = F.when(F.col("is_unknown") | no_value, 0).when(F.col("_cited"), 100).otherwise(70)
    return kept.groupBy(case).agg(F.avg(points).cast("int").alias("quality"), F.count(F.lit(1)).alias("n_rows"))


def chunks_of_evidence(evidence: DataFrame, citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Citation chunks of an evidence set, one row per link."""
    wanted = citations.join(evidence.select("evidence_id").distinct(), "evidence_id", "left_semi")
    return wanted.join(chunks, "chunk_uuid")


def uncited(evidence: DataFrame, citations: DataFrame) -> DataFrame:
    """Evidence rows without any citation."""
    return evidence.join(citations.select("evidence_id").distinct(), "evidence_id", "left_anti")
