"""Syllabus facts from page rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.functions import text as X
from casemill.operators.common import in_order, page_seams, spanned_words
from casemill.operators.decision import Policy

# ---- fixed values ----------------------------------------------------------
CODE = r"\b([A-Z]{2,6})\s*([0-9]{3,4}[A-Z]?)\b"
DOTTED_CODE = r"\b(\d{1,2}\.\d{3,4})\b"
TITLE_LEADS = (r"^[A-Z]{2,6}\s*\d{3,4}[A-Z]?\s*[–—-]\s*", r"^\d{1,2}\.\d{3,4}\s*[–—-]\s*")
CREDIT_FORMS = (
    r"(?i)\b(\d+)\s*Credit Hour",
    r"(?i)Credit Hours?\s+(\d+)",
    r"(?i)\bUnits?\b\s*[:\-]?\s*(\d+)",
    r"(?i)Course Credits?\s*[:\-]?\s*(\d+)",
    r"(?i)\bCredits?\s*[:\-]\s*(\d+)",
    r"(?i)\((\d+)\s*credits?\)",
)
SECTIONS = {
    "description": "Course Description|Course Overview|About This Course|Course Objective and Description",
    "prerequisites": "Prerequisites|Expected Background / Prerequisites|Enrollment Policy|Expected Background",
    "learning_outcomes": "Student Learning Outcomes|Learning Outcomes|Course Learning Outcomes|Learning Objectives|Course Objectives",
}
NEXT_HEADING = r"\n[A-Z][A-Za-z /&]{3,}\n"
FACT_KEYS = ("course_code", "title", "credits_or_units", "description", "prerequisites", "learning_outcomes")
# ----------------------------------------------------------------------------


def _on_first_page(value: Column) -> Column:
    return F.max(F.when(F.col("page_num") == 1, value))


def _sections(pages: DataFrame) -> DataFrame:
    """Text of each section from its first heading to the next heading line, also over page ends.

    Where a section begins and surely ends is settled on narrow page flags. Only then are the pages between gathered,
    so the gathered text is no longer than the section with the rest of its last page.
    """
    names = list(SECTIONS)
    p, text = F.col("page_num"), F.col("text")
    flags = pages.select(
        "doc_id", "page_num", text.rlike(NEXT_HEADING).alias("_stop"),
        *[text.rlike(f"(?i)(?:{SECTIONS[n]})").alias(f"_head_{n}") for n in names],
        *[text.rlike(rf"(?i:{SECTIONS[n]})\s*\S[\s\S]*?{NEXT_HEADING}").alias(f"_in_{n}") for n in names])
    opened = flags.groupBy("doc_id").agg(
        *[F.min(F.when(F.col(f"_head_{n}"), p)).alias(f"{n}_from") for n in names], F.max(p).alias("_last"))

    def ends(n: str) -> Column:
        begin = F.col(f"{n}_from")
        return F.min(F.when(((p == begin) & F.col(f"_in_{n}")) | ((p > begin) & F.col("_stop")), p)).alias(f"{n}_to")

    closed = flags.join(opened, "doc_id").groupBy("doc_id").agg(*[ends(n) for n in names])
    spans = opened.join(closed, "doc_id")

    def within(n: str) -> Column:
        return (p >= F.col(f"{n}_from")) & (p <= F.coalesce(f"{n}_to", "_last"))

    wanted = within(names[0])
    for n in names[1:]:
        wanted = F.coalesce(wanted, F.lit(False)) | F.coalesce(within(n), F.lit(False))
    near = pages.join(spans, "doc_id").filter(wanted)

    def gathered(n: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(within(n), F.struct("page_num", "text"))))
        return F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias(f"_{n}")

    found = near.groupBy("doc_id").agg(*[gathered(n) for n in names])
    out = [F.col("doc_id")]
    for n in names:
        pattern = rf"(?i)(?:{SECTIONS[n]})\s*([\s\S]+)"
        tail = X.found(F.col(f"_{n}"), pattern, 1)
        out.append(X.strip(F.get(F.split(tail, NEXT_HEADING, 2), F.lit(0))).alias(n))
    return found.select(*out)


def _first_matches(pages: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """First match of each pattern in a document's text, its pages joined by line ends.

    A match is looked for inside each page and, among the last words before it and its first ones, across its beginning.
    """
    inside = pages.select("doc_id", "page_num", F.lit(1).alias("_o"), *[X.found(F.col("text"), p, 0).alias(n) for n, p in patterns.items()])

    def across(p: str) -> Column:
        every = F.regexp_extract_all(F.concat("tail", F.lit("\n"), "head"), F.lit(p), F.lit(0))
        n, m = F.regexp_count("tail", F.lit(p)), F.regexp_count("head", F.lit(p))
        return F.when(F.size(every) > n + m, F.get(every, n))

    rim = page_seams(pages, spanned_words(*patterns.values()), sep="\n").select(
        "doc_id", "page_num", F.lit(0).alias("_o"), *[across(p).alias(n) for n, p in patterns.items()])
    at = F.struct("page_num", "_o")
    return inside.unionByName(rim).groupBy("doc_id").agg(
        *[F.min_by(n, F.when(F.col(n).isNotNull(), at)).alias(n) for n in patterns])


def syllabus_facts(pages: DataFrame, title_limit: int | None = None, paragraph_limit: int | None = None) -> DataFrame:
    """Code, title, credits, description, prerequisites and outcomes of each syllabus.

    Titles over ``title_limit`` characters are none and a description taken from the second paragraph is cut at
    ``paragraph_limit``, where these are given; the domain's own limits are 140 and 1200.
    """
    text = F.col("text")
    line0 = F.get(F.filter(F.transform(X.split_lines(text), X.strip), lambda x: x != ""), F.lit(0))
    for lead in TITLE_LEADS:
        line0 = X.strip(F.regexp_replace(line0, lead, ""))
    title = F.when((line0 != "") & (F.lit(True) if title_limit is None else F.length(line0) <= title_limit), line0)
    paras = F.filter(F.transform(F.split(X.strip(text), r"\n\s*\n"), X.strip), lambda x: x != "")
    para = F.get(paras, F.lit(1))
    second = F.when(F.size(paras) >= 2, X.strip(para if paragraph_limit is None else F.substring(para, 1, paragraph_limit)))
    firsts = pages.groupBy("doc_id").agg(_on_first_page(title).alias("title"), _on_first_page(second).alias("_second"))
    heads = firsts.join(_first_matches(pages, {"_l": CODE, "_dotted": DOTTED_CODE,
                                               **{f"_c{i}": c for i, c in enumerate(CREDIT_FORMS)}}), "doc_id")
    facts = heads.join(_sections(pages), "doc_id", "left")
    return facts.select(
        "doc_id", F.coalesce(F.concat(F.regexp_extract("_l", CODE, 1), F.lit(" "), F.regexp_extract("_l", CODE, 2)),
                             "_dotted").alias("course_code"), "title",
        F.coalesce(*[X.found(F.col(f"_c{i}"), c) for i, c in enumerate(CREDIT_FORMS)]).alias("credits_or_units"),
        F.coalesce("description", "_second").alias("description"), "prerequisites", "learning_outcomes")


def fact_rows(facts: DataFrame) -> DataFrame:
    """One evidence row per fact, unknown ones with a note (T4)."""
    rows = facts.unpivot("doc_id", list(FACT_KEYS), "fact_key", "fact_value")
    missing = F.coalesce("fact_value", F.lit("")) == ""
    return rows.select(
        "doc_id", F.lit("syllabus_course").alias("fact_type"), "fact_key", "fact_value",
        F.col("fact_value").isNull().alias("is_unknown"),
        F.when(missing, F.concat(F.lit("Missing "), "fact_key", F.lit(" in syllabus"))).alias("notes"))


def target_block(policy: Policy) -> Column:
    """Requirements of the target course and the policy in force, as the prompt states them."""
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(c, "; ")).otherwise("None specified")
    flag = lambda c: F.when(F.col(c), "yes").otherwise("no")
    rules = [(name, getattr(policy, name)) for name in (
        "approve_threshold", "bridge_threshold", "require_lab_parity", "require_credits_known", "require_topics_or_outcomes",
        "min_grade", "min_contact_hours", "max_course_age_years", "must_include_topics")]
    # Rules that are off are not named.
    on = [f"  {name}: {'; '.join(value) if isinstance(value, tuple) else value}" for name, value in rules if value or isinstance(value, bool)]
    return F.concat(
        F.lit("Target credits: "), F.col("target_credits").cast("string"), F.lit("\nLab required: "), flag("target_lab_required"),
        F.lit("\nRequired topics: "), listed(F.col("required_topics")), F.lit("\nRequired outcomes: "), listed(F.col("required_outcomes")),
        F.lit("\nPolicy:\n" + "\n".join(on)))


INSTRUCTIONS = "Weigh the evidence against the requirements, cite a chunk id for every reason and gap, and reply with one JSON object."


def messages(evidence: DataFrame, targets: DataFrame, policy: Policy, instructions: str = INSTRUCTIONS) -> DataFrame:
    """The whole message per case (request_id, message): case, target requirements, evidence, instructions.

    ``evidence`` is that of :func:`prompts`; cases without evidence say so.
    """
    rows = targets.join(evidence, "request_id", "left")
    return rows.select("request_id", F.concat(
        F.lit("Case "), F.col("request_id").cast("string"), F.lit("\n\nRequirements\n"), target_block(policy), F.lit("\n\nEvidence\n"),
        F.coalesce("evidence_text", F.lit("(none)")), F.lit("\n\nInstructions\n" + instructions)).alias("message"))


def prompts(facts: DataFrame, citations: DataFrame, chunks: DataFrame, order: list[str]) -> DataFrame:
    """Evidence block of the decision prompt per case, snippets cut at 500 characters."""
    snippet = X.clip(F.coalesce(X.non_blank(F.col("snippet_text")), F.lit("(no text)")), 500, "...")
    line = F.concat(F.lit("    [chunk_id: "), F.col("chunk_uuid").cast("string"), F.lit(", page: "),
                    F.col("page_num").cast("string"), F.lit("]\n    \""), snippet, F.lit("\""))
    cited = citations.join(chunks, "chunk_uuid").groupBy("evidence_id").agg(in_order("chunk_uuid", line, "\n").alias("_cited"))
    value = F.coalesce(X.non_blank(F.col("fact_value")), F.to_json(F.struct("items")), F.lit("N/A"))
    value = F.when(X.non_blank(F.col("fact_value")).isNull() & F.col("items").isNull(), "N/A").otherwise(value)
    block = F.concat(
        F.lit("- Fact: "), F.coalesce("fact_key", F.lit("None")), F.lit(" = "), value,
        F.when(F.col("is_unknown"), " [UNKNOWN]").otherwise(" [KNOWN]"), F.lit("\n  fact_type: "), F.col("fact_type"), F.lit("\n"),
        F.coalesce("_cited", F.lit("    (no citation chunks linked)")), F.lit("\n"))
    return facts.join(cited, "evidence_id", "left").groupBy("request_id").agg(in_order(order, block, "\n").alias("evidence_text"))
