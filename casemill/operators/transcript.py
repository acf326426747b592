"""Transcript pages: layout, course rows in tabular and free layouts, matching to a case's courses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.functions import text as X
from casemill.operators.chunks import page_lines
from casemill.operators.common import carry_forward, text_tasks

# ---- fixed values ----------------------------------------------------------
CODE = r"\b([A-Z]{2,6})\s*(\d{3,4}[A-Z]?)\b"
DOTTED_CODE = r"\b(\d{1,2})\.(\d{2,3}[A-Z]?)\b"
GRADE = r"(?<![A-Za-z])([A-DF][+-]|[A-DF]|CR|NC|P|NP|W|WP|WF|IP|AU)(?![A-Za-z])"
SEASON_LINE = r"(?i)^(Fall|Spring|Summer|Winter)$"
SEASON_END = r"(?i)(Fall|Spring|Summer|Winter)\s*$"
YEAR_LINE = r"^(\d{4})$"
PLACE_YEAR_LINE = r"(?i)^(?:University|College|Institute)\s+(\d{4})$"
PLACE_YEAR_END = r"(?i)(?:University|College|Institute)\s+(\d{4})\s*$"
PLACE = r"(?i)\b(University|College|Institute)\b"
CREDITS = r"(?i)(\d+(?:\.\d+)?)\s*(?:cr|credits?|hrs?|hours?|units?)"
NO_TERM = "Unknown Term"
LOOK_BACK = 10
# ----------------------------------------------------------------------------

PAGE_RUN = 64


def layout(pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """tabular, grouped_by_term, linear or unknown, from all pages, or the first ``max_pages``."""
    text = F.col("text")
    first = (pages if max_pages is None else pages.filter(F.col("page_num") <= max_pages)).groupBy("doc_id").agg(
        F.sum(F.regexp_count(text, F.lit("\t"))).alias("tabs"),
        F.bool_or(F.lower(text).contains("course")).alias("c"), F.bool_or(F.lower(text).contains("grade")).alias("g"),
        F.sum(F.regexp_count(text, F.lit(r"(?i)(Fall|Spring|Summer|Winter)\s+\d{4}"))).alias("terms"),
        F.sum(F.regexp_count(text, F.lit(CODE))).alias("codes"))
    return first.select("doc_id", F.when((F.col("tabs") > 20) | (F.col("c") & F.col("g")), "tabular")
                        .when(F.col("terms") >= 2, "grouped_by_term").when(F.col("codes") > 5, "linear")
                        .otherwise("unknown").alias("layout"))


def _with_code(lines: DataFrame, table: bool) -> DataFrame:
    """Add course_code (lettered before dotted, anywhere in the line) and the rest of the line after it.

    In tables a dotted code at the line start goes before a lettered one further in.
    """
    line, hit = F.col("line"), F.col("_hit")
    pattern = F.when(line.rlike(CODE), F.lit(CODE)).when(line.rlike(DOTTED_CODE), F.lit(DOTTED_CODE))
    if table:
        pattern = F.when(line.rlike("^" + DOTTED_CODE) & ~line.rlike("^" + CODE), F.lit(DOTTED_CODE)).otherwise(pattern)
    found = lines.withColumn("_pattern", pattern).withColumn("_hit", F.regexp_substr(line, F.col("_pattern")))
    start = F.regexp_instr(line, F.col("_pattern"))
    lettered = F.concat(F.regexp_extract(hit, "^[A-Z]+", 0), F.lit(" "), F.regexp_extract(hit, r"\d+[A-Z]?$", 0))
    return found.withColumns({
        "course_code": F.when(hit.contains("."), hit).when(hit.isNotNull(), lettered),
        "_rest": F.substring(line, start + F.length(hit), F.length(line)),
    }).drop("_pattern", "_hit")


def _before(text: Column, pattern: str) -> Column:
    """Text in front of the first match."""
    return F.get(F.split(text, pattern, 2), F.lit(0))


def _title(text: Column) -> Column:
    return F.when((F.length(text) > 3) & (F.length(text) < 100), text)


def _table_lines(pages: DataFrame) -> DataFrame:
    """Lines of table-like pages with their course code, and what each does to the pending season."""
    lines = _with_code(page_lines(pages.select("doc_id", "page_num", "text")), table=True)
    line = F.col("line")
    ends = line.rlike(SEASON_END) & ~line.rlike("^" + CODE)
    season = F.when(ends, F.initcap(F.lower(F.regexp_extract(line, SEASON_END, 1))))
    neutral = (line == "") | line.rlike(YEAR_LINE) | line.rlike(PLACE_YEAR_LINE)
    lines = lines.withColumns({"_season": season, "_neutral": neutral})
    event = (F.when(F.col("_season").isNotNull(), F.col("_season")).when(F.col("_neutral"), None)
             .when(F.col("course_code").isNotNull(), "").when(line.rlike(PLACE), None).otherwise(""))
    return lines.withColumns({"_event": event, "_is_course": F.col("_season").isNull() & ~F.col("_neutral") & F.col("course_code").isNotNull()})


def has_table_rows(pages: DataFrame) -> DataFrame:
    """Documents in which the table reading finds at least one course row."""
    rows = _table_lines(pages).filter(F.col("_is_course") & F.col("_rest").rlike(GRADE))
    return rows.select("doc_id").distinct()


def tabular_courses(pages: DataFrame, tasks: int | None = None) -> DataFrame:
    """Course rows of table-like pages, where a season may stand on an earlier line and its year on the next.

    Every line either sets the pending season, clears it ('') or leaves it (null); what a course line sees is the last
    such event before it, over page ends too.
    """
    line = F.col("line")
    seen = carry_forward(_table_lines(pages), ["doc_id"], F.floor(F.col("page_num") / PAGE_RUN), ["page_num", "line_no"],
                         "_event", "_pending", include_current=False, tasks=tasks or text_tasks(pages))
    nxt = F.coalesce("next_line", F.lit(""))
    grade = X.found(F.col("_rest"), GRADE)
    pending = F.nullif("_pending", F.lit(""))
    year = F.coalesce(X.found(nxt, YEAR_LINE), X.found(nxt, PLACE_YEAR_LINE), X.found(nxt, PLACE_YEAR_END))
    own_season = F.initcap(F.lower(X.found(line, SEASON_END)))
    term = F.coalesce(X.term_in_text(line), F.concat(pending, F.lit(" "), year),
                      F.concat(own_season, F.lit(" "), X.found(nxt, YEAR_LINE)), F.lit(NO_TERM))
    rows = seen.filter(F.col("_is_course")).withColumns({"grade": X.grade_text(grade), "term_taken": term}).filter("grade IS NOT NULL")
    ahead = F.when(F.col("_rest").rlike("^" + GRADE), F.col("_rest")).otherwise(_before(F.col("_rest"), GRADE))
    rows = rows.withColumn("_ahead", ahead)
    last_number = r"^([\s\S]*)\b(\d+)\b(?!\d)[\s\S]*?$"
    numbers = F.regexp_extract_all("_ahead", F.lit(r"\b(\d+)\b"), F.lit(1))
    lead = F.when(F.size(numbers) > 0, F.regexp_extract("_ahead", last_number, 1)).otherwise(F.col("_ahead"))
    title = F.regexp_replace(X.strip(lead), r"^[\s\|\-:]+", "")
    title = F.regexp_replace(F.regexp_replace(title, r"[\s\|\-:]+$", ""), r"\s+\d+\s*$", "")
    return rows.select("doc_id", "page_num", "line_no", "course_code", "grade", "term_taken",
                       F.try_element_at(numbers, F.lit(-1)).alias("credits"), _title(title).alias("title"))


def free_courses(pages: DataFrame, tasks: int | None = None) -> DataFrame:
    """Course rows of pages grouped by term or in running lines."""
    tasks = tasks or text_tasks(pages)
    lines = page_lines(pages.select("doc_id", "page_num", "text"), keep_blank=False).repartition(tasks, "doc_id", "page_num")
    line, nxt = F.col("line"), F.coalesce("next_line", F.lit(""))
    lines = _with_code(lines, table=False).withColumn("_term", X.term_in_text(line))
    header = F.col("_term").isNotNull() & ((F.length("line") < 50) | F.lower(line).startswith("term") | F.lower(line).startswith("semester"))
    lines = lines.withColumn("_head", F.when(header, F.col("_term")))
    before = Window.partitionBy("doc_id", "page_num").orderBy("line_no").rowsBetween(-LOOK_BACK, -1)
    lines = lines.withColumn("_near", F.first("_term", ignorenulls=True).over(before))
    lines = carry_forward(lines, ["doc_id"], F.col("page_num"), ["page_num", "line_no"],
                          "_head", "_current", tasks=tasks)
    own, other = X.found(F.col("_rest"), GRADE), X.found(nxt, GRADE)
    year = X.found(nxt, r"^(\d{4})\b")
    split_term = F.concat(F.initcap(F.lower(X.found(line, SEASON_END))), F.lit(" "), year)
    term = F.coalesce("_term", split_term, "_current", "_near", F.lit(NO_TERM))
    rows = lines.filter("course_code IS NOT NULL").withColumns({"grade": X.grade_text(F.coalesce(own, other)), "term_taken": term})
    # The title runs to the grade's offset, which is counted from the code's end or, for a grade on the next line,
    # from that line's start, and is applied to the whole line.
    offset = F.when(own.isNotNull(), F.when(F.col("_rest").rlike("^" + GRADE), 0).otherwise(F.length(_before(F.col("_rest"), GRADE)))) \
        .otherwise(F.when(nxt.rlike("^" + GRADE), 0).otherwise(F.length(_before(nxt, GRADE))))
    begin = F.length("line") - F.length("_rest")
    span = X.strip(F.substring(line, begin + 1, F.greatest(F.lit(0), offset - begin)))
    title = F.regexp_replace(F.regexp_replace(span, r"^\s*[-:]\s*", ""), r"\s+\d+(?:\.\d+)?\s*$", "")
    return rows.filter("grade IS NOT NULL").select(
        "doc_id", "page_num", "line_no", "course_code", "grade", "term_taken", X.found(line, CREDITS).alias("credits"),
        X.strip(_title(title)).alias("title"))


def transcript_courses(pages: DataFrame) -> DataFrame:
    """Course rows by layout; a table-like document that gives none is read as free text.

    Pages are dealt to as many tasks as their texts need, and documents are told apart there.
    """
    tasks = text_tasks(pages)
    kinds = layout(pages)
    dealt = pages.repartition(tasks, "doc_id")
    tab = dealt.join(kinds.filter("layout = 'tabular'").select("doc_id").hint("merge"), "doc_id", "left_semi")
    free = dealt.join(has_table_rows(tab).hint("merge"), "doc_id", "left_anti")
    return tabular_courses(tab, tasks).unionByName(free_courses(free, tasks))


def matched(courses: DataFrame, codes: DataFrame) -> DataFrame:
    """Course rows whose code is among the case's codes (J5). Both sides carry request_id."""
    wanted = codes.select("request_id", X.transcript_code(F.col("code")).alias("course_code")).distinct()
    return courses.join(wanted, ["request_id", "course_code"], "left_semi")


def results(pages: DataFrame, courses: DataFrame, codes: DataFrame) -> DataFrame:
    """Per request: extracted, matched and saved course counts and the outcome."""
    count = lambda df, name: df.groupBy("request_id").agg(F.count(F.lit(1)).alias(name))
    shape = pages.groupBy("request_id").agg(F.bool_and(F.length(X.strip(F.coalesce("text", F.lit("")))) < 50).alias("_short"))
    out = shape.join(count(courses, "_n"), "request_id", "left").join(count(matched(courses, codes), "_m"), "request_id", "left")
    out = out.join(codes.select("request_id").distinct().withColumn("_coded", F.lit(True)), "request_id", "left")
    n = F.when(F.col("_short"), 0).otherwise(F.coalesce("_n", F.lit(0)))
    m = F.when(F.col("_short"), 0).when(F.col("_coded"), F.coalesce("_m", F.lit(0))).otherwise(n)
    return out.select("request_id", n.alias("total_extracted"), m.alias("matched_count"), m.alias("saved_count"),
                      F.when(F.col("_short"), "failed").when((n == 0) | (m == 0), "partial").otherwise("success").alias("status"))
