"""Catalog pages: course blocks, target matching, page selection by code and by table of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.functions import text as X
from casemill.operators.chunks import page_lines
from casemill.operators.common import carry_forward, in_order, newest_per

# ---- fixed values ----------------------------------------------------------
CODE = r"\b([A-Z]{2,6})\s*([0-9]{3,4}[A-Z]?)\b"
DOTTED_CODE = r"\b(\d{1,2})\.(\d{2,4}[A-Z]?)\b"
HEADER = r"^([A-Z]{2,6})\s*(\d{3,4}[A-Z]?)\.\s*(.+?)\.\s*(\d+)\s*Credit\s*Hours?\.?\s*$"
HEADER_NO_CREDITS = r"^([A-Z]{2,6})\s*(\d{3,4}[A-Z]?)\.\s*(.+?)\.?\s*$"
DOTTED_HEADER = r"^(\d{1,2}\.\d{2,4}[A-Z]?)\s+([A-Z][A-Za-z,\s&\-]+?)(?:\s*,|\s*$)"
STARTS = r"(?=\b[A-Z]{2,6}\s*\d{3,4}[A-Z]?\.)"
DOTTED_STARTS = r"(?=\b\d{1,2}\.\d{2,4}[A-Z]?\s+[A-Z])"
EXPECTED = r"(?i)Expected(?: background)?:\s*(.+)$"
#: The domain's own limits; nothing is cut unless one is given.
BODY_LINE_LIMIT = 350
TOC_ENTRY = r"^(.+?)\s*[\.·…]+\s*(\d{1,4})\s*$"
TOC_ENTRY_PLAIN = r"^([A-Z][A-Za-z\s,&\-\(\)]+)\s+(\d{1,4})\s*$"
SECTION_KEYWORDS = {
    "MED": ("medicine", "medical", "biology and medicine", "division of biology"),
    "BIOL": ("biology", "biological"),
    "PHP": ("public health",),
    "NEUR": ("neuroscience",),
    "CHEM": ("chemistry",),
    "PHYS": ("physics",),
    "ECON": ("economics",),
    "CSCI": ("computer science",),
    "MATH": ("mathematics",),
    "APPH": ("applied physiology", "health", "physiology"),
    "EAS": ("earth", "environmental", "atmospheric"),
    "CS": ("computer science",),
    "ECE": ("electrical", "computer engineering"),
    "10": ("chemical engineering",),
    "5": ("chemistry",),
    "6": ("electrical engineering", "computer science"),
    "7": ("biology",),
    "8": ("physics",),
    "18": ("mathematics",),
}
#: The domain's own limits; nothing is cut unless one is given.
TOC_PAGES, OFFSET_PAGES, INDEX_PAGES = 20, 20, 100
# ----------------------------------------------------------------------------

PAGE_RUN = 64  # pages per window task in ordered passes


def structure(pages: DataFrame) -> DataFrame:
    """Whether a document is a structured course catalog at all."""
    text = F.col("text")
    courseish = text.rlike(CODE) | text.rlike(DOTTED_CODE)
    return pages.groupBy("doc_id").agg(F.when(F.bool_or(courseish), "course_catalog_structured").otherwise(
        "program_level").alias("structure_type"))


def candidate_lines(pages: DataFrame) -> DataFrame:
    """Non-blank line pieces in order, cut where a course code starts inside a line."""
    lines = page_lines(pages.select("doc_id", "page_num", "text"), keep_blank=False)
    pieces = F.flatten(F.transform(F.split("line", STARTS), lambda p: F.split(p, DOTTED_STARTS)))
    return lines.select("doc_id", "page_num", "line_no", F.posexplode(pieces).alias("part", "line")).withColumn(
        "line", X.strip(F.col("line"))).filter("line <> ''")


def _header() -> Column:
    line = F.col("line")
    get = lambda p, i: F.regexp_extract(line, p, i)

    def lettered(p: str, credits: Column) -> Column:
        return F.struct(F.concat_ws(" ", get(p, 1), get(p, 2)).alias("course_code"), get(p, 1).alias("subject"),
                        get(p, 2).alias("course_number"), X.strip(get(p, 3)).alias("title"), credits.alias("credits_or_units"))

    dotted = F.struct(get(DOTTED_HEADER, 1).alias("course_code"), F.split_part(get(DOTTED_HEADER, 1), F.lit("."), F.lit(1)).alias("subject"),
                      F.split_part(get(DOTTED_HEADER, 1), F.lit("."), F.lit(2)).alias("course_number"),
                      X.strip(get(DOTTED_HEADER, 2)).alias("title"), F.lit(None).cast("string").alias("credits_or_units"))
    return (
        F.when(line.rlike(HEADER), lettered(HEADER, get(HEADER, 4)))
        .when(line.rlike(HEADER_NO_CREDITS), lettered(HEADER_NO_CREDITS, F.lit(None).cast("string")))
        .when(line.rlike(DOTTED_HEADER), dotted)
    )


def candidates(pages: DataFrame, body_line_limit: int | None = None) -> DataFrame:
    """Course blocks of each catalog in document order.

    A block is keyed by the place of its header, carried forward over the lines after it; lines before the first
    header have no block. Give only the selected pages for the selected-page form.
    """
    lines = candidate_lines(pages).withColumn("_h", _header())
    lines = lines.withColumn("_start", F.when(F.col("_h").isNotNull(), F.struct("page_num", "line_no", "part")))
    placed = carry_forward(lines, ["doc_id"], F.floor(F.col("page_num") / PAGE_RUN), ["page_num", "line_no", "part"],
                           "_start", "block").filter("block IS NOT NULL")
    at = F.struct("page_num", "line_no", "part")
    body = F.col("_h").isNull()
    expected = F.when(body, X.found(F.col("line"), EXPECTED))
    # The first "Expected:" line gives the prerequisites; later ones are body text like any other line.
    agg = placed.groupBy("doc_id", "block").agg(
        F.max("_h").alias("h"),
        F.min_by(X.strip(expected), F.when(expected.isNotNull(), at)).alias("prerequisites"),
        F.min(F.when(expected.isNotNull(), at)).alias("_taken"),
        F.array_sort(F.collect_set("page_num")).alias("source_pages"),
        F.array_sort(F.collect_list(F.when(body & (F.lit(True) if body_line_limit is None else F.length("line") <= body_line_limit),
                                           F.struct(at.alias("at"), "line")))).alias("_body"))
    kept = F.filter("_body", lambda b: F.col("_taken").isNull() | (b["at"] != F.col("_taken")))
    text = F.array_join(F.transform(kept, lambda b: b["line"]), " ")
    return agg.select("doc_id", "block", "h.course_code", "h.subject", "h.course_number", "h.title", "h.credits_or_units",
                      F.nullif(text, F.lit("")).alias("description"), F.nullif("prerequisites", F.lit("")).alias("prerequisites"),
                      "source_pages")


def match_target(found: DataFrame, targets: DataFrame) -> DataFrame:
    """Best candidate per target: exact code, else exact title, else none.

    ``targets``: doc_id, target_code, target_title. Both equality joins keep one row per target before the union.
    """
    title = lambda c: F.lower(X.squeeze(F.coalesce(F.col(c), F.lit(""))))
    c = found.withColumns({"_code": X.catalog_code(F.col("course_code")), "_title": title("title")})
    t = targets.withColumns({"_code": X.catalog_code(F.col("target_code")), "_title": F.nullif(title("target_title"), F.lit(""))})
    def join(key: str, prio: int) -> DataFrame:
        return t.select("doc_id", "target_code", key).join(c.select("doc_id", "block", "course_code", "title", "source_pages", key),
                                                           ["doc_id", key]).drop(key).withColumn("prio", F.lit(prio))

    best = newest_per(join("_code", 0).unionByName(join("_title", 1)), ["doc_id", "target_code"], ["prio", "block"], oldest=True)
    out = targets.join(best, ["doc_id", "target_code"], "left")
    reason = F.when(F.col("prio") == 0, "matched_by_course_code").when(F.col("prio") == 1, "matched_by_title").otherwise("no_match")
    return out.withColumn("reason", reason).drop("prio")


def match_evidence(matches: DataFrame, found: DataFrame) -> DataFrame:
    """Evidence row per target: the match, or an unknown row that says why."""
    counts = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("candidate_count"))
    hit = F.col("course_code").isNotNull()
    why = F.to_json(F.struct("target_course_code", "target_title", "reason", "candidate_count"), {"ignoreNullFields": "false"})
    out = matches.withColumn("target_course_code", F.col("target_code")).join(counts, "doc_id", "left").withColumn(
        "candidate_count", F.coalesce("candidate_count", F.lit(0)))
    return out.select(
        "doc_id", "target_code", F.lit("catalog_course_match").alias("fact_type"),
        F.concat(F.lit("match::"), F.coalesce("course_code", "target_code", F.lit("unknown"))).alias("fact_key"),
        F.col("course_code").alias("fact_value"), F.when(~hit, why).alias("fact_json"), (~hit).alias("is_unknown"),
        F.when(hit, F.concat(F.lit("Catalog matched via "), "reason")).otherwise("No matching course found in catalog document").alias("notes"),
        "source_pages")


def match_citations(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of a match's pages; without any, those of the document's first page with chunks."""
    ev = evidence.select("doc_id", "fact_key", "source_pages")
    paged = ev.withColumn("page_num", F.explode("source_pages")).drop("source_pages")
    own = paged.join(chunks, ["doc_id", "page_num"]).select("doc_id", "fact_key", "chunk_id")
    bare = ev.select("doc_id", "fact_key").join(own, ["doc_id", "fact_key"], "left_anti")
    first = chunks.groupBy("doc_id").agg(F.min("page_num").alias("page_num"))
    return own.unionByName(bare.join(first, "doc_id").join(chunks, ["doc_id", "page_num"]).select("doc_id", "fact_key", "chunk_id"))


# ---- page selection --------------------------------------------------------

def direct_pages(pages: DataFrame, targets: DataFrame, context: int = 2) -> DataFrame:
    """Pages that name the target code, with ``context`` pages around each hit.

    The code is matched literally but for the blanks in it, which may be missing or many.
    """
    norm = lambda c: F.upper(F.regexp_replace(c, r"(?U)\s+", ""))
    hits = pages.select("doc_id", "page_num", norm("text").alias("_t")).join(
        targets.select("doc_id", "target_code"), "doc_id").filter(F.col("_t").contains(norm("target_code")))
    around = hits.select("doc_id", "target_code", F.explode(F.sequence(F.col("page_num") - context, F.col("page_num") + context)).alias("page_num"))
    return around.distinct().join(pages.select("doc_id", "page_num"), ["doc_id", "page_num"], "left_semi")


def _first_pages(pages: DataFrame, n: int | None) -> DataFrame:
    return pages if n is None else pages.filter(F.col("page_num") <= n)


def toc_flags(pages: DataFrame, max_pages: int | None = None, heading_chars: int | None = None) -> DataFrame:
    """Per page (the first ``max_pages`` if given): contents heading, dotted lines, page-number lines, and the verdict.

    The word "contents" counts anywhere on a page, or only in its first ``heading_chars`` characters; the domain's limit is 200.
    """
    low = F.lower("text")
    top = low if heading_chars is None else F.substring(low, 1, heading_chars)
    head = low.contains("table of contents") | top.contains("contents")
    dotted = F.regexp_count("text", F.lit(r"\.{3,}|…+"))
    numbered = F.regexp_count("text", F.lit(r"(?m)" + TOC_ENTRY))
    early = _first_pages(pages, max_pages)
    return early.select("doc_id", "page_num", head.alias("has_header"), dotted.alias("dotted_count"), numbered.alias("page_num_count"),
                        (head | ((dotted > 5) & (numbered > 3))).alias("is_toc"))


def toc_entries(pages: DataFrame, max_pages: int | None = None, heading_chars: int | None = None) -> DataFrame:
    """Section → page of each table of contents; the last line of a section wins, its first line keeps the order."""
    toc = pages.join(toc_flags(pages, max_pages, heading_chars).filter("is_toc").select("doc_id", "page_num"), ["doc_id", "page_num"], "left_semi")
    lines = page_lines(toc.select("doc_id", "page_num", "text"), keep_blank=False)
    line = F.col("line")
    dotted = line.rlike(TOC_ENTRY)
    section = F.when(dotted, F.regexp_extract(line, TOC_ENTRY, 1)).when(line.rlike(TOC_ENTRY_PLAIN), F.regexp_extract(line, TOC_ENTRY_PLAIN, 1))
    number = F.when(dotted, F.regexp_extract(line, TOC_ENTRY, 2)).otherwise(F.regexp_extract(line, TOC_ENTRY_PLAIN, 2))
    rows = lines.select("doc_id", "page_num", "line_no", X.strip(section).alias("section"), number.try_cast("int").alias("start_page"), dotted.alias("_d"))
    good = rows.filter("section <> '' AND start_page > 0").filter(F.col("_d") | (F.length("section") > 3))
    at = F.struct("page_num", "line_no")
    return good.groupBy("doc_id", "section").agg(F.max_by("start_page", at).alias("start_page"), F.min(at).alias("place"))


def section_of_subject(targets: DataFrame, entries: DataFrame) -> DataFrame:
    """First section, in table order, that holds a keyword of the target's subject."""
    keys = F.create_map(*[x for k, ws in SECTION_KEYWORDS.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in ws]))])
    subject = F.upper(F.coalesce(X.found(F.col("target_code"), CODE, 1), X.found(F.col("target_code"), DOTTED_CODE, 1)))
    asked = targets.select("doc_id", "target_code", subject.alias("subject")).filter("subject IS NOT NULL")
    asked = asked.withColumn("_keys", F.concat(F.coalesce(F.try_element_at(keys, "subject"), F.array().cast("array<string>")),
                                               F.array(F.lower("subject"))))
    hit = asked.join(entries, "doc_id").filter(F.exists("_keys", lambda k: F.lower("section").contains(k)))
    return newest_per(hit.select("doc_id", "target_code", "subject", "section", "start_page", "place"),
                      ["doc_id", "target_code"], ["place"], oldest=True)


def page_offsets(pages: DataFrame, max_check: int | None = None) -> DataFrame:
    """Page index less printed number, from the first page (of ``max_check`` if given) where they differ; else 0."""
    printed = X.found(F.col("text"), r"^\s*(\d{1,3})\s+[A-Z]", 1).cast("int")
    shift = F.nullif(F.col("page_num") - printed, F.lit(0))
    early = _first_pages(pages, max_check)
    return early.groupBy("doc_id").agg(F.coalesce(
        F.min_by(shift, F.when(shift.isNotNull(), F.col("page_num"))), F.lit(0)).alias("page_offset"))


def section_ranges(sections: DataFrame, entries: DataFrame, offsets: DataFrame, totals: DataFrame, buffer: int = 5) -> DataFrame:
    """Page range of a section, up to the next section in page order.

    As in the domain's rule the offset is added twice to an end taken from the next section, and a range of fewer
    than 20 pages is widened to 30 after its start.
    """
    following = Window.partitionBy("doc_id").orderBy("start_page", "place")  # a table of contents is a few pages long
    nexts = entries.select("doc_id", "section", "start_page", F.lead("start_page").over(following).alias("next_page"), "place")
    # With several sections on one page the first of them in page order decides.
    nexts = nexts.groupBy("doc_id", "start_page").agg(F.min_by("next_page", "place").alias("next_page"))
    base = sections.join(nexts, ["doc_id", "start_page"], "left").join(offsets, "doc_id").join(totals, "doc_id")
    off, total = F.col("page_offset"), F.col("n_pages")
    end = F.least(total, F.coalesce(F.col("next_page") + off + buffer, total) + off)
    start = F.greatest(F.lit(1), F.col("start_page") + off - 2)
    wide = F.when(end - start < 20, F.least(total, start + 30)).otherwise(end)
    return base.select("doc_id", "target_code", "section", start.cast("int").alias("first_page"), wide.cast("int").alias("last_page"))


def select_pages(pages: DataFrame, targets: DataFrame, toc_pages: int | None = None, offset_pages: int | None = None,
                 index_pages: int | None = None) -> DataFrame:
    """Page range or pages to parse per target, with the strategy that chose them.

    Direct hits come first, then the contents section, then a page that looks like an index, then every page.
    """
    key = ["doc_id", "target_code"]
    n = F.length(F.coalesce("text", F.lit("")))
    totals = pages.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n_pages"))
    direct = direct_pages(pages, targets).select(*key, "page_num", F.lit("direct_text_search").alias("strategy"))
    left = targets.join(direct.select(*key).distinct(), key, "left_anti")
    entries = toc_entries(pages, toc_pages)
    ranges = section_ranges(section_of_subject(left, entries), entries, page_offsets(pages, offset_pages), totals)
    span = lambda df: df.select(*key, F.explode(F.when(F.col("first_page") <= F.col("last_page"),
                                                       F.sequence("first_page", "last_page"))).alias("page_num"), "strategy")
    by_toc = span(ranges.withColumn("strategy", F.concat(F.lit("toc_section:"), "section")))
    left = left.join(ranges.select(*key), key, "left_anti")
    subject = F.coalesce(X.found(F.col("target_code"), CODE, 1), X.found(F.col("target_code"), DOTTED_CODE, 1))
    index_like = _first_pages(pages, index_pages).filter((n > 200) & F.col("text").rlike(r"[A-Z]\s+[A-Z]\s+[A-Z]"))
    near = left.withColumn("_s", subject).join(index_like, "doc_id").filter(F.col("text").contains(F.col("_s")))
    near = near.groupBy(*key).agg(F.min("page_num").alias("_p")).join(totals, "doc_id")
    by_index = span(near.select(
        *key, F.greatest(F.lit(1), F.col("_p") - 6).alias("first_page"),
        (F.least(F.col("n_pages"), F.col("_p") + 49) - 1).alias("last_page"), F.lit("alphabetical_search").alias("strategy")))
    left = left.join(near.select(*key), key, "left_anti")
    rest = left.join(pages.select("doc_id", "page_num"), "doc_id").select(*key, "page_num", F.lit("fallback_full_scan").alias("strategy"))
    return direct.unionByName(by_toc).unionByName(by_index).unionByName(rest)


# ---- bulk course parse -----------------------------------------------------

# ---- fixed values ----------------------------------------------------------
NOISE = (
    r"^2025-2026 Undergraduate Catalog",
    r"https://catalog\.[a-z]+\.edu",
    r"(?i)^\d{1,2}/\d{1,2}/\d{2},\s+\d{1,2}:\d{2}\s+(AM|PM)\s+Course Descriptions",
    r"^Contract All Courses",
    r"(?i)^Page:\s+\d+\s+\|",
)
COURSE_HEADER = r"^([A-Z]{2,5})\s+(\d{4})([A-Z]{0,2}|R|L)?\s+-\s+(.+)$"
GENED_IN_TITLE = r"\(([A-Z]{1,2}(?:\s+or\s+[A-Z]{1,2})?(?:\s*,\s*[A-Z]{1,2})*)\)\s*$"
CREDIT_LINES = (
    r"(?i)^\(([\d.]+(?:\s*-\s*[\d.]+)?)\)\s+Credit Hours$",
    r"(?i)^\s*Credit\s*Hours?\s*:\s*(.+?)\s*$",
    r"(?i)^\s*Credits?\s*:\s*(.+?)\s*$",
    r"(?i)^\s*(\d+(?:\.\d+)?)\s*(?:credit\s*hours?|credits?|hours?)\b.*$",
    r"(?i)^\s*(\d+)\s*\(\s*\d+\s*\)\s*$",
    r"(?i)^\s*(\d+)\s*-\s*\d+\s*-\s*\d+\s*$",
)
#: The domain's own limit; nothing is cut unless one is given.
CREDIT_SCAN_LINES = 12
# ----------------------------------------------------------------------------


def clean_lines(pages: DataFrame) -> DataFrame:
    """Lines without blanks and page furniture."""
    noise = F.lit(False)
    for p in NOISE:
        noise = noise | F.col("line").rlike(p)
    return page_lines(pages.select("doc_id", "page_num", "text"), keep_blank=False).filter(~noise).drop("next_line")


def parsed_courses(pages: DataFrame, credit_scan_lines: int | None = None) -> DataFrame:
    """Course rows of a bulk catalog: header, credits, description and what the description says."""
    lines = clean_lines(pages)
    is_header = F.col("line").rlike(COURSE_HEADER)
    lines = lines.withColumn("_start", F.when(is_header, F.struct("page_num", "line_no")))
    placed = carry_forward(lines, ["doc_id"], F.floor(F.col("page_num") / PAGE_RUN), ["page_num", "line_no"],
                           "_start", "block").filter("block IS NOT NULL")
    blocks = placed.groupBy("doc_id", "block").agg(F.array_sort(F.collect_list(F.struct("page_num", "line_no", "line"))).alias("b"))
    header = F.get("b", F.lit(0))
    credit = lambda line: F.coalesce(*[X.found(line, p) for p in CREDIT_LINES])
    # Place of the first credits line among the lines that may hold it; 0 when there is none.
    flags = F.transform(F.slice("b", 2, F.greatest(F.size("b"), F.lit(1)) if credit_scan_lines is None else F.lit(credit_scan_lines)), lambda r: credit(r["line"]).isNotNull())
    df = blocks.withColumns({"_header": header["line"], "header_page": header["page_num"],
                             "_k": F.coalesce(F.array_position(flags, True), F.lit(0)).cast("int")})
    df = df.withColumn("_credit", F.when(F.col("_k") > 0, F.get("b", F.col("_k"))))
    df = df.withColumn("_rest", F.slice("b", F.col("_k") + 2, F.greatest(F.lit(0), F.size("b") - F.col("_k") - 1)))
    raw = X.strip(credit(F.col("_credit.line")))
    full = X.strip(F.regexp_extract("_header", COURSE_HEADER, 4))
    pages_of = F.array_sort(F.array_distinct(F.transform("_rest", lambda r: r["page_num"])))
    get = lambda i: F.regexp_extract("_header", COURSE_HEADER, i)
    df = df.select(
        "doc_id", "block", "header_page", F.col("_header").alias("header_line"),
        F.concat(get(1), F.lit(" "), get(2), get(3)).alias("course_code"), get(1).alias("subject"), get(2).alias("number"), get(3).alias("suffix"),
        F.regexp_replace(F.regexp_replace(full, GENED_IN_TITLE, ""), r"\s+$", "").alias("title"),
        X.squeeze(F.regexp_extract(full, GENED_IN_TITLE, 1)).alias("gened_codes_in_title"),
        F.col("_credit.line").alias("credit_line"), F.col("_credit.page_num").alias("credit_page"),
        X.credit_range(raw).alias("_range"), raw.alias("credits_raw"),
        F.when(F.size(pages_of) > 0, pages_of).otherwise(F.array("header_page")).alias("desc_pages"),
        X.squeeze(F.array_join(F.transform("_rest", lambda r: r["line"]), " ")).alias("description"))
    text = F.col("description")
    return df.withColumns({
        "credits_min": F.col("_range.credits_min"), "credits_max": F.col("_range.credits_max"),
        "term_offered": X.term_offered(text), "gened_category_text": X.gened_category(text),
        "prerequisites": X.labelled(text, "Prerequisites"), "corequisites": X.labelled(text, "Corequisites"),
        "pre_or_corequisites": X.labelled(text, "Pre or Corequisites"), "flags": X.course_flags(text),
        "source_pages": F.array_sort(F.array_distinct(F.concat(F.array("header_page"), "desc_pages"))),
        "warning": F.when(F.col("credit_line").isNull(), F.concat(F.lit("Missing credits line for "), "course_code"))
        .when(F.col("_range.credits_min").isNull(), F.concat(F.lit("Credits are no number for "), "course_code")),
    }).drop("_range")


def course_chunks(courses: DataFrame) -> DataFrame:
    """Header, credits and description chunk of each course with short stable ids."""
    def chunk(kind: str, page: Column, key: Column, text: Column, where: Column) -> DataFrame:
        digest = F.sha2(F.concat_ws("||", F.col("doc_id").cast("string"), page, F.col("course_code"), F.lit(kind), key), 256)
        return courses.filter(where).select(F.substring(digest, 1, 32).alias("chunk_sha_id"), "course_code", "doc_id",
                                            F.split_part(page, F.lit(","), F.lit(1)).cast("int").alias("page"),
                                            F.lit(kind).alias("chunk_type"), text.alias("chunk_text"))

    col = F.col
    return (
        chunk("header", col("header_page").cast("string"), col("header_line"), col("header_line"), F.lit(True))
        .unionByName(chunk("credits", col("credit_page").cast("string"), col("credit_line"), col("credit_line"), col("credit_line").isNotNull()))
        .unionByName(chunk("description", F.array_join("desc_pages", ","), col("description"), col("description"), F.lit(True)))
    )


def corpus_metrics(courses: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files, courses and chunks of a bulk run."""
    a = courses.agg(F.countDistinct("doc_id").alias("n_files"), F.count(F.lit(1)).alias("n_courses"),
                    F.count("warning").alias("n_warnings"))
    return a.withColumn("n_chunks", chunks.agg(F.count(F.lit(1))).scalar())
