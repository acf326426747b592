"""Syllabus, catalog and transcript parsing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill.operators import catalog as C
from casemill.operators import syllabus as S
from casemill.operators import quality as Q
from casemill.operators import transcript as T
from casemill.plans.registry import query

HEADS = {k: v for k, v in S.SECTIONS.items()}


def section_sql(name: str) -> str:
    tail = f"regexp_extract(t, '(?is)(?:{HEADS[name]})\\s*(.+)', 1)"
    return (f"CASE WHEN regexp_matches(t, '(?is)(?:{HEADS[name]})\\s*(.+)') THEN trim(regexp_replace({tail}, '(?s)\\n[A-Z][A-Za-z /&]{{3,}}\\n.*$', ''), ' ' || chr(10)) END")


CREDIT_SQL = "coalesce(" + ", ".join(f"nullif(regexp_extract(t, '{c}', 1), '')" for c in S.CREDIT_FORMS) + ")"
SYLLABUS_SQL = f"""docs AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY page_num) AS t, max(CASE WHEN page_num = 1 THEN text END) AS p1 FROM @syllabus_pages GROUP BY doc_id),
l0 AS (SELECT *, list_filter(list_transform(string_split(p1, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1] AS line0,
  list_filter(list_transform(regexp_split_to_array(trim(p1, ' ' || chr(10)), '\\n\\s*\\n'), lambda x: trim(x)), lambda x: x <> '') AS paras FROM docs),
l1 AS (SELECT *, trim(regexp_replace(trim(regexp_replace(line0, '^[A-Z]{{2,6}}\\s*\\d{{3,4}}[A-Z]?\\s*[–—-]\\s*', '')), '^\\d{{1,2}}\\.\\d{{3,4}}\\s*[–—-]\\s*', '')) AS cleaned FROM l0),
sf AS (SELECT doc_id, CASE WHEN regexp_matches(t, '\\b([A-Z]{{2,6}})\\s*([0-9]{{3,4}}[A-Z]?)\\b') THEN regexp_extract(t, '\\b([A-Z]{{2,6}})\\s*([0-9]{{3,4}}[A-Z]?)\\b', 1) || ' ' || regexp_extract(t, '\\b([A-Z]{{2,6}})\\s*([0-9]{{3,4}}[A-Z]?)\\b', 2)
    ELSE nullif(regexp_extract(t, '\\b(\\d{{1,2}}\\.\\d{{3,4}})\\b', 1), '') END AS course_code,
  CASE WHEN cleaned <> '' THEN cleaned END AS title, {CREDIT_SQL} AS credits_or_units,
  coalesce({section_sql('description')}, CASE WHEN len(paras) >= 2 THEN trim(paras[2]) END) AS description,
  {section_sql('prerequisites')} AS prerequisites, {section_sql('learning_outcomes')} AS learning_outcomes FROM l1)"""


@query("syllabus_facts", "T3", f"WITH {SYLLABUS_SQL} SELECT * FROM sf")
def syllabus_facts(t):
    return S.syllabus_facts(t.syllabus_pages.drop("request_id"))


FACT_ROWS = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS fact_key, {k} AS fact_value FROM sf" for k in S.FACT_KEYS)


@query("syllabus_fact_rows", "T4", f"""WITH {SYLLABUS_SQL} SELECT doc_id, fact_key, fact_value, fact_value IS NULL AS is_unknown,
  CASE WHEN coalesce(fact_value, '') = '' THEN 'Missing ' || fact_key || ' in syllabus' END AS notes FROM ({FACT_ROWS})""")
def syllabus_fact_rows(t):
    return S.fact_rows(S.syllabus_facts(t.syllabus_pages.drop("request_id"))).drop("fact_type")


@query("catalog_structure", "T6", """SELECT doc_id, CASE WHEN bool_or(regexp_matches(text, '\\b([A-Z]{2,6})\\s*([0-9]{3,4}[A-Z]?)\\b') OR regexp_matches(text, '\\b(\\d{1,2})\\.(\\d{2,4}[A-Z]?)\\b'))
  THEN 'course_catalog_structured' ELSE 'program_level' END AS structure_type FROM @doc_pages GROUP BY doc_id""")
def catalog_structure(t):
    return C.structure(t.doc_pages)


def flat(df):
    return df.withColumn("source_pages", F.array_join("source_pages", ","))


# RE2 knows no look-ahead: a mark is put before each course start and the line is split at the marks.
CANDIDATE_SQL = r"""rl AS (SELECT doc_id, page_num, generate_subscripts(x, 1) AS i, unnest(x) AS line FROM (SELECT doc_id, page_num, list_filter(list_transform(
  string_split(regexp_replace(regexp_replace(replace(text, chr(10), chr(2)), '\b([A-Z]{2,6}[ ]*\d{3,4}[A-Z]?\.)', chr(2) || '\1', 'g'), '\b(\d{1,2}\.\d{2,4}[A-Z]?[ ]+[A-Z])', chr(2) || '\1', 'g'), chr(2)),
  lambda x: trim(x)), lambda x: x <> '') AS x FROM @catalog_pages)),
ch AS (SELECT *, regexp_matches(line, '^([A-Z]{2,6})\s*(\d{3,4}[A-Z]?)\.\s*(.+?)\.\s*(\d+)\s*Credit\s*Hours?\.?\s*$') AS h1, regexp_matches(line, '^([A-Z]{2,6})\s*(\d{3,4}[A-Z]?)\.\s*(.+?)\.?\s*$') AS h2,
  regexp_matches(line, '^(\d{1,2}\.\d{2,4}[A-Z]?)\s+([A-Z][A-Za-z,\s&\-]+?)(?:\s*,|\s*$)') AS h3 FROM rl),
cb AS (SELECT *, h1 OR h2 OR h3 AS h, sum((h1 OR h2 OR h3)::INT) OVER (PARTITION BY doc_id ORDER BY page_num, i) AS b FROM ch),
cx AS (SELECT *, CASE WHEN NOT h THEN nullif(regexp_extract(line, '(?i)Expected(?: background)?:\s*(.+)$', 1), '') END AS ex FROM cb WHERE b > 0),
cy AS (SELECT *, ex IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, b, ex IS NOT NULL ORDER BY page_num, i) = 1 AS taken FROM cx),
cand AS (SELECT doc_id, b, min(page_num) AS page_num, max(CASE WHEN h1 OR (h2 AND h) THEN regexp_extract(line, '^([A-Z]{2,6})', 1) || ' ' || regexp_extract(line, '^[A-Z]{2,6}\s*(\d{3,4}[A-Z]?)', 1) WHEN h3 THEN regexp_extract(line, '^(\S+)', 1) END) AS course_code,
  max(CASE WHEN h1 THEN regexp_extract(line, '^[A-Z]{2,6}\s*\d{3,4}[A-Z]?\.\s*(.+?)\.\s*\d+\s*Credit\s*Hours?\.?\s*$', 1) WHEN h2 THEN regexp_extract(line, '^[A-Z]{2,6}\s*\d{3,4}[A-Z]?\.\s*(.+?)\.?\s*$', 1)
    WHEN h3 THEN trim(regexp_extract(line, '^\S+\s+([A-Z][A-Za-z,\s&\-]+?)(?:\s*,|\s*$)', 1)) END) AS title, max(CASE WHEN h1 THEN regexp_extract(line, '(\d+)\s*Credit\s*Hours?\.?\s*$', 1) END) AS credits_or_units,
  nullif(coalesce(string_agg(line, ' ' ORDER BY page_num, i) FILTER (WHERE NOT h AND NOT taken), ''), '') AS description, max(ex) FILTER (WHERE taken) AS prerequisites,
  array_to_string(list_sort(list_distinct(list(page_num))), ',') AS source_pages FROM cy GROUP BY doc_id, b)"""


@query("catalog_candidates", "T5 W7", f"""WITH {CANDIDATE_SQL} SELECT doc_id, page_num, course_code, CASE WHEN contains(course_code, '.') THEN split_part(course_code, '.', 1) ELSE split_part(course_code, ' ', 1) END AS subject,
  CASE WHEN contains(course_code, '.') THEN split_part(course_code, '.', 2) ELSE split_part(course_code, ' ', 2) END AS course_number, title, credits_or_units, description, prerequisites, source_pages FROM cand""")
def catalog_candidates(t):
    return flat(C.candidates(t.catalog_pages)).select(
        "doc_id", F.col("block.page_num").alias("page_num"), "course_code", "subject", "course_number", "title", "credits_or_units",
        "description", "prerequisites", "source_pages")


MATCH_SQL = CANDIDATE_SQL + """,
mt AS (SELECT t.doc_id, t.target_code, t.target_title, c.b, c.course_code, c.title, c.source_pages, CASE WHEN c.course_code = trim(regexp_replace(t.target_code, '\\s+', ' ', 'g')) THEN 0 ELSE 1 END AS prio
  FROM @catalog_targets t JOIN cand c ON c.doc_id = t.doc_id AND (c.course_code = trim(regexp_replace(t.target_code, '\\s+', ' ', 'g'))
    OR lower(trim(c.title)) = lower(trim(regexp_replace(t.target_title, '\\s+', ' ', 'g')))) QUALIFY row_number() OVER (PARTITION BY t.doc_id, t.target_code ORDER BY prio, c.b) = 1),
mx AS (SELECT t.doc_id, t.target_code, t.target_title, m.course_code, m.title, m.source_pages, CASE m.prio WHEN 0 THEN 'matched_by_course_code' WHEN 1 THEN 'matched_by_title' ELSE 'no_match' END AS reason
  FROM @catalog_targets t LEFT JOIN mt m ON m.doc_id = t.doc_id AND m.target_code = t.target_code)"""


@query("catalog_matches", "J6", f"WITH {MATCH_SQL} SELECT doc_id, target_code, course_code, title, reason FROM mx")
def catalog_matches(t):
    return C.match_target(C.candidates(t.catalog_pages), t.catalog_targets).select(
        "doc_id", "target_code", "course_code", "title", "reason")


@query("catalog_match_evidence", "T7", f"""WITH {MATCH_SQL}, n AS (SELECT doc_id, count(*) AS n FROM cand GROUP BY 1)
SELECT mx.doc_id, target_code, 'catalog_course_match' AS fact_type, 'match::' || coalesce(course_code, target_code, 'unknown') AS fact_key, course_code AS fact_value,
  CASE WHEN course_code IS NULL THEN CAST(to_json({{'target_course_code': target_code, 'target_title': target_title, 'reason': reason, 'candidate_count': coalesce(n.n, 0)}}) AS VARCHAR) END AS fact_json,
  course_code IS NULL AS is_unknown, CASE WHEN course_code IS NULL THEN 'No matching course found in catalog document' ELSE 'Catalog matched via ' || reason END AS notes FROM mx LEFT JOIN n ON n.doc_id = mx.doc_id""")
def catalog_match_evidence(t):
    found = C.candidates(t.catalog_pages)
    return C.match_evidence(C.match_target(found, t.catalog_targets), found).drop("source_pages")


@query("catalog_match_citations", "T7", f"""WITH {MATCH_SQL}, ev AS (SELECT doc_id, 'match::' || coalesce(course_code, target_code, 'unknown') AS fact_key, string_split(source_pages, ',') AS sp FROM mx),
ck AS (SELECT doc_id, page_num, md5(text) AS chunk_id FROM @catalog_pages WHERE text <> ''), own AS (SELECT ev.doc_id, fact_key, chunk_id FROM ev JOIN ck ON ck.doc_id = ev.doc_id AND list_contains(sp, CAST(page_num AS VARCHAR)))
SELECT * FROM own UNION ALL SELECT ev.doc_id, fact_key, chunk_id FROM ev JOIN ck ON ck.doc_id = ev.doc_id WHERE page_num = (SELECT min(page_num) FROM ck k WHERE k.doc_id = ev.doc_id)
  AND NOT EXISTS (SELECT 1 FROM own o WHERE o.doc_id = ev.doc_id AND o.fact_key = ev.fact_key)""")
def catalog_match_citations(t):
    found = C.candidates(t.catalog_pages)
    ev = C.match_evidence(C.match_target(found, t.catalog_targets), found)
    chunks = t.catalog_pages.filter("text <> ''").select("doc_id", "page_num", F.md5("text").alias("chunk_id"))
    return C.match_citations(ev, chunks)


@query("direct_pages", "J15", """WITH h AS (SELECT p.doc_id, t.target_code, p.page_num FROM @catalog_pages p JOIN @catalog_targets t ON t.doc_id = p.doc_id
  WHERE contains(upper(regexp_replace(p.text, '\\s+', '', 'g')), upper(replace(t.target_code, ' ', ''))))
SELECT DISTINCT h.doc_id, h.target_code, p.page_num FROM h JOIN @catalog_pages p ON p.doc_id = h.doc_id AND p.page_num BETWEEN h.page_num - 2 AND h.page_num + 2""")
def direct_pages(t):
    return C.direct_pages(t.catalog_pages, t.catalog_targets).select("doc_id", "target_code", "page_num")


@query("toc_pages", "A20", """SELECT doc_id, page_num, contains(lower(text), 'contents') AS has_header,
  CAST(len(regexp_extract_all(text, '\\.{3,}|…+')) AS INTEGER) AS dotted_count, CAST(len(regexp_extract_all(text, '(?m)^(.+?)\\s*[\\.·…]+\\s*(\\d{1,4})\\s*$')) AS INTEGER) AS page_num_count
FROM @catalog_pages""")
def toc_pages(t):
    return C.toc_flags(t.catalog_pages).drop("is_toc")


ENTRY, PLAIN = C.TOC_ENTRY, C.TOC_ENTRY_PLAIN
TOC_SQL = f"""tf AS (SELECT doc_id, page_num, text FROM @catalog_pages WHERE contains(lower(text), 'contents')
  OR len(regexp_extract_all(text, '\\.{{3,}}|…+')) > 5 AND len(regexp_extract_all(text, '(?m){ENTRY}')) > 3),
tl AS (SELECT doc_id, page_num, generate_subscripts(x, 1) AS line_no, unnest(x) AS line FROM (SELECT doc_id, page_num,
  list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS x FROM tf)),
tr AS (SELECT doc_id, page_num * 100000 + line_no AS spot, regexp_matches(line, '{ENTRY}') AS d,
  trim(CASE WHEN regexp_matches(line, '{ENTRY}') THEN regexp_extract(line, '{ENTRY}', 1) WHEN regexp_matches(line, '{PLAIN}') THEN regexp_extract(line, '{PLAIN}', 1) END) AS section,
  TRY_CAST(CASE WHEN regexp_matches(line, '{ENTRY}') THEN regexp_extract(line, '{ENTRY}', 2) ELSE regexp_extract(line, '{PLAIN}', 2) END AS INTEGER) AS start_page FROM tl),
te AS (SELECT doc_id, section, arg_max(start_page, spot) AS start_page, min(spot) AS place FROM tr WHERE section <> '' AND start_page > 0 AND (d OR length(section) > 3) GROUP BY 1, 2),
sk(subject, word) AS (VALUES {', '.join(f"('{k}', '{w}')" for k, ws in C.SECTION_KEYWORDS.items() for w in ws)}),
asked AS (SELECT doc_id, target_code, upper(coalesce(nullif(regexp_extract(target_code, '\\b([A-Z]{{2,6}})\\s*([0-9]{{3,4}}[A-Z]?)\\b', 1), ''), nullif(regexp_extract(target_code, '\\b(\\d{{1,2}})\\.(\\d{{2,4}}[A-Z]?)\\b', 1), ''))) AS subject
  FROM @catalog_targets),
ss AS (SELECT a.doc_id, target_code, a.subject, te.section, te.start_page FROM asked a JOIN te ON te.doc_id = a.doc_id
  WHERE contains(lower(te.section), lower(a.subject)) OR EXISTS (SELECT 1 FROM sk WHERE sk.subject = a.subject AND contains(lower(te.section), word))
  QUALIFY row_number() OVER (PARTITION BY a.doc_id, target_code ORDER BY place) = 1)"""


@query("toc_entries", "T12 W2", f"WITH {TOC_SQL} SELECT doc_id, section, start_page FROM te")
def toc_entries(t):
    return C.toc_entries(t.catalog_pages).select("doc_id", "section", "start_page")


@query("subject_sections", "J12", f"WITH {TOC_SQL} SELECT doc_id, target_code, section, start_page FROM ss")
def subject_sections(t):
    return C.section_of_subject(t.catalog_targets, C.toc_entries(t.catalog_pages)).select("doc_id", "target_code", "section", "start_page")


@query("page_offsets", "W13", """WITH p AS (SELECT doc_id, page_num, page_num - TRY_CAST(nullif(regexp_extract(text, '^\\s*(\\d{1,3})\\s+[A-Z]', 1), '') AS INTEGER) AS shift FROM @catalog_pages)
SELECT doc_id, coalesce(arg_min(shift, page_num) FILTER (WHERE shift <> 0), 0) AS page_offset FROM p GROUP BY doc_id""")
def page_offsets(t):
    return C.page_offsets(t.catalog_pages)


SELECTED_SQL = "WITH " + TOC_SQL + """, n AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS total FROM @catalog_pages GROUP BY 1),
h AS (SELECT p.doc_id, t.target_code, p.page_num FROM @catalog_pages p JOIN @catalog_targets t ON t.doc_id = p.doc_id
  WHERE contains(upper(regexp_replace(p.text, '\\s+', '', 'g')), upper(replace(t.target_code, ' ', '')))),
dr AS (SELECT DISTINCT h.doc_id, h.target_code, p.page_num FROM h JOIN @catalog_pages p ON p.doc_id = h.doc_id AND p.page_num BETWEEN h.page_num - 2 AND h.page_num + 2),
l1 AS (SELECT t.*, regexp_extract(target_code, '\\b([A-Z]{2,6})\\s*([0-9]{3,4}[A-Z]?)\\b', 1) AS subject FROM @catalog_targets t WHERE NOT EXISTS (SELECT 1 FROM dr WHERE dr.doc_id = t.doc_id AND dr.target_code = t.target_code)),
po AS (SELECT doc_id, coalesce(arg_min(s, page_num) FILTER (WHERE s <> 0), 0) AS o FROM (SELECT doc_id, page_num, page_num - TRY_CAST(nullif(regexp_extract(text, '^\\s*(\\d{1,3})\\s+[A-Z]', 1), '') AS INTEGER) AS s FROM @catalog_pages) GROUP BY 1),
nx AS (SELECT doc_id, start_page, lead(start_page) OVER (PARTITION BY doc_id ORDER BY start_page, place) AS next_page, place FROM te),
n1 AS (SELECT * FROM nx QUALIFY row_number() OVER (PARTITION BY doc_id, start_page ORDER BY place) = 1),
tc AS (SELECT l1.doc_id, l1.target_code, ss.section, greatest(1, ss.start_page + o - 2) AS a, least(total, coalesce(next_page + o + 5, total) + o) AS b, total
  FROM l1 JOIN ss ON ss.doc_id = l1.doc_id AND ss.target_code = l1.target_code JOIN po ON po.doc_id = l1.doc_id JOIN n ON n.doc_id = l1.doc_id
  LEFT JOIN n1 ON n1.doc_id = l1.doc_id AND n1.start_page = ss.start_page),
t2 AS (SELECT doc_id, target_code, section, a, CASE WHEN b - a < 20 THEN least(total, a + 30) ELSE b END AS b FROM tc),
l2 AS (SELECT * FROM l1 WHERE NOT EXISTS (SELECT 1 FROM tc WHERE tc.doc_id = l1.doc_id AND tc.target_code = l1.target_code)),
ix AS (SELECT l2.doc_id, target_code, min(page_num) AS i FROM l2 JOIN @catalog_pages p ON p.doc_id = l2.doc_id WHERE subject <> '' AND length(text) > 200 AND contains(text, subject)
  AND regexp_matches(text, '[A-Z]\\s+[A-Z]\\s+[A-Z]') GROUP BY 1, 2),
l3 AS (SELECT * FROM l2 WHERE NOT EXISTS (SELECT 1 FROM ix WHERE ix.doc_id = l2.doc_id AND ix.target_code = l2.target_code))
SELECT doc_id, target_code, page_num, 'direct_text_search' AS strategy FROM dr
UNION ALL SELECT doc_id, target_code, CAST(unnest(range(a, b + 1)) AS INTEGER), 'toc_section:' || section FROM t2
UNION ALL SELECT ix.doc_id, target_code, CAST(unnest(range(greatest(1, i - 6), least(total, i + 49))) AS INTEGER), 'alphabetical_search' FROM ix JOIN n ON n.doc_id = ix.doc_id
UNION ALL SELECT l3.doc_id, target_code, page_num, 'fallback_full_scan' FROM l3 JOIN @catalog_pages p ON p.doc_id = l3.doc_id"""


@query("selected_pages", "T11 W8 J12 J15 W13", SELECTED_SQL)
def selected_pages(t):
    return C.select_pages(t.catalog_pages, t.catalog_targets)


LINES_SQL = """ln AS (SELECT doc_id, page_num, generate_subscripts(x, 1) AS line_no, unnest(x) AS line FROM (
  SELECT doc_id, page_num, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS x FROM @bulk_pages)),
cl AS (SELECT * FROM ln WHERE NOT starts_with(line, '2025-2026 Undergraduate Catalog') AND NOT regexp_matches(line, '^Page:\\s+\\d+\\s+\\|'))"""
BLOCKS_SQL = LINES_SQL + """,
hd AS (SELECT *, regexp_matches(line, '^[A-Z]{2,5}\\s+\\d{4}[A-Z]{0,2}\\s+-\\s+.+$') AS is_header FROM cl),
bl AS (SELECT *, sum(is_header::INT) OVER (PARTITION BY doc_id ORDER BY page_num, line_no) AS b FROM hd),
ps AS (SELECT *, row_number() OVER (PARTITION BY doc_id, b ORDER BY page_num, line_no) - 1 AS pos FROM bl WHERE b > 0),
cr AS (SELECT *, coalesce(nullif(regexp_extract(line, '(?i)^\\(([\\d.]+(?:\\s*-\\s*[\\d.]+)?)\\)\\s+Credit Hours$', 1), ''), nullif(regexp_extract(line, '(?i)^\\s*Credit\\s*Hours?\\s*:\\s*(.+?)\\s*$', 1), ''),
  nullif(regexp_extract(line, '(?i)^\\s*Credits?\\s*:\\s*(.+?)\\s*$', 1), ''), nullif(regexp_extract(line, '(?i)^\\s*(\\d+(?:\\.\\d+)?)\\s*(?:credit\\s*hours?|credits?|hours?)\\b.*$', 1), ''),
  nullif(regexp_extract(line, '(?i)^\\s*(\\d+)\\s*\\(\\s*\\d+\\s*\\)\\s*$', 1), ''), nullif(regexp_extract(line, '(?i)^\\s*(\\d+)\\s*-\\s*\\d+\\s*-\\s*\\d+\\s*$', 1), '')) AS credit FROM ps),
kk AS (SELECT doc_id, b, min(pos) FILTER (WHERE pos >= 1 AND credit IS NOT NULL) AS k FROM cr GROUP BY 1, 2),
bk AS (SELECT c.doc_id, c.b, any_value(k) AS k, max(line) FILTER (WHERE pos = 0) AS header, max(c.page_num) FILTER (WHERE pos = 0) AS header_page, max(line) FILTER (WHERE pos = k) AS credit_line,
  max(c.page_num) FILTER (WHERE pos = k) AS credit_page, max(credit) FILTER (WHERE pos = k) AS raw,
  trim(regexp_replace(coalesce(string_agg(line, ' ' ORDER BY pos) FILTER (WHERE pos > coalesce(k, 0)), ''), '\\s+', ' ', 'g')) AS description,
  coalesce(list_sort(list_distinct(list(c.page_num) FILTER (WHERE pos > coalesce(k, 0)))), [max(c.page_num) FILTER (WHERE pos = 0)]) AS desc_pages FROM cr c JOIN kk ON kk.doc_id = c.doc_id AND kk.b = c.b GROUP BY 1, 2),
co AS (SELECT *, regexp_extract(header, '^([A-Z]{2,5}\\s+\\d{4}[A-Z]{0,2})\\s+-', 1) AS course_code, regexp_extract(header, '^[A-Z]{2,5}\\s+\\d{4}[A-Z]{0,2}\\s+-\\s+(.+)$', 1) AS full_title, replace(raw, ' ', '') AS rr FROM bk)"""


@query("clean_lines", "F14", f"WITH {LINES_SQL} SELECT doc_id, page_num, line FROM cl")
def clean_lines(t):
    return C.clean_lines(t.bulk_pages).select("doc_id", "page_num", "line")


@query("parsed_courses", "T14 W12 W7 F7 F8", f"""WITH {BLOCKS_SQL} SELECT doc_id, header_page, course_code, rtrim(regexp_replace(full_title, '\\((NS)\\)\\s*$', '')) AS title,
  regexp_extract(full_title, '\\((NS)\\)\\s*$', 1) AS gened_codes_in_title, credit_line, description,
  CASE WHEN regexp_full_match(rr, '[\\d.]+(-[\\d.]+)?') THEN CAST(split_part(rr, '-', 1) AS DOUBLE) END AS credits_min,
  CASE WHEN regexp_full_match(rr, '[\\d.]+(-[\\d.]+)?') THEN CAST(CASE WHEN contains(rr, '-') THEN split_part(rr, '-', 2) ELSE rr END AS DOUBLE) END AS credits_max,
  regexp_replace(regexp_extract(description, '(Every semester\\.|Fall semester\\.|Spring semester\\.|On demand\\.)', 1), '\\.+$', '') AS term_offered,
  regexp_extract(description, 'General Education Category:\\s*(.+)', 1) AS gened_category_text,
  trim(regexp_extract(description, '(?i)Prerequisites:\\s*(.+?)(?:\\.\\s|$)', 1)) AS prerequisites, trim(regexp_extract(description, '(?i)Corequisites:\\s*(.+?)(?:\\.\\s|$)', 1)) AS corequisites,
  trim(regexp_extract(description, '(?i)Pre or Corequisites:\\s*(.+?)(?:\\.\\s|$)', 1)) AS pre_or_corequisites,
  concat_ws(',', CASE WHEN contains(description, 'Laboratory/studio course fee will be assessed') THEN 'lab_fee' END, CASE WHEN contains(description, 'Satisfactory/No Credit') THEN 's_nc' END,
    CASE WHEN contains(description, 'Only open to') THEN 'restriction' END) AS flags, array_to_string(list_sort(list_distinct(list_concat([header_page], desc_pages))), ',') AS source_pages FROM co""")
def parsed_courses(t):
    return flat(C.parsed_courses(t.bulk_pages)).select(
        "doc_id", "header_page", "course_code", "title", "gened_codes_in_title", "credit_line", "description", "credits_min", "credits_max",
        "term_offered", "gened_category_text", "prerequisites", "corequisites", "pre_or_corequisites", "flags", "source_pages")


CHUNK_ROWS = """SELECT 'header' AS chunk_type, doc_id, course_code, CAST(header_page AS VARCHAR) AS pg, header AS k, header AS chunk_text FROM co
  UNION ALL SELECT 'credits', doc_id, course_code, CAST(credit_page AS VARCHAR), credit_line, credit_line FROM co WHERE credit_line IS NOT NULL
  UNION ALL SELECT 'description', doc_id, course_code, array_to_string(desc_pages, ','), description, description FROM co"""


@query("course_chunks", "T15", f"""WITH {BLOCKS_SQL}, ck AS ({CHUNK_ROWS})
SELECT substr(sha256(concat_ws('||', doc_id, pg, course_code, chunk_type, k)), 1, 32) AS chunk_sha_id, course_code, doc_id, CAST(split_part(pg, ',', 1) AS INTEGER) AS page, chunk_type, chunk_text FROM ck""")
def course_chunks(t):
    return C.course_chunks(C.parsed_courses(t.bulk_pages))


@query("corpus_metrics", "A19", f"""WITH {BLOCKS_SQL}, ck AS ({CHUNK_ROWS}) SELECT count(DISTINCT doc_id) AS n_files, count(*) AS n_courses,
  count(*) FILTER (WHERE credit_line IS NULL OR NOT regexp_full_match(rr, '[\\d.]+(-[\\d.]+)?')) AS n_warnings, (SELECT count(*) FROM ck) AS n_chunks FROM co""")
def corpus_metrics(t):
    courses = C.parsed_courses(t.bulk_pages)
    return C.corpus_metrics(courses, C.course_chunks(courses))


@query("transcript_layouts", "T10", """WITH d AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY page_num) AS t FROM @transcript_pages GROUP BY 1)
SELECT doc_id, CASE WHEN contains(lower(t), 'course') AND contains(lower(t), 'grade') THEN 'tabular'
  WHEN len(regexp_extract_all(t, '(?i)(Fall|Spring|Summer|Winter)\\s+\\d{4}')) >= 2 THEN 'grouped_by_term'
  WHEN len(regexp_extract_all(t, '\\b([A-Z]{2,6})\\s*(\\d{3,4}[A-Z]?)\\b')) > 5 THEN 'linear' ELSE 'unknown' END AS layout FROM d""")
def transcript_layouts(t):
    return T.layout(t.transcript_pages)


# RE2 knows no look-around: the letters that may not stand beside a grade are matched and left out of the group.
TERM_SQL = r"""coalesce(CASE WHEN regexp_matches(line, '(?i)\b(Fall|Spring|Summer|Winter)\s+(\d{4})\b') THEN upper(left(regexp_extract(line, '(?i)\b(Fall|Spring|Summer|Winter)\s+(\d{4})\b'), 1)) || lower(substr(regexp_extract(line, '(?i)\b(Fall|Spring|Summer|Winter)\s+(\d{4})\b'), 2)) END,
  CASE upper(regexp_extract(line, '(?i)\b(FA|SP|SU|WI)(\d{2})\b', 1)) WHEN 'FA' THEN 'Fall' WHEN 'SP' THEN 'Spring' WHEN 'SU' THEN 'Summer' WHEN 'WI' THEN 'Winter' END || ' 20' || regexp_extract(line, '(?i)\b(FA|SP|SU|WI)(\d{2})\b', 2),
  CASE WHEN regexp_matches(line, '(?i)\b(\d{4})\s+(Fall|Spring|Summer|Winter)\b') THEN upper(left(regexp_extract(line, '(?i)\b(\d{4})\s+(Fall|Spring|Summer|Winter)\b', 2), 1)) || lower(substr(regexp_extract(line, '(?i)\b(\d{4})\s+(Fall|Spring|Summer|Winter)\b', 2), 2)) || ' ' || regexp_extract(line, '(?i)\b(\d{4})\s+(Fall|Spring|Summer|Winter)\b', 1) END,
  CASE WHEN regexp_matches(line, '\b(20\d{2})(0[1-9]|1[0-2])\b') THEN CASE WHEN regexp_extract(line, '\b(20\d{2})(0[1-9]|1[0-2])\b', 2) IN ('01', '02') THEN 'Spring' WHEN regexp_extract(line, '\b(20\d{2})(0[1-9]|1[0-2])\b', 2) IN ('05', '06', '07') THEN 'Summer' ELSE 'Fall' END
    || ' ' || regexp_extract(line, '\b(20\d{2})(0[1-9]|1[0-2])\b', 1) END)"""
GRADE_RE2 = "([A-DF][+-]|[A-DF]|CR|NC|P|NP|W|WP|WF|IP|AU)"
GRADE_OF = lambda c: f"nullif(regexp_extract({c}, '(?:^|[^A-Za-z]){GRADE_RE2}(?:[^A-Za-z]|$)', 1), '')"
LEAD_OF = lambda c: f"regexp_extract({c}, '(?s)^((?:.*?[^A-Za-z])??){GRADE_RE2}(?:[^A-Za-z]|$)', 1)"
TRANSCRIPT_SQL = r"""tx AS (SELECT doc_id, page_num, list_transform(string_split(text, chr(10)), lambda x: trim(x)) AS x FROM @transcript_pages),
ld AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY page_num) AS t FROM @transcript_pages GROUP BY 1),
lay AS (SELECT doc_id, contains(lower(t), 'course') AND contains(lower(t), 'grade') AS tab FROM ld),
l1 AS (SELECT tx.doc_id, page_num, tab, generate_subscripts(x, 1) AS line_no, unnest(x) AS line, unnest(list_append(x[2:], NULL)) AS nxt FROM
  (SELECT tx.doc_id, page_num, tab, CASE WHEN tab THEN x ELSE list_filter(x, lambda y: y <> '') END AS x FROM tx JOIN lay ON lay.doc_id = tx.doc_id) tx),
l2 AS (SELECT *, regexp_extract(line, '\b([A-Z]{2,6})\s*(\d{3,4}[A-Z]?)\b') AS ml, regexp_extract(line, '\b(\d{1,2})\.(\d{2,3}[A-Z]?)\b') AS md,
  regexp_matches(line, '^([A-Z]{2,6})\s*(\d{3,4}[A-Z]?)\b') AS hl, regexp_matches(line, '^(\d{1,2})\.(\d{2,3}[A-Z]?)\b') AS hd FROM l1),
l3 AS (SELECT *, CASE WHEN (hd AND NOT hl AND tab) OR (ml = '' AND md <> '') THEN md WHEN ml <> '' THEN ml END AS m FROM l2),
l4 AS (SELECT *, CASE WHEN contains(m, '.') THEN m WHEN m <> '' THEN regexp_extract(m, '^[A-Z]+') || ' ' || regexp_extract(m, '\d.*$') END AS course_code, substr(line, strpos(line, m) + length(m)) AS rest,
  """ + TERM_SQL + r""" AS tm, CASE WHEN regexp_matches(line, '(?i)(Fall|Spring|Summer|Winter)\s*$') THEN upper(left(regexp_extract(line, '(?i)(Fall|Spring|Summer|Winter)\s*$', 1), 1)) || lower(substr(regexp_extract(line, '(?i)(Fall|Spring|Summer|Winter)\s*$', 1), 2)) END AS send FROM l3),
t1 AS (SELECT *, CASE WHEN NOT hl THEN send END AS season, line = '' OR regexp_matches(line, '^\d{4}$') OR regexp_matches(line, '(?i)^(University|College|Institute)\s+\d{4}$') AS neutral FROM l4 WHERE tab),
t2 AS (SELECT *, CASE WHEN season IS NOT NULL THEN season WHEN neutral THEN NULL WHEN course_code IS NOT NULL THEN '' WHEN regexp_matches(line, '(?i)\b(University|College|Institute)\b') THEN NULL ELSE '' END AS ev FROM t1),
t3 AS (SELECT *, nullif(last_value(ev IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_num, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS pend FROM t2),
t4 AS (SELECT *, upper(""" + GRADE_OF("rest") + r""") AS grade, """ + LEAD_OF("rest") + r""" AS pre0, coalesce(nullif(regexp_extract(nxt, '^(\d{4})$', 1), ''), nullif(regexp_extract(nxt, '(?i)(?:University|College|Institute)\s+(\d{4})\s*$', 1), '')) AS yr
  FROM t3 WHERE season IS NULL AND NOT neutral AND course_code IS NOT NULL),
t5 AS (SELECT *, CASE WHEN pre0 = '' THEN rest ELSE pre0 END AS pre FROM t4 WHERE grade IS NOT NULL),
t6 AS (SELECT *, regexp_extract_all(pre, '\b\d+\b') AS nums FROM t5),
t7 AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(trim(CASE WHEN len(nums) > 0 THEN regexp_extract(pre, '(?s)^(.*)\b\d+\b', 1) ELSE pre END), '^[\s\|\-:]+', ''), '[\s\|\-:]+$', ''), '\s+\d+\s*$', '') AS ti FROM t6),
tabular AS (SELECT doc_id, page_num, CAST(line_no AS INTEGER) AS line_no, course_code, grade, coalesce(tm, pend || ' ' || yr, send || ' ' || nullif(regexp_extract(nxt, '^(\d{4})$', 1), ''), 'Unknown Term') AS term_taken,
  nums[-1] AS credits, CASE WHEN length(ti) > 3 AND length(ti) < 100 THEN ti END AS title FROM t7)"""
FREE_SQL = TRANSCRIPT_SQL + r""",
f1 AS (SELECT *, CASE WHEN tm IS NOT NULL AND (length(line) < 50 OR lower(line) LIKE 'term%' OR lower(line) LIKE 'semester%') THEN tm END AS hdr FROM l4 WHERE NOT tab),
f2 AS (SELECT *, last_value(hdr IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_num, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cur,
  first_value(tm IGNORE NULLS) OVER (PARTITION BY doc_id, page_num ORDER BY line_no ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS near FROM f1),
f3 AS (SELECT *, """ + GRADE_OF("rest") + r""" AS g1, """ + GRADE_OF("coalesce(nxt, '')") + r""" AS g2 FROM f2 WHERE course_code IS NOT NULL),
f4 AS (SELECT *, length(CASE WHEN g1 IS NOT NULL THEN """ + LEAD_OF("rest") + r""" ELSE """ + LEAD_OF("nxt") + r""" END) AS off, length(line) - length(rest) AS bg FROM f3 WHERE coalesce(g1, g2) IS NOT NULL),
f5 AS (SELECT *, regexp_replace(regexp_replace(trim(substr(line, bg + 1, greatest(0, off - bg))), '^\s*[-:]\s*', ''), '\s+\d+(?:\.\d+)?\s*$', '') AS ti FROM f4),
every AS (SELECT * FROM tabular UNION ALL SELECT doc_id, page_num, CAST(line_no AS INTEGER), course_code, upper(coalesce(g1, g2)), coalesce(tm, send || ' ' || nullif(regexp_extract(nxt, '^(\d{4})\b', 1), ''), cur, near, 'Unknown Term'),
  nullif(regexp_extract(line, '(?i)(\d+(?:\.\d+)?)\s*(?:cr|credits?|hrs?|hours?|units?)', 1), ''), CASE WHEN length(ti) > 3 AND length(ti) < 100 THEN trim(ti) END FROM f5)"""
CODES_SQL = """codes AS (SELECT request_id, 'CHEM ' || (student_id + 1000) AS code FROM @requests UNION SELECT request_id, 'MATH 1530' FROM @requests WHERE request_id % 2 = 0)"""


@query("tabular_courses", "T8 W5 W6", f"WITH {TRANSCRIPT_SQL} SELECT * FROM tabular")
def tabular_courses(t):
    kinds = T.layout(t.transcript_pages).filter("layout = 'tabular'").select("doc_id")
    return T.tabular_courses(t.transcript_pages.join(kinds, "doc_id", "left_semi"))


@query("transcript_courses", "T9 W3 W4 W5 F4", f"WITH {FREE_SQL} SELECT * FROM every")
def transcript_courses(t):
    return T.transcript_courses(t.transcript_pages)


def codes(t):
    return t.requests.select("request_id", F.concat(F.lit("chem"), (F.col("student_id") + 1000).cast("string")).alias("code")).unionByName(
        t.requests.filter("request_id % 2 = 0").select("request_id", F.lit("MATH  1530").alias("code")))


def courses(t):
    return T.transcript_courses(t.transcript_pages).withColumn("request_id", F.col("doc_id"))


@query("matched_courses", "J5 F2", f"""WITH {FREE_SQL}, {CODES_SQL} SELECT e.doc_id AS request_id, course_code, grade, term_taken FROM every e
WHERE EXISTS (SELECT 1 FROM codes c WHERE c.request_id = e.doc_id AND c.code = e.course_code)""")
def matched_courses(t):
    return T.matched(courses(t), codes(t)).select("request_id", "course_code", "grade", "term_taken")


@query("transcript_results", "A21", f"""WITH {FREE_SQL}, {CODES_SQL}, r AS (SELECT request_id, bool_and(length(trim(text)) < 50) AS short FROM @transcript_pages GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM codes c WHERE c.request_id = every.doc_id AND c.code = every.course_code)) AS m FROM every GROUP BY 1),
x AS (SELECT r.request_id, short, CASE WHEN short THEN 0 ELSE coalesce(n, 0) END AS n, CASE WHEN short THEN 0 WHEN r.request_id IN (SELECT request_id FROM codes) THEN coalesce(m, 0) ELSE coalesce(n, 0) END AS m FROM r LEFT JOIN n ON n.doc_id = r.request_id)
SELECT request_id, n AS total_extracted, m AS matched_count, m AS saved_count, CASE WHEN short THEN 'failed' WHEN n = 0 OR m = 0 THEN 'partial' ELSE 'success' END AS status FROM x""")
def transcript_results(t):
    return T.results(t.transcript_pages, courses(t), codes(t))


@query("page_parse_checks", "A17", """WITH p AS (SELECT doc_id, sum(length(text)) >= 100 AS ok, bool_and(length(text) < 50) AS ocr FROM @catalog_pages GROUP BY 1)
SELECT doc_id % 5 AS case_no, count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT ok) AS failed, count(*) FILTER (WHERE ocr) AS needs_ocr FROM p GROUP BY 1""")
def page_parse_checks(t):
    return Q.parse_checks(t.catalog_pages.withColumn("case_no", F.col("doc_id") % 5), "case_no")
