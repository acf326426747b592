"""Document-risk queries over page texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill.functions import scan as S
from casemill.operators import risk as R
from casemill.plans.registry import query

YEAR = 2024

# ---- DuckDB texts ----------------------------------------------------------
GLYPHS = ("".join(S.HOMOGLYPHS), "".join(S.HOMOGLYPHS.values()))
ZERO_WIDTH_SQL = "[\\x{200B}\\x{200C}\\x{200D}\\x{200E}\\x{200F}\\x{FEFF}\\x{00AD}\\x{034F}\\x{2060}\\x{2061}\\x{2062}\\x{2063}]"


def scan_sql(c: str) -> str:
    """Scan form without the long-run rule, which RE2 cannot express; the detectors below do not depend on it."""
    return (f"regexp_replace(translate(regexp_replace({c}, '{ZERO_WIDTH_SQL}', '', 'g'), '{GLYPHS[0]}', '{GLYPHS[1]}'), "
            f"'\\s+', ' ', 'g')")


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def patterns_sql() -> str:
    rows = [(i, sev, S.POINTS[sev], name, p) for i, (sev, name, p) in enumerate(
        [("high", n, p) for n, p in S.HIGH_PATTERNS] + [("medium", n, p) for n, p in S.MEDIUM_PATTERNS])]
    # RE2 counts letters with accents as no word characters; no pattern below meets such a letter at a word edge.
    return ", ".join(f"({i}, '{sev}', {pts}, '{name}', {q('(?i)' + p)})" for i, sev, pts, name, p in rows)


WORDS = "'[\\p{L}\\p{N}\\p{M}_]+'"
KEYS = ", ".join(f"('{k}', '{k[0]}' || '{''.join(sorted(k[1:-1]))}' || '{k[-1]}')" for k in S.FUZZY_KEYWORDS)
def findings_sql(source: str) -> str:
    return f"""sc AS MATERIALIZED (SELECT doc_id, page_num, text, {scan_sql('text')} AS s FROM {source}),
pats(i, severity, points, match, pat) AS (VALUES {patterns_sql()}),
rx AS (SELECT doc_id, page_num, 0 AS rank, i AS ord, 'regex' AS detector, severity, points, match FROM sc JOIN pats ON regexp_matches(s, pat)),
wd AS (SELECT doc_id, page_num, unnest(regexp_extract_all(lower(s), {WORDS})) AS w, generate_subscripts(regexp_extract_all(lower(s), {WORDS}), 1) AS pos FROM sc),
tr AS (SELECT doc_id, page_num, 1 AS rank, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY w) AS ord, 'trigger_word' AS detector, 'low' AS severity, 1 AS points, w AS match
  FROM (SELECT DISTINCT doc_id, page_num, w FROM wd WHERE w IN ({', '.join(q(w) for w in S.TRIGGER_WORDS)}))),
keys(k, mk) AS (VALUES {KEYS}),
ty AS (SELECT doc_id, page_num, 2 AS rank, pos AS ord, 'typoglycemia' AS detector, 'low' AS severity, 2 AS points, w || '~' || k AS match FROM wd JOIN keys
  ON length(w) = length(k) AND length(w) >= 4 AND w <> k AND w[1] = k[1] AND w[-1] = k[-1]
  AND array_to_string(list_sort(string_split(w[2:-2], '')), '') = array_to_string(list_sort(string_split(k[2:-2], '')), '')),
b64 AS (SELECT doc_id, page_num, generate_subscripts(x, 1) AS ord, regexp_replace(unnest(x), '=+$', '') AS run
  FROM (SELECT doc_id, page_num, regexp_extract_all(text, '[A-Za-z0-9+/]{{20,}}={{0,2}}') AS x FROM sc)),
told AS (SELECT doc_id, page_num, ord, TRY(decode(from_base64(rpad(run, CAST(ceil(length(run) / 4.0) * 4 AS INTEGER), '=')))) AS said FROM b64 WHERE length(run) % 4 <> 1),
spoken AS (SELECT doc_id, page_num, ord, {scan_sql('said')} AS said FROM told WHERE length(said) >= 10 AND NOT regexp_matches(said, '[\\p{{C}}\\p{{Zl}}\\p{{Zp}}]')),
bs AS (SELECT doc_id, page_num, 3 AS rank, ord, 'base64_decode' AS detector, 'high' AS severity, 6 AS points, 'base64_encoded_injection' AS match FROM spoken
  WHERE EXISTS (SELECT 1 FROM pats WHERE regexp_matches(said, pat)) OR list_has_any(regexp_extract_all(lower(said), {WORDS}), [{', '.join(q(w) for w in S.TRIGGER_WORDS)}])),
sig AS (SELECT * FROM rx UNION ALL SELECT * FROM tr UNION ALL SELECT * FROM ty UNION ALL SELECT * FROM bs),
fnd AS (SELECT * FROM sig UNION ALL SELECT doc_id, page_num, 4, 0, 'bonus', 'medium', 2, 'multi_signal_bonus' FROM sig GROUP BY doc_id, page_num HAVING count(*) >= 2)"""


FINDINGS_SQL = findings_sql("@scan_pages")
# ----------------------------------------------------------------------------


@query("scan_findings", "X1 X2 X3 X4 X5 F18 F19 F20 F21", f"""WITH {FINDINGS_SQL}
SELECT doc_id, CAST(page_num AS INTEGER) AS page_num, detector, severity, CAST(points AS INTEGER) AS points, match, count(*) AS n FROM fnd GROUP BY ALL""")
def scan_findings(t):
    rows = R.reported(R.findings(t.scan_pages), limit=None)
    return rows.groupBy("doc_id", "page_num", "detector", "severity", "points", "match").agg(F.count(F.lit(1)).alias("n"))


@query("scan_verdicts", "A15 X6", f"""WITH {FINDINGS_SQL}
SELECT d.doc_id, CAST(coalesce(sum(points), 0) AS BIGINT) AS total_score, count(points) AS n_findings,
  CASE WHEN coalesce(sum(points), 0) >= 7 THEN 'reject' ELSE 'allow' END AS verdict
FROM (SELECT DISTINCT doc_id FROM @scan_pages) d LEFT JOIN fnd ON fnd.doc_id = d.doc_id GROUP BY d.doc_id""")
def scan_verdicts(t):
    return R.verdicts(R.findings(t.scan_pages))


@query("first_findings", "W11", f"""WITH {FINDINGS_SQL}
SELECT doc_id, CAST(n AS INTEGER) AS n, CAST(page_num AS INTEGER) AS page_num, detector, match FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_num, rank, ord) AS n FROM fnd) WHERE n <= 5""")
def first_findings(t):
    return R.reported(R.findings(t.scan_pages), limit=5).select("doc_id", "n", "page_num", "detector", "match")


@query("quarantined_pages", "X6", f"""WITH {FINDINGS_SQL}, v AS (SELECT doc_id FROM fnd GROUP BY doc_id HAVING sum(points) >= 7)
SELECT doc_id, CAST(page_num AS INTEGER) AS page_num, doc_id IN (SELECT doc_id FROM v) AS quarantined FROM @scan_pages""")
def quarantined_pages(t):
    ok, held = R.split_by_verdict(t.scan_pages.select("doc_id", "page_num"), R.verdicts(R.findings(t.scan_pages)))
    return ok.withColumn("quarantined", F.lit(False)).unionByName(held.withColumn("quarantined", F.lit(True)))


AUTHOR_SQL = "CASE event_id % 50 WHEN 0 THEN 'jailbreak' WHEN 1 THEN 'ignore all previous instructions' WHEN 2 THEN 'the committee score' END"


@query("metadata_findings", "X7", f"""WITH meta AS (SELECT event_id AS doc_id, 0 AS page_num, concat_ws(' ', props, {AUTHOR_SQL}) AS text FROM @events), {findings_sql("meta")}
SELECT m.doc_id, m.page_num, CAST(coalesce(sum(points), 0) AS INTEGER) AS points FROM meta m LEFT JOIN fnd ON fnd.doc_id = m.doc_id GROUP BY ALL""")
def metadata_findings(t):
    # Title and author of an upload; some authors write an instruction or words of one.
    author = F.expr(AUTHOR_SQL)
    rows = t.events.select(F.col("event_id").alias("doc_id"), F.col("props").alias("title"), author.alias("author"))
    return R.metadata_findings(rows, ["title", "author"]).select("doc_id", "page_num", R.page_points().alias("points"))


@query("file_type_checks", "X8 F23", """SELECT doc_id, ext AS extension, seen AS detected_type, coalesce(ok = seen, false) AS is_valid FROM (
  SELECT doc_id, seen, CASE WHEN doc_id % 5 = 2 THEN '.docx' WHEN doc_id % 5 = 3 THEN '.png' ELSE '.pdf' END AS ext,
    CASE WHEN doc_id % 5 = 2 THEN 'zip' WHEN doc_id % 5 = 3 THEN 'png' ELSE 'pdf' END AS ok FROM (
  SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'zip' WHEN 2 THEN 'gif' WHEN 3 THEN 'png' WHEN 4 THEN 'postscript' ELSE 'unknown' END AS seen FROM @documents))""")
def file_type_checks(t):
    heads = ("%PDF-1.7", "PK\x03\x04", "GIF89a", None, "%!PS-Adobe", "")
    head = F.lit("").cast("binary")
    for i, h in enumerate(heads):
        value = F.unhex(F.lit("89504E470D0A1A0A")) if h is None else F.lit(h).cast("binary")
        head = F.when(F.col("doc_id") % 6 == i, value).otherwise(head)
    content = F.concat(head, F.when(F.col("doc_id") % 6 == 5, F.lit("x")).otherwise("").cast("binary"), F.col("text").cast("binary"))
    checked = t.case_documents.select("doc_id", S.type_check(F.col("filename"), content).alias("c"))
    return checked.select("doc_id", "c.extension", "c.detected_type", "c.is_valid")


DOC_TEXT = "d AS (SELECT doc_id, string_agg(text, ' ' ORDER BY page_num) AS full_text FROM @syllabus_pages GROUP BY doc_id)"
FIELD_ROWS = ", ".join(f"({i}, '{n}', {q('(?i)' + p.replace(chr(92) + '—', '—'))})" for i, (n, p) in enumerate(R.REQUIRED_FIELDS))


@query("document_completeness", "X9", f"""WITH {DOC_TEXT}, f(i, name, pat) AS (VALUES {FIELD_ROWS}),
m AS (SELECT doc_id, i, name, regexp_matches(lower(regexp_replace(full_text, '\\s+', ' ', 'g')), pat) AS present FROM d, f)
SELECT doc_id, round(count(*) FILTER (WHERE present) / 8, 3) AS score, count(*) FILTER (WHERE present) / 8 >= 0.75 AS is_complete,
  coalesce(string_agg(name, ',' ORDER BY i) FILTER (WHERE NOT present), '') AS missing_fields FROM m GROUP BY doc_id""")
def document_completeness(t):
    return R.completeness(t.syllabus_pages).withColumn("missing_fields", F.array_join("missing_fields", ","))


@query("document_recency", "X10 F5", f"""WITH {DOC_TEXT}, y AS (SELECT doc_id, list_max(list_transform(regexp_extract_all(full_text, '\\b(19[89]\\d|20[0-3]\\d)\\b'), lambda x: x::INTEGER)) AS most_recent_year FROM d)
SELECT doc_id, most_recent_year, coalesce(most_recent_year < 2014, false) AS is_expired FROM y""")
def document_recency(t):
    return R.recency(t.syllabus_pages, YEAR)


PAGE_DOCS = "d AS (SELECT doc_id, string_agg(text, ' ' ORDER BY page_num) AS full_text FROM @doc_pages GROUP BY doc_id)"
SENTENCES = """s AS (SELECT doc_id, lower(trim(regexp_replace(x, '^[\\s\\x{A0}]+|[\\s\\x{A0}]+$', '', 'g'))) AS s FROM (SELECT doc_id, unnest(regexp_split_to_array(full_text, '[.!?\\n]')) AS x FROM d)),
reps AS (SELECT doc_id, s, count(*) AS n FROM s WHERE length(s) > 20 GROUP BY doc_id, s HAVING count(*) >= 3)"""


@query("repeated_sentences", "A12", f"WITH {PAGE_DOCS}, {SENTENCES} SELECT doc_id, substr(s, 1, 60) AS sentence, n FROM reps")
def repeated_sentences(t):
    return R.repeated_sentences(t.doc_pages)


TALLIES = ", ".join(f"{{'i': {i}, 'k': {q(k)}, 'n': len(list_filter(ws, lambda x: x = {q(k)}))}}" for i, k in enumerate([k for k in R.KEYWORDS if " " not in k]))
SINGLE = ", ".join(q(k) for k in R.KEYWORDS if " " not in k)
MULTI = " + ".join(f"len(regexp_extract_all(full_text, '(?i){k}'))" for k in R.KEYWORDS if " " in k)
FREQUENT = " + ".join(f"(len(regexp_extract_all(full_text, '(?i){k}')) >= 3)::INT" for k in R.KEYWORDS if " " in k)


@query("keyword_density", "A12 L3 X11", f"""WITH d AS (SELECT doc_id, string_agg(text || CASE WHEN doc_id % 3 = 0 THEN ' approved Genetics, equivalent; genetics learning' ELSE ' end' END,
    ' outcome ' ORDER BY page_num) AS full_text FROM @doc_pages GROUP BY doc_id), {SENTENCES},
w AS (SELECT doc_id, regexp_extract_all(lower(full_text), {WORDS}) AS ws, {MULTI} AS n_multi, {FREQUENT} AS n_frequent FROM d),
c AS (SELECT doc_id, len(ws) AS n_words, n_frequent, len(list_filter(ws, lambda x: x IN ({SINGLE}))) + n_multi AS n_flagged FROM w),
r AS (SELECT doc_id, count(*) AS n FROM reps GROUP BY doc_id),
o AS (SELECT doc_id, unnest([{TALLIES}], recursive := true) FROM w),
tops AS (SELECT doc_id, list(k || ' x' || n ORDER BY n DESC, i)[1:10] AS tops FROM o WHERE n > 0 GROUP BY doc_id)
SELECT c.doc_id, coalesce(array_to_string(tops.tops, ', '), '') AS top_offenders, CAST(n_words AS BIGINT) AS n_words, CAST(n_flagged AS BIGINT) AS n_flagged, round(n_flagged / greatest(n_words, 1), 4) AS density, CAST(n_frequent + coalesce(r.n, 0) AS BIGINT) AS n_repeated,
  n_flagged / greatest(n_words, 1) >= 0.04 OR n_frequent + coalesce(r.n, 0) > 0 AS is_suspicious FROM c LEFT JOIN r ON r.doc_id = c.doc_id LEFT JOIN tops ON tops.doc_id = c.doc_id""")
def keyword_density(t):
    # Pages of every third document end in "learning" and the next begins with "outcome": a phrase across the page end.
    first = F.when(F.col("page_num") > 1, F.lit("outcome ")).otherwise("")
    tail = F.when(F.col("doc_id") % 3 == 0, " approved Genetics, equivalent; genetics learning").otherwise(" end")
    pages = t.doc_pages.withColumn("text", F.concat(first, "text", tail))
    return R.keyword_density(pages).withColumn("top_offenders", F.array_join("top_offenders", ", "))


@query("field_consistency", "X12", """WITH d AS (SELECT doc_id, string_agg(text, ' ' ORDER BY page_num) AS full_text FROM @syllabus_pages GROUP BY doc_id),
v AS (SELECT doc_id, 'credit' AS kind, unnest(list_transform(regexp_extract_all(full_text, '(?i)(\\d+(?:\\.\\d+)?)\\s*(?:semester\\s+)?credit(?:\\s+hour)?s?', 1), lambda x: x::DOUBLE)) AS v, 1.0 AS lo, 6.0 AS hi FROM d
  UNION ALL SELECT doc_id, 'contact', unnest(list_transform(regexp_extract_all(full_text, '(?i)(\\d+(?:\\.\\d+)?)\\s*contact\\s+hours?', 1), lambda x: x::DOUBLE)), 1.0, 10.0 FROM d)
SELECT doc_id, kind, count(DISTINCT v) AS n_values, min(v) AS low, max(v) AS high, count(*) FILTER (WHERE v NOT BETWEEN lo AND hi) AS n_out_of_range,
  count(*) FILTER (WHERE v NOT BETWEEN lo AND hi) + (count(DISTINCT v) > 1)::BIGINT AS n_issues FROM v GROUP BY doc_id, kind""")
def field_consistency(t):
    return R.field_consistency(t.syllabus_pages)


@query("document_contradictions", "X13 J10", """WITH d AS (SELECT doc_id, request_id, string_agg(text, ' ' ORDER BY page_num) AS t FROM @syllabus_pages GROUP BY doc_id, request_id),
s AS (SELECT request_id, doc_id, 'credits' AS kind, list_distinct(list_transform(regexp_extract_all(t, '(?i)(\\d+(?:\\.\\d+)?)\\s*(?:semester\\s+)?credit(?:\\s+hour)?s?', 1), lambda x: CAST(x::DOUBLE AS VARCHAR))) AS vs FROM d
  UNION ALL SELECT request_id, doc_id, 'contact_hours', list_distinct(list_transform(regexp_extract_all(t, '(?i)(\\d+(?:\\.\\d+)?)\\s*contact\\s+hours?', 1), lambda x: CAST(x::DOUBLE AS VARCHAR))) FROM d
  UNION ALL SELECT request_id, doc_id, 'years', list_distinct(regexp_extract_all(t, '\\b(19[89]\\d|20[0-3]\\d)\\b')) FROM d
  UNION ALL SELECT request_id, doc_id, 'course_codes', list_distinct(regexp_extract_all(t, '\\b([A-Z]{2,6})\\s*(\\d{3,4})\\b')) FROM d),
k AS (SELECT * FROM s WHERE len(vs) > 0), n AS (SELECT request_id, kind, count(*) AS n_docs FROM k GROUP BY 1, 2),
p AS (SELECT a.request_id, a.kind, count(*) AS n_pairs, count(*) FILTER (WHERE len(list_intersect(a.vs, b.vs)) = 0) AS n_conflicts
  FROM k a JOIN k b ON a.request_id = b.request_id AND a.kind = b.kind AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT n.request_id, n.kind, n_docs, coalesce(n_pairs, 0) AS n_pairs, coalesce(n_conflicts, 0) AS n_conflicts FROM n LEFT JOIN p ON p.request_id = n.request_id AND p.kind = n.kind""")
def document_contradictions(t):
    return R.contradictions(R.document_values(t.syllabus_pages))


@query("text_coverage", "A13 A14", """SELECT doc_id, count(*) AS n_pages, avg((length(text) < 40)::INT) >= 0.8 AS image_only, bool_and(length(text) < 50) AS all_short,
  avg((length(text) < 50)::INT) > 0.5 AS mostly_short FROM @syllabus_pages GROUP BY doc_id""")
def text_coverage(t):
    return R.text_coverage(t.syllabus_pages)


def runs_sql(text: str) -> str:
    """Runs of four and more of one character cut to one, character by character: RE2 has no back-references."""
    for c in [chr(i) for i in range(0x21, 0x7F)] + list("äöüßéèêçñóíáúàâîôûÄÖÜÉÈÇÑÓÍ"):
        one = c if c.isalnum() else "\\" + c
        text = f"regexp_replace({text}, {q(f'{one}{{4,}}')}, {q(c * 2 if c == chr(92) else c)}, 'g')"
    return text


FORM_TEXT = "text || CASE doc_id % 4 WHEN 0 THEN ' sooooo yesssss!!!!!! ------ 77777 ' WHEN 1 THEN ' \uff21\uff22\uff23 \ufb01ne \u2460 ' ELSE '' END"


# NFKC is pinned by the characters planted here: full-width letters, a ligature and a circled digit.
@query("scan_forms", "F18 F19", f"""WITH f AS (SELECT doc_id, page_num, {runs_sql(scan_sql("translate(replace(" + FORM_TEXT + ", chr(64257), 'fi'), chr(65313) || chr(65314) || chr(65315) || chr(9312), 'ABC1')"))} AS form FROM @scan_pages)
SELECT doc_id, page_num, CAST(length(form) AS INTEGER) AS n_chars, md5(form) AS digest FROM f""")
def scan_forms(t):
    form = S.scan_form(F.expr(FORM_TEXT))
    return t.scan_pages.select("doc_id", "page_num", F.length(form).alias("n_chars"), F.md5(form).alias("digest"))
