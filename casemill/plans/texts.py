"""Line, chunk, scalar-function, manifest and prompt queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill.functions import text as X
from casemill.operators import chunks as K
from casemill.operators import replies as P
from casemill.operators import syllabus as S
from casemill.operators.decision import Policy
from casemill.plans import decisions as Q
from casemill.plans.cases import links
from casemill.plans.decisions import facts
from casemill.plans.registry import query


def chunked(t):
    """Chunks of the driver documents' pages under one run id per document."""
    rows = K.chunk_pages(t.doc_pages.withColumn("extraction_run_id", F.col("doc_id") % 7))
    return rows.withColumn("chunk_id", K.chunk_id())


CHUNKS_SQL = """win AS (SELECT doc_id, doc_id % 7 AS run, page_num, request_id, i AS s, least(i + 900, length(text)) AS e, substr(text, i + 1, 900) AS full_text
  FROM @doc_pages, range(0, (SELECT max(length(text)) FROM @doc_pages) , 900) r(i) WHERE i < length(text))"""


@query("page_chunks", "T1 T2 F16", f"""WITH {CHUNKS_SQL} SELECT doc_id, page_num, CAST(s AS INTEGER) AS span_start, CAST(e AS INTEGER) AS span_end,
  substr(full_text, 1, 200) AS snippet_text, sha256(concat_ws('|', doc_id, run, page_num, s, e, full_text)) AS chunk_id FROM win""")
def page_chunks(t):
    return chunked(t).select("doc_id", "page_num", "span_start", "span_end", "snippet_text", "chunk_id")


@query("packed_chunks", "T1", r"""WITH RECURSIVE t AS (SELECT doc_id, page_num, replace(text, chr(10), chr(10) || chr(10)) AS text FROM @doc_pages WHERE coalesce(text, '') <> ''),
ps AS (SELECT doc_id, page_num, text, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM t),
p AS (SELECT doc_id, page_num, generate_subscripts(l, 1) AS i, unnest(l) AS para FROM ps WHERE len(l) > 1),
q AS MATERIALIZED (SELECT *, length(para) AS n, coalesce(sum(length(para) + 2) OVER (PARTITION BY doc_id, page_num ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM p),
r AS (SELECT doc_id, page_num, i, n AS size, 1 AS c FROM q WHERE i = 1
  UNION ALL SELECT q.doc_id, q.page_num, q.i, CASE WHEN r.size + q.n + 2 <= 900 THEN r.size + q.n + 2 ELSE q.n END, CASE WHEN r.size + q.n + 2 <= 900 THEN r.c ELSE r.c + 1 END
  FROM r JOIN q ON q.doc_id = r.doc_id AND q.page_num = r.page_num AND q.i = r.i + 1),
k AS (SELECT r.doc_id, r.page_num, c, min(place) AS a, string_agg(para, chr(10) || chr(10) ORDER BY r.i) AS body FROM r JOIN q ON q.doc_id = r.doc_id AND q.page_num = r.page_num AND q.i = r.i GROUP BY 1, 2, 3)
SELECT doc_id, page_num, CAST(a AS INTEGER) AS span_start, CAST(a + length(body) AS INTEGER) AS span_end, md5(body) AS digest FROM k
UNION ALL SELECT doc_id, page_num, CAST(a AS INTEGER), CAST(least(a + 900, length(text)) AS INTEGER), md5(substr(text, a + 1, 900)) FROM (
  SELECT doc_id, page_num, text, unnest(range(0, length(text), 900)) AS a FROM ps WHERE len(l) <= 1)""")
def packed_chunks(t):
    # Lines become paragraphs: packed chunks of the same texts.
    pages = t.doc_pages.withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return K.chunk_pages(pages).select("doc_id", "page_num", "span_start", "span_end", F.md5("full_text").alias("digest"))


@query("cited_documents", "T2 A11", f"""WITH {CHUNKS_SQL}, per AS (SELECT doc_id, count(*) AS n FROM win GROUP BY 1),
docs AS (SELECT doc_id, filename FROM @case_documents), pg AS (SELECT doc_id, count(*) AS n FROM @doc_pages GROUP BY 1),
ev AS (SELECT request_id AS doc_id, count(*) AS n FROM @facts GROUP BY 1)
SELECT d.doc_id, filename, coalesce(pg.n, 0) AS page_count, coalesce(per.n, 1) AS chunks_written, coalesce(ev.n, 0) AS evidence_written,
  CASE WHEN per.n IS NULL THEN '[No extractable text from ' || filename || ']' ELSE '' END AS placeholder
FROM docs d LEFT JOIN per ON per.doc_id = d.doc_id LEFT JOIN pg ON pg.doc_id = d.doc_id LEFT JOIN ev ON ev.doc_id = d.doc_id""")
def cited_documents(t):
    docs = t.case_documents.select("doc_id", "filename")
    chunks = K.chunk_pages(t.doc_pages.drop("request_id"))
    every = K.with_placeholders(docs, chunks)
    placeholder = every.filter("page_num = 0").select("doc_id", F.col("full_text").alias("placeholder"))
    out = K.document_manifest(docs, t.doc_pages, every, t.facts.withColumnRenamed("request_id", "doc_id"))
    return out.join(placeholder, "doc_id", "left").select("doc_id", "filename", "page_count", "chunks_written", "evidence_written",
                                                          F.coalesce("placeholder", F.lit("")).alias("placeholder"))


@query("fact_citations", "T13", """WITH f AS (SELECT doc_id, 'credits_or_units' AS fact_key, '4 Credit' AS v, ['credit', 'credits', 'hours', 'units', '4 credit'] AS keys FROM @syllabus_pages WHERE page_num = 1
  UNION ALL SELECT doc_id, 'description', repeat('x', 50), ['description', 'objective', 'about this course', 'overview'] FROM @syllabus_pages WHERE page_num = 1),
h AS (SELECT f.doc_id, fact_key, page_num FROM f JOIN @syllabus_pages p ON p.doc_id = f.doc_id AND len(list_filter(keys, lambda k: contains(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), k))) > 0),
a AS (SELECT * FROM h UNION ALL SELECT doc_id, fact_key, 1 FROM f WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = f.doc_id AND h.fact_key = f.fact_key))
SELECT a.doc_id, a.fact_key, CAST(a.page_num AS INTEGER) AS page_num FROM a JOIN @syllabus_pages p ON p.doc_id = a.doc_id AND p.page_num = a.page_num""")
def fact_citations(t):
    ids = t.syllabus_pages.filter("page_num = 1").select("doc_id")
    asked = ids.select("doc_id", F.lit("credits_or_units").alias("fact_key"), F.lit("4 Credit").alias("fact_value")).unionByName(
        ids.select("doc_id", F.lit("description").alias("fact_key"), F.lit("x" * 50).alias("fact_value")))
    chunks = t.syllabus_pages.select("doc_id", "page_num")
    return K.cite_facts(asked, t.syllabus_pages, chunks).select("doc_id", "fact_key", "page_num")


@query("token_counts", "F9", """SELECT token, count(*) AS n FROM (SELECT doc_id, unnest(list_distinct(list_transform(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'),
  lambda w: NOT list_contains(['a','an','the','and','or','of','in','on','for','to','with','by','from','at','as','is','are','be','been'], w)),
  lambda w: CASE WHEN length(w) > 3 AND w LIKE '%s' AND NOT (w LIKE '%ss' OR w LIKE '%us' OR w LIKE '%is') THEN left(w, length(w) - 1) ELSE w END))) AS token FROM @documents) GROUP BY token""")
def token_counts(t):
    return t.documents.select(F.explode(X.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("squeezed_texts", "F13 F1", """SELECT doc_id, md5(trim(regexp_replace(text, '[\\s\\x{85}\\x{A0}\\x{2028}\\x{2029}\\x{3000}\\x{2000}-\\x{200A}\\x{202F}]+', ' ', 'g'))) AS digest FROM @documents""")
def squeezed_texts(t):
    return t.documents.select("doc_id", F.md5(X.squeeze(F.col("text"))).alias("digest"))


CODES_SQL = """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN ' cpsc' || o_custkey WHEN 1 THEN 'MATH  ' || (1000 + o_custkey) || 'a - X' WHEN 2 THEN '5.' || (100 + o_custkey % 900)
  WHEN 3 THEN 'Applied ' || o_custkey ELSE 'x_y--z1' END AS code, CASE o_orderkey % 6 WHEN 0 THEN 'FALL  2020' WHEN 1 THEN 'fa' || (10 + o_custkey % 90) WHEN 2 THEN '2023' || lpad(CAST(1 + o_custkey % 12 AS VARCHAR), 2, '0')
  WHEN 3 THEN '2024 spring' WHEN 4 THEN ' Unknown ' ELSE 'winter 1999' END AS term, CASE o_orderkey % 5 WHEN 0 THEN '3' WHEN 1 THEN '1 - 4' WHEN 2 THEN '' WHEN 3 THEN '1.5-x' ELSE '2.5' END AS credits FROM orders"""


@query("normalized_codes", "F2 F3 F4 F7", f"""WITH c AS ({CODES_SQL}), u AS (SELECT *, upper(trim(code)) AS uc, trim(term) AS tt, replace(trim(credits), ' ', '') AS cr FROM c)
SELECT o_orderkey, CASE WHEN regexp_matches(uc, '^\\d{{1,2}}\\.\\d{{2,3}}[A-Z]?') THEN regexp_extract(uc, '^\\d{{1,2}}\\.\\d{{2,3}}[A-Z]?')
    WHEN regexp_matches(uc, '^[A-Z]{{2,6}}\\s*\\d{{3,4}}[A-Z]?') THEN regexp_extract(uc, '^([A-Z]{{2,6}})\\s*(\\d{{3,4}}[A-Z]?)', 1) || ' ' || regexp_extract(uc, '^([A-Z]{{2,6}})\\s*(\\d{{3,4}}[A-Z]?)', 2) ELSE uc END AS transcript_code,
  CASE WHEN regexp_matches(uc, '^[A-Z]+[\\s\\-_]*\\d+[A-Z]?') THEN regexp_extract(uc, '^([A-Z]+)[\\s\\-_]*(\\d+[A-Z]?)', 1) || '-' || regexp_extract(uc, '^([A-Z]+)[\\s\\-_]*(\\d+[A-Z]?)', 2)
    ELSE regexp_replace(regexp_replace(regexp_replace(uc, '[\\s_]+', '-', 'g'), '([A-Z])(\\d)', '\\1-\\2', 'g'), '-+', '-', 'g') END AS target_code,
  CASE o_orderkey % 6 WHEN 0 THEN 'Fall  2020' WHEN 1 THEN 'Fall 20' || substr(tt, 3) WHEN 2 THEN CASE WHEN substr(tt, 5) IN ('01', '02') THEN 'Spring' WHEN substr(tt, 5) IN ('05', '06', '07') THEN 'Summer' ELSE 'Fall' END || ' 2023'
    WHEN 3 THEN 'Spring 2024' WHEN 4 THEN 'Unknown' ELSE 'Winter 1999' END AS term,
  CASE WHEN cr LIKE '%-x' THEN NULL ELSE TRY_CAST(split_part(cr, '-', 1) AS DOUBLE) END AS credits_min,
  CASE WHEN cr LIKE '%-x' THEN NULL WHEN contains(cr, '-') THEN TRY_CAST(split_part(cr, '-', 2) AS DOUBLE) ELSE TRY_CAST(cr AS DOUBLE) END AS credits_max FROM u""")
def normalized_codes(t):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda c: c.cast("string")
    code = (F.when(key % 5 == 0, F.concat(F.lit(" cpsc"), s(cust))).when(key % 5 == 1, F.concat(F.lit("MATH  "), s(cust + 1000), F.lit("a - X")))
            .when(key % 5 == 2, F.concat(F.lit("5."), s(cust % 900 + 100))).when(key % 5 == 3, F.concat(F.lit("Applied "), s(cust))).otherwise("x_y--z1"))
    term = (F.when(key % 6 == 0, "FALL  2020").when(key % 6 == 1, F.concat(F.lit("fa"), s(cust % 90 + 10)))
            .when(key % 6 == 2, F.concat(F.lit("2023"), F.lpad(s(cust % 12 + 1), 2, "0"))).when(key % 6 == 3, "2024 spring")
            .when(key % 6 == 4, " Unknown ").otherwise("winter 1999"))
    credits = F.when(key % 5 == 0, "3").when(key % 5 == 1, "1 - 4").when(key % 5 == 2, "").when(key % 5 == 3, "1.5-x").otherwise("2.5")
    return t.orders.select("o_orderkey", X.transcript_code(code).alias("transcript_code"), X.target_code(code).alias("target_code"),
                           X.term(term).alias("term"), X.credit_range(credits).alias("r")).select(
        "o_orderkey", "transcript_code", "target_code", "term", "r.credits_min", "r.credits_max")


@query("ranked_grades", "F6 F5", """SELECT evidence_id, upper(trim(fact_value)) AS grade, CAST(list_position(['A+','A','A-','B+','B','B-','C+','C','C-','D+','D','D-','F'],
  replace(upper(trim(fact_value)), ' ', '')) - 1 AS INTEGER) AS rank FROM @facts WHERE fact_key = 'grade' AND fact_value IS NOT NULL""")
def ranked_grades(t):
    return t.facts.filter("fact_key = 'grade' AND fact_value IS NOT NULL").select(
        "evidence_id", X.grade_text(F.col("fact_value")).alias("grade"), X.grade_rank(F.col("fact_value")).alias("rank"))


@query("distinct_items", "U4 F10", """WITH l AS (SELECT evidence_id, list_filter(list_transform(string_split(items_text || '| ' || items_text || '|x|x ', '|'), lambda x: trim(x)), lambda x: x <> '') AS l
FROM @facts WHERE items_text IS NOT NULL) SELECT evidence_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' / ') AS items FROM l""")
def distinct_items(t):
    # Every list is given twice over, with blanks, so that there are repeats to drop.
    twice = F.split(F.concat("items_text", F.lit("| "), "items_text", F.lit("|x|x ")), r"\|")
    return facts(t).filter("items_text IS NOT NULL").select(
        "evidence_id", F.array_join(F.array_distinct(X.norm_list(twice)), " / ").alias("items"))


@query("decision_prompts", "T17", """WITH links AS (SELECT evidence_id, p_partkey AS chunk_uuid, p_size, p_name FROM @facts f JOIN @part ON f.request_id % (SELECT count(*) FROM @part) = p_partkey AND NOT is_unknown),
b AS (SELECT f.request_id, f.ordinal, f.evidence_id, '- Fact: ' || coalesce(fact_key, 'None') || ' = ' || CASE WHEN trim(fact_value) <> '' THEN fact_value WHEN items_text IS NOT NULL
    THEN CAST(to_json({'items': string_split(items_text, '|')}) AS VARCHAR) ELSE 'N/A' END || CASE WHEN is_unknown THEN ' [UNKNOWN]' ELSE ' [KNOWN]' END || chr(10) || '  fact_type: ' || fact_type || chr(10)
    || coalesce('    [chunk_id: ' || chunk_uuid || ', page: ' || p_size || ']' || chr(10) || '    "' || p_name || '"', '    (no citation chunks linked)') || chr(10) AS block
  FROM @facts f LEFT JOIN links l ON l.evidence_id = f.evidence_id)
SELECT request_id, md5(string_agg(block, chr(10) ORDER BY ordinal, evidence_id)) AS digest FROM b GROUP BY request_id""")
def decision_prompts(t):
    chunks = t.part.select(F.col("p_partkey").alias("chunk_uuid"), F.col("p_size").alias("page_num"), F.col("p_name").alias("snippet_text"))
    return S.prompts(facts(t), links(t), chunks, ["ordinal", "evidence_id"]).select("request_id", F.md5("evidence_text").alias("digest"))


MESSAGES_SQL = f"""{Q.WITH}, links AS (SELECT evidence_id, p_partkey AS chunk_uuid, p_size, p_name FROM @facts f JOIN @part ON f.request_id % (SELECT count(*) FROM @part) = p_partkey AND NOT is_unknown),
b AS (SELECT f.request_id, f.ordinal, f.evidence_id, '- Fact: ' || coalesce(fact_key, 'None') || ' = ' || CASE WHEN trim(fact_value) <> '' THEN fact_value WHEN items_text IS NOT NULL
    THEN CAST(to_json({{'items': string_split(items_text, '|')}}) AS VARCHAR) ELSE 'N/A' END || CASE WHEN is_unknown THEN ' [UNKNOWN]' ELSE ' [KNOWN]' END || chr(10) || '  fact_type: ' || fact_type || chr(10)
    || coalesce('    [chunk_id: ' || chunk_uuid || ', page: ' || p_size || ']' || chr(10) || '    "' || p_name || '"', '    (no citation chunks linked)') || chr(10) AS block
  FROM @facts f LEFT JOIN links l ON l.evidence_id = f.evidence_id),
e AS (SELECT request_id, string_agg(block, chr(10) ORDER BY ordinal, evidence_id) AS evidence FROM b GROUP BY request_id)
SELECT c.request_id, md5('Case ' || c.request_id || chr(10) || chr(10) || 'Requirements' || chr(10) || 'Target credits: ' || target_credits || chr(10) || 'Lab required: ' || CASE WHEN target_lab_required THEN 'yes' ELSE 'no' END
  || chr(10) || 'Required topics: ' || CASE WHEN len(required_topics) > 0 THEN array_to_string(required_topics, '; ') ELSE 'None specified' END
  || chr(10) || 'Required outcomes: ' || CASE WHEN len(required_outcomes) > 0 THEN array_to_string(required_outcomes, '; ') ELSE 'None specified' END
  || chr(10) || 'Policy:' || chr(10) || '  approve_threshold: 90' || chr(10) || '  bridge_threshold: 80' || chr(10) || '  require_lab_parity: True' || chr(10) || '  require_credits_known: True' || chr(10)
  || '  require_topics_or_outcomes: True' || chr(10) || '  min_grade: C' || chr(10) || '  min_contact_hours: 60' || chr(10) || '  max_course_age_years: 10' || chr(10) || '  must_include_topics: ring; part'
  || chr(10) || chr(10) || 'Evidence' || chr(10) || coalesce(evidence, '(none)') || chr(10) || chr(10) || 'Instructions' || chr(10) || '{S.INSTRUCTIONS}') AS digest
FROM cases c LEFT JOIN e ON e.request_id = c.request_id"""


@query("decision_messages", "T17", MESSAGES_SQL)
def decision_messages(t):
    chunks = t.part.select(F.col("p_partkey").alias("chunk_uuid"), F.col("p_size").alias("page_num"), F.col("p_name").alias("snippet_text"))
    evidence = S.prompts(facts(t), links(t), chunks, ["ordinal", "evidence_id"])
    return S.messages(evidence, Q.cases(t), Q.STRICT).select("request_id", F.md5("message").alias("digest"))


@query("finished_replies", "T18", """WITH r AS (SELECT event_id, least(CAST(floor(value * 3) AS INTEGER) % 130, 100 - CASE WHEN event_id % 2 = 0 THEN 20 ELSE 0 END) AS s, event_id % 3 AS m FROM @events),
g AS (SELECT event_id, greatest(0, least(100, s)) AS s, m FROM r)
SELECT event_id, s AS equivalency_score, CASE WHEN s >= 90 THEN 'APPROVE' WHEN s >= 80 THEN 'APPROVE_WITH_BRIDGE' WHEN s >= 70 THEN 'NEEDS_MORE_INFO' ELSE 'DENY' END AS decision,
  CASE WHEN m = 0 THEN 55 ELSE 80 END AS evidence_quality_score, CASE WHEN m = 1 THEN 'MEDIUM' ELSE 'HIGH' END AS confidence,
  CASE WHEN m = 2 THEN 'Take lab' ELSE '' END AS bridge_plan FROM g""")
def finished_replies(t):
    m = F.col("event_id") % 3
    reply = F.concat(
        F.lit('{"decision":"APPROVE","equivalency_score":'), (F.floor(F.col("value") * 3) % 130).cast("string"), F.lit(',"evidence_quality_score":80'),
        F.when(m == 1, "").otherwise(',"confidence":"HIGH"'), F.when(m == 2, ',"bridge_plan_items":[{"text":"Take lab"}]').otherwise(""), F.lit("}"))
    rows = t.events.select("event_id", reply.alias("reply"), (100 - F.when(F.col("event_id") % 2 == 0, 20).otherwise(0)).alias("score_cap"),
                           F.when(m == 0, 55).otherwise(0).alias("fallback_quality"))
    return P.finish_replies(rows, Policy()).select("event_id", "equivalency_score", "decision", "evidence_quality_score", "confidence",
                                                   F.array_join("bridge_plan", " / ").alias("bridge_plan"))


@query("reply_score_caps", "T18", """WITH s AS (SELECT request_id, coalesce(bool_or(fact_key = 'credits_or_units' AND NOT is_unknown), false) AS c,
  coalesce(bool_or(fact_key IN ('lab_component', 'contact_hours_lab') AND NOT is_unknown), false) AS l FROM @facts GROUP BY 1)
SELECT r.request_id, 100 - CASE WHEN coalesce(c, false) THEN 0 ELSE 20 END - CASE WHEN r.request_id % 2 = 0 AND NOT coalesce(l, false) THEN 10 ELSE 0 END AS score_cap
FROM @requests r LEFT JOIN s ON s.request_id = r.request_id""")
def reply_score_caps(t):
    targets = t.requests.select("request_id", (F.col("request_id") % 2 == 0).alias("target_lab_required"))
    return P.score_caps(t.facts, targets)
