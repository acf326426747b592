"""Evidence and decision queries over every case."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill.functions import text as X
from casemill.operators import decision as D
from casemill.operators import evidence as E
from casemill.operators import matching as M
from casemill.plans.registry import query

YEAR = 2024
STRICT = D.Policy(min_grade="C", min_contact_hours=60, max_course_age_years=10, must_include_topics=("ring", "part"))

# ---- DuckDB texts ----------------------------------------------------------
KEYS_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in E.FIELD_OF_KEY.items())


def last_sql(field: str) -> str:
    return (f"(list({{'t': txt, 'l': lst, 'u': is_unknown}} ORDER BY ordinal, evidence_id) "
            f"FILTER (WHERE field = '{field}'))[-1]")


def clean_sql(items: str) -> str:
    return f"list_filter(list_transform({items}, lambda x: trim(x)), lambda x: x <> '')"


def tokens_sql(text: str) -> str:
    stop = ", ".join(f"'{w}'" for w in X.STOPWORDS)
    return (f"list_distinct(list_transform(list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), "
            f"lambda w: NOT list_contains([{stop}], w)), lambda w: CASE WHEN length(w) > 3 AND w LIKE '%s' "
            f"AND NOT (w LIKE '%ss' OR w LIKE '%us' OR w LIKE '%is') THEN left(w, length(w) - 1) ELSE w END))")


FACTS_SQL = f"""f0 AS (SELECT *, CASE WHEN items_text IS NULL THEN NULL ELSE string_split(items_text, '|') END AS items,
  CASE lower(trim(coalesce(nullif(fact_key, ''), nullif(fact_type, ''), ''))) {KEYS_SQL} END AS field FROM @facts),
f1 AS (SELECT *, CASE WHEN items IS NOT NULL THEN '[' || array_to_string(items, ', ') || ']'
                      WHEN trim(fact_value) <> '' THEN fact_value END AS txt,
                 CASE WHEN items IS NOT NULL THEN items WHEN trim(fact_value) <> '' THEN [fact_value] END AS lst FROM f0),
last AS MATERIALIZED (SELECT request_id, {', '.join(f'{last_sql(f)} AS {f}_v' for f in E.FIELDS)} FROM f1 GROUP BY request_id),
wide AS (SELECT request_id, {', '.join(f'{f}_v.{"l" if f in E.LIST_FIELDS else "t"} AS {f}, coalesce({f}_v.u, true) AS {f}_unknown' for f in E.FIELDS)} FROM last)
"""

CODE_SQL = r"""CASE WHEN regexp_matches(upper(trim(course_requested)), '^[A-Z]+[\s\-_]*\d+[A-Z]?')
  THEN regexp_replace(regexp_extract(upper(trim(course_requested)), '^[A-Z]+[\s\-_]*\d+[A-Z]?'), '^([A-Z]+)[\s\-_]*(\d+[A-Z]?)$', '\1-\2')
  ELSE regexp_replace(regexp_replace(regexp_replace(upper(trim(course_requested)), '[\s_]+', '-', 'g'), '([A-Z])(\d)', '\1-\2', 'g'), '-+', '-', 'g') END"""

CASES_SQL = f"""profiles AS (SELECT course_code, credits AS tc, lab_required AS tl, {clean_sql("string_split(topics_text, ',')")} AS rt,
  {clean_sql("string_split(outcomes_text, ',')")} AS ro FROM @courses),
cases AS MATERIALIZED (SELECT r.request_id, code, coalesce(tc, 3) AS target_credits, coalesce(tl, false) AS target_lab_required,
  coalesce(rt, []) AS required_topics, coalesce(ro, []) AS required_outcomes, w.* EXCLUDE (request_id)
  FROM (SELECT *, {CODE_SQL} AS code FROM @requests) r JOIN wide w ON w.request_id = r.request_id
  LEFT JOIN profiles p ON p.course_code = r.code)
"""


def overlap_sql(must: tuple[str, ...] = ()) -> str:
    must_list = "[" + ", ".join(f"'{m}'" for m in must) + "]::VARCHAR[]"
    return f"""req AS (SELECT *, {tokens_sql('item')} AS toks, lower(item) AS low FROM (
  SELECT request_id, 'topics' AS kind, 'topics' AS side, unnest(required_topics) AS item, generate_subscripts(required_topics, 1) AS i FROM cases
  UNION ALL SELECT request_id, 'outcomes', 'outcomes', unnest(required_outcomes), generate_subscripts(required_outcomes, 1) FROM cases
  UNION ALL SELECT request_id, 'must', 'topics', unnest({must_list}), generate_subscripts({must_list}, 1) FROM cases)),
cand AS (SELECT *, {tokens_sql('item')} AS toks, lower(item) AS low FROM (
  SELECT request_id, 'topics' AS side, unnest({clean_sql('topics')}) AS item FROM cases WHERE topics IS NOT NULL
  UNION ALL SELECT request_id, 'outcomes', unnest({clean_sql('outcomes')}) FROM cases WHERE outcomes IS NOT NULL)),
hits AS MATERIALIZED (SELECT r.request_id, r.kind, r.i, any_value(r.item) AS item,
  bool_or(coalesce(len(r.toks) > 0 AND (contains(c.low, r.low) OR contains(r.low, c.low)
    OR (len(c.toks) > 0 AND len(list_intersect(r.toks, c.toks)) / len(r.toks) >= 0.6)), false)) AS hit
  FROM req r LEFT JOIN cand c ON c.request_id = r.request_id AND c.side = r.side GROUP BY r.request_id, r.kind, r.i),
ov AS MATERIALIZED (SELECT request_id, kind, count(*) AS n_req, count(*) FILTER (WHERE hit) AS n_hit,
  coalesce(list(item ORDER BY i) FILTER (WHERE NOT item_hit), []) AS missing
  FROM (SELECT *, bool_or(hit) OVER (PARTITION BY request_id, kind, item) AS item_hit FROM hits) GROUP BY request_id, kind),
cases2 AS MATERIALIZED (SELECT c.*, coalesce(t.n_req, 0) AS n_rt, coalesce(t.n_hit, 0) AS n_ht, coalesce(t.missing, []) AS miss_t,
  coalesce(o.n_req, 0) AS n_ro, coalesce(o.n_hit, 0) AS n_ho, coalesce(o.missing, []) AS miss_o,
  coalesce(m.missing, []) AS miss_m
  FROM cases c LEFT JOIN ov t ON t.request_id = c.request_id AND t.kind = 'topics'
  LEFT JOIN ov o ON o.request_id = c.request_id AND o.kind = 'outcomes'
  LEFT JOIN ov m ON m.request_id = c.request_id AND m.kind = 'must')
"""


def whole(c: str) -> str:
    return f"CASE WHEN regexp_full_match(trim({c}), '[+-]?\\d+') THEN TRY_CAST(trim({c}) AS INTEGER) END"


def scored_sql(p: D.Policy) -> str:
    b = lambda x: "true" if x else "false"
    grades = "[" + ", ".join(f"'{g}'" for g in X.GRADE_ORDER) + "]"
    hours = lambda f: (f"CASE WHEN {f}_unknown OR {f} IS NULL THEN 0 ELSE {whole(f)} END")
    quality = " + ".join(
        f"CASE WHEN {f}_unknown OR {f} IS NULL OR {f} = {'[]' if f in E.LIST_FIELDS else chr(39) * 2} THEN 0 ELSE 70 END"
        for f in [*E.QUALITY_FIELDS, *(["grade"] if p.min_grade else []), *(["term_taken"] if p.max_course_age_years else [])])
    n_quality = 7 + bool(p.min_grade) + bool(p.max_course_age_years)
    return overlap_sql(p.must_include_topics) + f""",
s1 AS (SELECT *, credits_unknown OR credits IS NULL AS cu, {whole('credits')} AS cv,
  lab_component_unknown OR lab_component IS NULL AS lu, target_lab_required AND {b(p.require_lab_parity)} AS needed,
  CASE lower(trim(lab_component)) WHEN 'true' THEN true WHEN 'yes' THEN true WHEN 'y' THEN true WHEN '1' THEN true
    WHEN 'false' THEN false WHEN 'no' THEN false WHEN 'n' THEN false WHEN '0' THEN false ELSE true END AS has_lab,
  topics_unknown OR topics IS NULL AS tu, outcomes_unknown OR outcomes IS NULL AS ou FROM cases2),
s2 AS (SELECT *, {b(p.require_topics_or_outcomes)} AND tu AND ou AS no_content, abs(cv - target_credits) AS off,
  list_position({grades}, replace(upper(trim(grade)), ' ', '')) AS grank,
  {YEAR} - TRY_CAST(nullif(regexp_extract(term_taken, '(19|20)\\d{{2}}'), '') AS INTEGER) AS age,
  NOT (contact_hours_lecture_unknown OR contact_hours_lecture IS NULL) OR NOT (contact_hours_lab_unknown OR contact_hours_lab IS NULL) AS hk,
  ({hours('contact_hours_lecture')}) + ({hours('contact_hours_lab')}) AS hours,
  CAST(floor(({quality}) / {n_quality}) AS INTEGER) AS evidence_quality_score FROM s1),
s3 AS MATERIALIZED (SELECT *, CASE WHEN cu OR cv IS NULL THEN 0 WHEN off = 0 THEN 20 WHEN off = 1 THEN 10 ELSE 0 END AS credit_points,
  CASE WHEN NOT needed THEN 10 WHEN lu THEN 0 WHEN has_lab THEN 10 ELSE 0 END AS lab_points,
  CASE WHEN no_content THEN 0 WHEN n_rt = 0 THEN 40 ELSE CAST(round_even(40 * (n_ht / n_rt), 0) AS INTEGER) END AS topic_points,
  CASE WHEN no_content THEN 0 WHEN n_ro = 0 THEN 30 ELSE CAST(round_even(30 * (n_ho / n_ro), 0) AS INTEGER) END AS outcome_points
  FROM s2),
s4 AS MATERIALIZED (SELECT *, credit_points + lab_points + topic_points + outcome_points AS score,
  list_filter([
    CASE WHEN cu AND {b(p.require_credits_known)} THEN 'INFO_MISSING: Source course credits are unknown.' END,
    CASE WHEN NOT cu AND cv IS NULL THEN 'INFO_MISSING: Source course credits could not be parsed as a number.' END,
    CASE WHEN NOT cu AND off = 1 THEN 'FIXABLE: Credits are close but not equal (source ' || cv || ' vs target ' || target_credits || ').' END,
    CASE WHEN NOT cu AND off > 1 THEN 'HARD: Credits do not match (source ' || cv || ' vs target ' || target_credits || ').' END,
    CASE WHEN needed AND lu THEN 'INFO_MISSING: Target course requires a lab, but source lab information is unknown.' END,
    CASE WHEN needed AND NOT lu AND NOT has_lab THEN 'FIXABLE: Target course requires a lab, but source course does not show a lab component.' END,
    CASE WHEN no_content THEN 'INFO_MISSING: Both topics and learning outcomes are missing/unknown for the source course.' END,
    CASE WHEN NOT no_content AND n_rt > 0 AND n_ht = 0 THEN 'HARD: No required topics were clearly matched.' END,
    CASE WHEN NOT no_content AND n_ro > 0 AND n_ho = 0 THEN 'HARD: No required learning outcomes were clearly matched.' END,
    {gap_rules(p)}
    NULL], lambda x: x IS NOT NULL) AS gaps,
  list_filter([
    CASE WHEN NOT cu AND off = 0 THEN 'Credits match (' || cv || ' credits).' END,
    CASE WHEN needed AND NOT lu AND has_lab THEN 'Lab requirement satisfied (source includes a lab component).' END,
    CASE WHEN NOT no_content AND n_ht > 0 THEN 'Matched ' || n_ht || '/' || n_rt || ' required topics.' END,
    CASE WHEN NOT no_content AND n_rt = 0 THEN 'No required topics specified for target course; topics not used as a strict constraint.' END,
    CASE WHEN NOT no_content AND n_ho > 0 THEN 'Matched ' || n_ho || '/' || n_ro || ' required learning outcomes.' END,
    CASE WHEN NOT no_content AND n_ro = 0 THEN 'No required learning outcomes specified for target course; outcomes not used as a strict constraint.' END,
    {reason_rules(p)}
    NULL], lambda x: x IS NOT NULL) AS reasons,
  list_concat(list_concat(list_concat(
    CASE WHEN NOT cu AND off = 1 THEN ['course:Complete an additional 1-credit bridge component if required by the department.'] ELSE [] END,
    CASE WHEN needed AND NOT lu AND NOT has_lab THEN ['lab:Take the target lab (or an approved lab equivalent) as a bridge requirement.'] ELSE [] END),
    CASE WHEN NOT no_content AND n_ht > 0 THEN list_transform(miss_t, lambda x: 'self_study:Cover the missing topic ''' || x || ''' (self-study, module, or short course).') ELSE [] END),
    CASE WHEN NOT no_content AND n_ho > 0 THEN list_transform(miss_o, lambda x: 'project:Demonstrate the missing learning outcome: ''' || x || ''' (project or exam).') ELSE [] END) AS bridges
  FROM s3),
s5 AS MATERIALIZED (SELECT *, CAST(len(list_filter(gaps, lambda x: x LIKE 'HARD%')) AS INTEGER) AS hard_gaps,
  CAST(len(list_filter(gaps, lambda x: x LIKE 'FIXABLE%')) AS INTEGER) AS fixable_gaps,
  CAST(len(list_filter(gaps, lambda x: x LIKE 'INFO%')) AS INTEGER) AS info_missing_gaps,
  CAST(len(bridges) AS INTEGER) AS bridge_items FROM s4),
s6 AS (SELECT *, CASE WHEN hard_gaps > 0 THEN 'DENY' WHEN score >= {p.approve_threshold} AND fixable_gaps + bridge_items > 0 THEN 'APPROVE_WITH_BRIDGE'
  WHEN score >= {p.approve_threshold} THEN 'APPROVE' WHEN score >= {p.bridge_threshold} THEN 'APPROVE_WITH_BRIDGE'
  WHEN score >= {p.needs_info_threshold} THEN 'NEEDS_MORE_INFO' ELSE 'DENY' END AS decision,
  100 - 12 * (cu::INT + lu::INT + tu::INT + ou::INT) - 10 * info_missing_gaps AS base FROM s5),
s7 AS (SELECT *, CASE WHEN decision = 'APPROVE' THEN base - {edge(f'score - {p.approve_threshold}')}
  WHEN decision = 'APPROVE_WITH_BRIDGE' THEN least(base, 65)
  WHEN decision = 'DENY' AND hard_gaps = 0 THEN base - {edge(f'{p.needs_info_threshold} - score')} ELSE base END AS conf FROM s6),
result AS (SELECT *, CASE WHEN decision = 'NEEDS_MORE_INFO' THEN 'LOW' WHEN conf >= 75 THEN 'HIGH' WHEN conf >= 45 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
  greatest(0, least(100, score)) AS equivalency_score FROM s7)
"""


def edge(margin: str) -> str:
    return f"(CASE WHEN {margin} < 3 THEN 30 WHEN {margin} < 5 THEN 20 WHEN {margin} < 10 THEN 10 ELSE 0 END)"


def gap_rules(p: D.Policy) -> str:
    out = []
    if p.min_grade:
        unknown = "(grade_unknown OR grade IS NULL OR grade = '')"
        floor = X.GRADE_ORDER.index(p.min_grade) + 1
        out += [f"CASE WHEN {unknown} THEN 'INFO_MISSING: Minimum grade policy is set ({p.min_grade}) but source grade is unknown.' END",
                f"CASE WHEN NOT {unknown} AND coalesce(grank, 0) = 0 THEN 'INFO_MISSING: Source grade (''' || grade || ''') could not be parsed on the letter-grade scale.' END",
                f"CASE WHEN NOT {unknown} AND grank > {floor} THEN 'HARD: Grade (' || grade || ') does not meet minimum policy ({p.min_grade}).' END"]
    if p.min_contact_hours:
        h = p.min_contact_hours
        out += [f"CASE WHEN NOT hk THEN 'INFO_MISSING: Minimum contact hours policy is set ({h}h) but source contact hours are unknown.' END",
                f"CASE WHEN hk AND hours < {h} THEN 'HARD: Contact hours (' || hours || 'h) below minimum policy ({h}h).' END",
                "CASE WHEN hk AND hours IS NULL THEN 'INFO_MISSING: Contact hours could not be parsed as numbers.' END"]
    if p.max_course_age_years:
        unknown, a = "(term_taken_unknown OR term_taken IS NULL OR term_taken = '')", p.max_course_age_years
        out += [f"CASE WHEN {unknown} THEN 'INFO_MISSING: Course expiration policy is set ({a} years) but source term is unknown.' END",
                f"CASE WHEN NOT {unknown} AND age IS NULL THEN 'INFO_MISSING: Term taken (''' || term_taken || ''') could not be parsed to a year.' END",
                f"CASE WHEN NOT {unknown} AND age > {a} THEN 'HARD: Source course is ' || age || ' years old; policy maximum is {a} years.' END"]
    if p.must_include_topics:
        out += ["CASE WHEN tu THEN 'INFO_MISSING: Mandatory topics policy is set but source topics are unknown.' END",
                "CASE WHEN NOT tu AND len(miss_m) > 0 THEN 'HARD: Missing mandatory policy topics: ' || array_to_string(miss_m, ', ') || '.' END"]
    return "".join(x + ",\n    " for x in out)


def reason_rules(p: D.Policy) -> str:
    out = []
    if p.min_grade:
        floor = X.GRADE_ORDER.index(p.min_grade) + 1
        out.append(f"CASE WHEN NOT (grade_unknown OR grade IS NULL OR grade = '') AND grank BETWEEN 1 AND {floor} THEN 'Grade (' || grade || ') meets the minimum policy ({p.min_grade}).' END")
    if p.min_contact_hours:
        out.append(f"CASE WHEN hk AND hours >= {p.min_contact_hours} THEN 'Contact hours (' || hours || 'h) meet the minimum policy ({p.min_contact_hours}h).' END")
    if p.max_course_age_years:
        out.append(f"CASE WHEN NOT (term_taken_unknown OR term_taken IS NULL OR term_taken = '') AND age <= {p.max_course_age_years} THEN 'Source course is ' || age || ' years old, within the {p.max_course_age_years}-year limit.' END")
    if p.must_include_topics:
        out.append(f"CASE WHEN NOT tu AND len(miss_m) = 0 THEN 'All mandatory policy topics present ({len(p.must_include_topics)}).' END")
    return "".join(x + ",\n    " for x in out)


WITH = f"WITH {FACTS_SQL},\n{CASES_SQL}"
# ----------------------------------------------------------------------------


def facts(t):
    return t.facts.withColumn("items", F.split("items_text", r"\|"))


def profiles(t):
    return t.courses.select(
        F.col("course_code").alias("code"), F.col("credits").alias("target_credits"),
        F.col("lab_required").alias("target_lab_required"), X.split_list(F.col("topics_text")).alias("required_topics"),
        X.split_list(F.col("outcomes_text")).alias("required_outcomes"))


def cases(t):
    """Every case that has evidence, with its evidence row and target profile."""
    asked = t.requests.select("request_id", "course_requested")
    return D.with_target(E.pivot_facts(facts(t)).join(asked, "request_id"), profiles(t))


def joined(c: str):
    return F.array_join(c, " / ")


@query("fact_pivot", "A7 F11 F12 P4", WITH.split("profiles AS")[0].rstrip().rstrip(",") + f"""
SELECT request_id, {', '.join(f"array_to_string({f}, ' / ') AS {f}" if f in E.LIST_FIELDS else f for f in E.FIELDS)},
  {', '.join(f'{f}_unknown' for f in E.FIELDS)},
  CASE WHEN lower(trim(lab_component)) IN ('true', 'yes', 'y', '1') THEN true
       WHEN lower(trim(lab_component)) IN ('false', 'no', 'n', '0') THEN false END AS lab_flag FROM wide""")
def fact_pivot(t):
    wide = E.pivot_facts(facts(t))
    return wide.select("request_id", *[joined(f).alias(f) if f in E.LIST_FIELDS else F.col(f) for f in E.FIELDS],
                       *[f"{f}_unknown" for f in E.FIELDS], X.truth(F.col("lab_component")).alias("lab_flag"))


@query("target_profiles", "J8 F3 S4", WITH + """SELECT request_id, code, target_credits, target_lab_required,
  array_to_string(required_topics, ' / ') AS required_topics, array_to_string(required_outcomes, ' / ') AS required_outcomes FROM cases""")
def target_profiles(t):
    return cases(t).select("request_id", "code", "target_credits", "target_lab_required",
                           joined("required_topics").alias("required_topics"), joined("required_outcomes").alias("required_outcomes"))


KINDS = {"topic": ("required_topics", "topics"), "outcome": ("required_outcomes", "outcomes")}


def component_points(t, policy):
    return D.decide(cases(t), policy, YEAR).select("request_id", "credit_points", "lab_points", "topic_points", "outcome_points")


@query("component_points", "D1 D2 D3 D4 D5 J9", WITH + "," + scored_sql(STRICT) +
       "SELECT request_id, credit_points, lab_points, topic_points, outcome_points FROM result")
def component_points_strict(t):
    return component_points(t, STRICT)


MISSING_SQL = WITH + "," + overlap_sql() + """
SELECT request_id, CAST(n_ht AS INTEGER) AS topics_matched, CAST(n_ho AS INTEGER) AS outcomes_matched,
  array_to_string(miss_t, ' / ') AS topics_missing, array_to_string(miss_o, ' / ') AS outcomes_missing FROM cases2"""


@query("required_item_matches", "J9 U3 F9 F10", MISSING_SQL)
def required_item_matches(t):
    df = M.with_hits(cases(t).select("request_id", *[c for pair in KINDS.values() for c in pair]), KINDS)
    return df.select("request_id", *[c for k in KINDS for c in (
        F.size(D._items(F.col(f"_{k}_hits"), True)).alias(f"{k}s_matched"),
        joined(D._missing(F.col(f"_{k}_hits"))).alias(f"{k}s_missing"))])


REPORT_SQL = """SELECT request_id, decision, equivalency_score, confidence, evidence_quality_score, hard_gaps, fixable_gaps,
  info_missing_gaps, bridge_items, array_to_string(reasons, ' / ') AS reasons, array_to_string(gaps, ' / ') AS gaps,
  array_to_string(bridges, ' / ') AS bridges FROM result"""


def report(t, policy):
    df = D.decide(cases(t), policy, YEAR)
    return df.select(
        "request_id", "decision", "equivalency_score", "confidence", "evidence_quality_score", "hard_gaps",
        "fixable_gaps", "info_missing_gaps", "bridge_items",
        joined(F.transform("reasons", lambda r: r["text"])).alias("reasons"),
        joined(F.transform("gaps", lambda g: F.concat(g["severity"], F.lit(": "), g["text"]))).alias("gaps"),
        joined(F.transform("bridge_plan_items", lambda b: F.concat(b["remediation_type"], F.lit(":"), b["text"]))).alias("bridges"))


@query("decisions_shipped_policy", "D1 D2 D3 D4 D5 D10 D11 D12 D13 A8 A10", WITH + "," + scored_sql(D.SHIPPED_POLICY) + REPORT_SQL)
def decisions_shipped_policy(t):
    return report(t, D.SHIPPED_POLICY)


@query("decisions_all_rules", "D6 D7 D8 D9 D10 D11 D13 F5 F6", WITH + "," + scored_sql(STRICT) + REPORT_SQL)
def decisions_all_rules(t):
    return report(t, STRICT)


@query("decision_summary", "A5 D10 D16", WITH + "," + scored_sql(D.SHIPPED_POLICY) + """
SELECT decision, confidence, count(*) AS n_cases, round(avg(equivalency_score), 4) AS avg_score FROM result GROUP BY ALL""")
def decision_summary(t):
    df = D.decide(cases(t), D.SHIPPED_POLICY, YEAR)
    return df.groupBy("decision", "confidence").agg(
        F.count(F.lit(1)).alias("n_cases"), F.round(F.avg("equivalency_score"), 4).alias("avg_score"))


EXPECTED_SQL = "CASE l.quality WHEN 1 THEN 'APPROVE' WHEN 0 THEN 'DENY' END"


@query("evaluation_report", "D16 A6", WITH + "," + scored_sql(D.SHIPPED_POLICY) + f""",
lab AS (SELECT doc_id, any_value({EXPECTED_SQL}) AS expected FROM @labels l GROUP BY doc_id)
SELECT request_id, expected, decision AS actual, expected = decision AS agrees, equivalency_score, confidence, evidence_quality_score, hard_gaps,
  fixable_gaps, info_missing_gaps, bridge_items FROM result LEFT JOIN lab ON lab.doc_id = request_id""")
def evaluation_report(t):
    expected = t.labels.select(F.col("doc_id").alias("request_id"), F.when(F.col("quality") == 1, "APPROVE").when(F.col("quality") == 0, "DENY").alias("expected"))
    return D.evaluation_report(D.decide(cases(t), D.SHIPPED_POLICY, YEAR), expected.distinct())


@query("evaluation_agreement", "D16 A6", WITH + "," + scored_sql(D.SHIPPED_POLICY) + f""",
lab AS (SELECT doc_id, any_value({EXPECTED_SQL}) AS expected FROM @labels l GROUP BY doc_id)
SELECT count(*) AS n_cases, count(expected) AS n_labeled, count(*) FILTER (WHERE expected = decision) AS n_agree,
  round(count(*) FILTER (WHERE expected = decision) / nullif(count(expected), 0), 4) AS agreement FROM result LEFT JOIN lab ON lab.doc_id = request_id""")
def evaluation_agreement(t):
    return D.agreement(evaluation_report(t))


CHECKED = D.Policy()


@query("decisions_prechecked", "D14 F22 F17", WITH + "," + scored_sql(CHECKED) + """,
pre AS (SELECT *, list_filter([CASE WHEN credits_unknown OR credits IS NULL OR credits = '' THEN 'Missing source course credits.' END,
  CASE WHEN (topics_unknown OR topics IS NULL OR len(topics) = 0) AND (outcomes_unknown OR outcomes IS NULL OR len(outcomes) = 0)
    THEN 'Missing source course topics and learning outcomes.' END], lambda x: x IS NOT NULL) AS missing FROM result),
fin AS (SELECT request_id, CASE WHEN len(missing) > 0 THEN 'NEEDS_MORE_INFO' ELSE decision END AS decision,
  CASE WHEN len(missing) > 0 THEN 0 ELSE equivalency_score END AS equivalency_score,
  CASE WHEN len(missing) > 0 THEN 'LOW' ELSE confidence END AS confidence, array_to_string(missing, ' / ') AS missing FROM pre)
SELECT *, CASE decision WHEN 'APPROVE' THEN 'The source course meets the credit and content requirements under the current policy.'
  WHEN 'APPROVE_WITH_BRIDGE' THEN 'The source course is close to equivalent but requires bridging requirements.'
  WHEN 'DENY' THEN 'The source course does not meet the minimum equivalency threshold under the current policy.'
  ELSE 'The request is missing required evidence needed to evaluate equivalency.' END AS why FROM fin""")
def decisions_prechecked(t):
    df = D.decide_checked(cases(t).withColumn("missing", D.missing_evidence(CHECKED)), CHECKED, YEAR)
    return df.select("request_id", "decision", "equivalency_score", "confidence", joined("missing").alias("missing"),
                     D.explanation(F.col("decision")).alias("why"))


PACKET = ("request_id", "credits", "credits_unknown", "lab_component", "topics", "outcomes", "target_credits", "required_topics")
PACKET_SQL = "sha256(to_json({" + ", ".join(f"'{c}': {c}" for c in sorted(PACKET)) + "}))"


@query("packet_hashes", "F15", WITH + f"SELECT request_id, {PACKET_SQL} AS inputs_hash FROM cases")
def packet_hashes(t):
    return cases(t).select("request_id", D.packet_hash(*PACKET).alias("inputs_hash"))


@query("changed_packets", "D15 W1", """WITH done AS (SELECT request_id, inputs_hash, extraction_run_id FROM @decision_runs WHERE status = 'completed'
  QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY created_at DESC, decision_run_id DESC) = 1),
packets AS (SELECT request_id, md5(CAST(request_id % 5 AS STRING)) AS inputs_hash, request_id % 3 AS extraction_run_id FROM @requests)
SELECT p.request_id, p.inputs_hash, p.extraction_run_id FROM packets p WHERE NOT EXISTS (SELECT 1 FROM done d
  WHERE d.request_id = p.request_id AND d.inputs_hash = p.inputs_hash AND d.extraction_run_id = p.extraction_run_id)""")
def changed_packets(t):
    packets = t.requests.select("request_id", F.md5((F.col("request_id") % 5).cast("string")).alias("inputs_hash"),
                                (F.col("request_id") % 3).alias("extraction_run_id"))
    return D.changed_only(packets, t.decision_runs).select("request_id", "inputs_hash", "extraction_run_id")


@query("label_agreement", "A6 D16", """WITH r AS (SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'APPROVE' WHEN l.quality = 0 THEN 'DENY' END AS expected,
  CASE WHEN d.n_chars % 3 = 0 THEN 'DENY' ELSE 'APPROVE' END AS actual FROM @documents d LEFT JOIN @labels l ON l.doc_id = d.doc_id)
SELECT count(*) AS n_cases, count(expected) AS n_labeled, count(*) FILTER (WHERE expected = actual) AS n_agree,
  round(count(*) FILTER (WHERE expected = actual) / nullif(count(expected), 0), 4) AS agreement FROM r""")
def label_agreement(t):
    rows = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id", "left").select(
        F.when(F.col("quality") == 1, "APPROVE").when(F.col("quality") == 0, "DENY").alias("expected"),
        F.when(F.col("n_chars") % 3 == 0, "DENY").otherwise("APPROVE").alias("actual"))
    return D.agreement(rows)


@query("displayed_decisions", "P12", """SELECT decision_run_id, CASE WHEN decision = 'APPROVE' AND (bridge_text <> '' OR contains(severities_text, 'FIXABLE'))
  THEN 'APPROVE_WITH_BRIDGE' ELSE decision END AS shown FROM @decision_results""")
def displayed_decisions(t):
    return t.decision_results.select("decision_run_id", D.display_decision(
        F.col("decision"), X.split_list(F.col("severities_text"), r"\|"), X.split_list(F.col("bridge_text"), r"\|")).alias("shown"))


@query("row_evidence_quality", "A9", """WITH cites AS (SELECT DISTINCT evidence_id FROM @facts WHERE ordinal % 2 = 0)
SELECT request_id, CAST(floor(avg(CASE WHEN is_unknown OR (coalesce(fact_value, '') = '' AND items_text IS NULL) THEN 0
  WHEN c.evidence_id IS NOT NULL THEN 100 ELSE 70 END)) AS INTEGER) AS quality, count(*) AS n_rows
FROM @facts f LEFT JOIN cites c ON c.evidence_id = f.evidence_id
WHERE fact_key IN ('lab_component', 'topics', 'outcomes', 'assessments', 'contact_hours_lecture') GROUP BY request_id""")
def row_evidence_quality(t):
    f = facts(t)
    return E.row_quality(f, f.filter(F.col("ordinal") % 2 == 0).select("evidence_id"))
