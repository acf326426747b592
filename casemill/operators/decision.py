"""Rule-based case decisions as column logic over one wide row per case.

Input of :func:`decide`: the evidence row of ``pivot_facts`` joined to a target profile
(target_credits, target_lab_required, required_topics, required_outcomes). No shuffle happens here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.functions import text as X
from casemill.operators.evidence import no_chunks, quality_score

# ---- fixed values ----------------------------------------------------------
W_TOPICS, W_OUTCOMES, W_CREDITS, W_LAB = 40, 30, 20, 10
DEFAULT_TARGET_CREDITS = 3
TOKEN_SHARE = 0.6
GAP = "struct<text:string,severity:string,citations:array<string>>"
REASON = "struct<text:string,citations:array<string>>"
BRIDGE = "struct<text:string,remediation_type:string,credits:int,addresses_gap:string>"
EXPLANATIONS = {
    "APPROVE": "The source course meets the credit and content requirements under the current policy.",
    "APPROVE_WITH_BRIDGE": "The source course is close to equivalent but requires bridging requirements.",
    "DENY": "The source course does not meet the minimum equivalency threshold under the current policy.",
    "NEEDS_MORE_INFO": "The request is missing required evidence needed to evaluate equivalency.",
}
NO_EXPLANATION = "No recommendation available."
AMBIGUOUS_REQUEST = (
    "Equivalency score is in the ambiguous band; additional evidence "
    "(more detailed syllabus, transcript, assessment samples) would help."
)
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Policy:
    """Thresholds and rules; the defaults are the class defaults of the domain, all rules after the toggles off."""

    approve_threshold: int = 90
    bridge_threshold: int = 80
    needs_info_threshold: int = 70
    require_lab_parity: bool = True
    require_credits_known: bool = True
    require_topics_or_outcomes: bool = True
    min_grade: str | None = None
    min_contact_hours: int = 0
    max_course_age_years: int = 0
    must_include_topics: tuple[str, ...] = ()
    # With this on, any INFO_MISSING gap asks for more information, as the domain's guides say; its code does not.
    strict_info: bool = False


# The shipped configuration turns two toggles off.
SHIPPED_POLICY = Policy(require_credits_known=False, require_topics_or_outcomes=False)


def with_target(cases: DataFrame, profiles: DataFrame) -> DataFrame:
    """Each case with its target profile; an unknown course gets the permissive default.

    ``cases`` has course_requested; ``profiles`` has code and the four profile columns. The profile side is left
    to the optimizer: it broadcasts when its measured size allows and else is joined by shuffle.
    """
    none = F.array().cast("array<string>")
    # Tokens of the required items are made once per profile rather than once per case.
    profiles = profiles.withColumns({"_req_topics": _keyed(F.col("required_topics")),
                                     "_req_outcomes": _keyed(F.col("required_outcomes"))})
    return (
        cases.withColumn("code", X.target_code(F.col("course_requested")))
        .join(profiles, "code", "left")
        .withColumns({
            "target_credits": F.coalesce("target_credits", F.lit(DEFAULT_TARGET_CREDITS)),
            "target_lab_required": F.coalesce("target_lab_required", F.lit(False)),
            "required_topics": F.coalesce("required_topics", none),
            "required_outcomes": F.coalesce("required_outcomes", none),
            "_req_topics": F.coalesce("_req_topics", _keyed(none)),
            "_req_outcomes": F.coalesce("_req_outcomes", _keyed(none)),
        })
    )


def _keyed(items: Column) -> Column:
    """Items with their lower-case form and token set."""
    return F.transform(items, lambda s: F.struct(
        s.alias("item"), F.lower(X.strip(s)).alias("low"), X.tokens(s).alias("toks")))


def same_item(r: Column, c: Column) -> Column:
    """Whether a found item matches a required one: containment either way or 60 % shared tokens."""
    share = F.size(F.array_intersect(r["toks"], c["toks"])) / F.size(r["toks"])
    return c["low"].contains(r["low"]) | r["low"].contains(c["low"]) | (
        (F.size(c["toks"]) > 0) & (share >= TOKEN_SHARE))


def split_matches(required: Column, candidates: Column) -> Column:
    """(matched, missing) required items, compared row by row (J9, U3); :mod:`matching` compares distinct pairs once."""
    def hit(r: Column) -> Column:
        return (F.size(r["toks"]) > 0) & F.exists(candidates, lambda c: same_item(r, c))

    flagged = F.transform(required, lambda r: F.struct(r["item"].alias("item"), hit(r).alias("hit")))
    return flagged


def _items(flagged: Column, hit: bool) -> Column:
    kept = F.filter(flagged, lambda f: f["hit"] if hit else ~f["hit"])
    return F.transform(kept, lambda f: f["item"])


def _missing(flagged: Column) -> Column:
    """Required items whose text is not among the matched texts, duplicates kept."""
    matched = _items(flagged, True)
    return F.filter(F.transform(flagged, lambda f: f["item"]), lambda r: ~F.array_contains(matched, r))


def _gap(when: Column, text: Column | str, severity: str, cites: Column) -> Column:
    text = F.lit(text) if isinstance(text, str) else text
    return F.when(when, F.struct(text.alias("text"), F.lit(severity).alias("severity"),
                                 cites.alias("citations")).cast(GAP))


def _reason(when: Column, text: Column | str, cites: Column) -> Column:
    text = F.lit(text) if isinstance(text, str) else text
    return F.when(when, F.struct(text.alias("text"), cites.alias("citations")).cast(REASON))


def _bridge(text: Column, kind: str, credits: int | None, gap: Column) -> Column:
    return F.struct(text.alias("text"), F.lit(kind).alias("remediation_type"),
                    F.lit(credits).cast("int").alias("credits"), gap.alias("addresses_gap")).cast(BRIDGE)


def _ask(when: Column, text: str) -> Column:
    return F.when(when, F.lit(text))


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def decide(cases: DataFrame, policy: Policy, current_year: int) -> DataFrame:
    """Add decision, score, confidence, quality, reasons, gaps, bridge items and requests."""
    p, no, yes = policy, F.lit(False), F.lit(True)
    df = cases.withColumns({
        "_credits_unknown": F.col("credits_unknown") | F.col("credits").isNull(),
        "_lab_unknown": F.col("lab_component_unknown") | F.col("lab_component").isNull(),
        "_topics_unknown": F.col("topics_unknown") | F.col("topics").isNull(),
        "_outcomes_unknown": F.col("outcomes_unknown") | F.col("outcomes").isNull(),
        "_credits": X.strict_int(F.col("credits")),
        "_found_topics": _keyed(X.norm_list(F.col("topics"))),
        "_found_outcomes": _keyed(X.norm_list(F.col("outcomes"))),
        **{n: _keyed(F.col(c)) for n, c in (("_req_topics", "required_topics"), ("_req_outcomes", "required_outcomes"))
           if n not in cases.columns},
    })
    df = df.withColumns({
        **{f"_{kind}_hits": split_matches(F.col(f"_req_{kind}s"), F.col(f"_found_{kind}s")) for kind in ("topic", "outcome")
           if f"_{kind}_hits" not in cases.columns},
        "_content_missing": (F.col("_topics_unknown") & F.col("_outcomes_unknown"))
        if p.require_topics_or_outcomes else no,
    })
    df = df.withColumns({
        "_n_topics": F.size(_items(F.col("_topic_hits"), True)),
        "_n_outcomes": F.size(_items(F.col("_outcome_hits"), True)),
        "_missing_topics": _missing(F.col("_topic_hits")),
        "_missing_outcomes": _missing(F.col("_outcome_hits")),
        "_must_missing": _must_missing(p),
        **_hours(p),
    })

    # Points per component.
    target = F.col("target_credits")
    off = F.abs(F.col("_credits") - target)
    lab_needed = F.col("target_lab_required") if p.require_lab_parity else no
    has_lab = F.coalesce(X.truth(F.col("lab_component")), F.col("lab_component") != "")

    def overlap_points(n: str, required: str, weight: int) -> Column:
        size = F.size(required)
        part = F.bround(F.lit(float(weight)) * (F.col(n) / F.greatest(size, F.lit(1))), 0).cast("int")
        return F.when(F.col("_content_missing"), 0).when(size == 0, weight).otherwise(part)

    df = df.withColumns({
        "credit_points": F.when(F.col("_credits_unknown") | F.col("_credits").isNull(), 0)
        .when(off == 0, W_CREDITS).when(off == 1, W_CREDITS // 2).otherwise(0),
        "_lab_needed": lab_needed,
        "_has_lab": has_lab,
        "lab_points": F.when(~lab_needed, W_LAB).when(F.col("_lab_unknown"), 0).when(has_lab, W_LAB).otherwise(0),
        "topic_points": overlap_points("_n_topics", "required_topics", W_TOPICS),
        "outcome_points": overlap_points("_n_outcomes", "required_outcomes", W_OUTCOMES),
    })
    df = df.withColumn("_score", F.col("credit_points") + F.col("lab_points") + F.col("topic_points") + F.col("outcome_points"))

    # Findings in fixed order: credits, lab, content, then the configured rules.
    cu, cv = F.col("_credits_unknown"), F.col("_credits")
    c_bad, c_ok = ~cu & cv.isNull(), ~cu & cv.isNotNull()
    needed, lu = F.col("_lab_needed"), F.col("_lab_unknown")
    open_content = ~F.col("_content_missing")
    n_rt, n_ro = F.size("required_topics"), F.size("required_outcomes")
    c_cites, l_cites = F.col("credits_cites"), F.col("lab_component_cites")
    t_cites, o_cites = F.col("topics_cites"), F.col("outcomes_cites")
    both_cites = F.concat(t_cites, o_cites)
    versus = (F.lit(" (source "), cv, F.lit(" vs target "), target, F.lit(")."))
    near, far = c_ok & (off == 1), c_ok & (off > 1)

    gaps = [
        _gap(cu & F.lit(p.require_credits_known), "Source course credits are unknown.", "INFO_MISSING", c_cites),
        _gap(c_bad, "Source course credits could not be parsed as a number.", "INFO_MISSING", c_cites),
        _gap(near, _text("Credits are close but not equal", *versus), "FIXABLE", c_cites),
        _gap(far, _text("Credits do not match", *versus), "HARD", c_cites),
        _gap(needed & lu, "Target course requires a lab, but source lab information is unknown.", "INFO_MISSING", l_cites),
        _gap(needed & ~lu & ~F.col("_has_lab"),
             "Target course requires a lab, but source course does not show a lab component.", "FIXABLE", l_cites),
        _gap(~open_content, "Both topics and learning outcomes are missing/unknown for the source course.",
             "INFO_MISSING", both_cites),
        _gap(open_content & (n_rt > 0) & (F.col("_n_topics") == 0), "No required topics were clearly matched.",
             "HARD", t_cites),
        _gap(open_content & (n_ro > 0) & (F.col("_n_outcomes") == 0),
             "No required learning outcomes were clearly matched.", "HARD", o_cites),
    ]
    reasons = [
        _reason(c_ok & (off == 0), _text("Credits match (", cv, " credits)."), c_cites),
        _reason(needed & ~lu & F.col("_has_lab"), "Lab requirement satisfied (source includes a lab component).", l_cites),
        _reason(open_content & (n_rt > 0) & (F.col("_n_topics") > 0),
                _text("Matched ", F.col("_n_topics"), "/", n_rt, " required topics."), t_cites),
        _reason(open_content & (n_rt == 0), "No required topics specified for target course; topics not used as a "
                "strict constraint.", no_chunks()),
        _reason(open_content & (n_ro > 0) & (F.col("_n_outcomes") > 0),
                _text("Matched ", F.col("_n_outcomes"), "/", n_ro, " required learning outcomes."), o_cites),
        _reason(open_content & (n_ro == 0), "No required learning outcomes specified for target course; outcomes not "
                "used as a strict constraint.", no_chunks()),
    ]
    asks = [
        _ask(cu & F.lit(p.require_credits_known),
             "Provide official credit hours for the source course (catalog/syllabus)."),
        _ask(c_bad, "Provide credits in a clear numeric format."),
        _ask(needed & lu, "Provide evidence whether the source course includes a lab component (catalog/syllabus)."),
        _ask(~open_content, "Provide course topics and/or learning outcomes from the syllabus or official catalog."),
    ]
    no_bridge = F.array().cast(f"array<{BRIDGE}>")
    bridges = [
        F.when(near, F.array(_bridge(
            F.lit("Complete an additional 1-credit bridge component if required by the department."), "course", 1,
            F.lit("credit_shortfall")))),
        F.when(needed & ~lu & ~F.col("_has_lab"), F.array(_bridge(
            F.lit("Take the target lab (or an approved lab equivalent) as a bridge requirement."), "lab", None,
            F.lit("lab_missing")))),
        F.when(open_content & (F.col("_n_topics") > 0), F.transform("_missing_topics", lambda t: _bridge(
            _text("Cover the missing topic '", t, "' (self-study, module, or short course)."), "self_study", None,
            _text("topic_missing:", t)))),
        F.when(open_content & (F.col("_n_outcomes") > 0), F.transform("_missing_outcomes", lambda o: _bridge(
            _text("Demonstrate the missing learning outcome: '", o, "' (project or exam)."), "project", None,
            _text("outcome_missing:", o)))),
    ]
    for extra in (_grade_rule(p), _hours_rule(p), _age_rule(p, current_year), _mandatory_rule(p)):
        gaps += extra[0]
        reasons += extra[1]
        asks += extra[2]

    df = df.withColumns({
        "gaps": F.array_compact(F.array(*gaps)),
        "reasons": F.array_compact(F.array(*reasons)),
        "bridge_plan_items": F.concat(*[F.coalesce(b, no_bridge) for b in bridges]),
        "_asks": F.array_compact(F.array(*asks)),
    })
    count = lambda s: F.size(F.filter("gaps", lambda g: g["severity"] == s))
    df = df.withColumns({"hard_gaps": count("HARD"), "fixable_gaps": count("FIXABLE"),
                         "info_missing_gaps": count("INFO_MISSING"), "bridge_items": F.size("bridge_plan_items")})

    # Decision bands, then confidence.
    score = F.col("_score")
    wants_bridge = (F.col("fixable_gaps") > 0) | (F.col("bridge_items") > 0)
    ladder = F.when(F.col("hard_gaps") > 0, "DENY")
    if p.strict_info:
        ladder = ladder.when(F.col("info_missing_gaps") > 0, "NEEDS_MORE_INFO")
    ladder = (
        ladder.when(score >= p.approve_threshold, F.when(wants_bridge, "APPROVE_WITH_BRIDGE").otherwise("APPROVE"))
        .when(score >= p.bridge_threshold, "APPROVE_WITH_BRIDGE")
        .when(score >= p.needs_info_threshold, "NEEDS_MORE_INFO")
        .otherwise("DENY")
    )
    df = df.withColumn("decision", ladder)
    ambiguous = (F.col("decision") == "NEEDS_MORE_INFO") & (score >= p.needs_info_threshold) & (score < p.bridge_threshold)
    df = df.withColumns({
        "confidence": _confidence(p),
        "evidence_quality_score": quality_score(p),
        "equivalency_score": F.greatest(F.lit(0), F.least(F.lit(100), score)),
        "missing_info_requests": F.concat("_asks", F.when(ambiguous, F.array(F.lit(AMBIGUOUS_REQUEST)))
                                          .otherwise(F.array().cast("array<string>"))),
    })
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def _confidence(p: Policy) -> Column:
    """100 less penalties for unknown fields, missing information and nearness to a band edge."""
    unknown = sum((F.col(c).cast("int") for c in ("_credits_unknown", "_lab_unknown", "_topics_unknown",
                                                  "_outcomes_unknown")), F.lit(0))
    base = F.lit(100) - unknown * 12 - F.col("info_missing_gaps") * 10

    def edge(margin: Column) -> Column:
        return F.when(margin < 3, 30).when(margin < 5, 20).when(margin < 10, 10).otherwise(0)

    decision = F.col("decision")
    conf = (
        F.when(decision == "APPROVE", base - edge(F.col("_score") - p.approve_threshold))
        .when(decision == "APPROVE_WITH_BRIDGE", F.least(base, F.lit(65)))
        .when((decision == "DENY") & (F.col("hard_gaps") == 0), base - edge(F.lit(p.needs_info_threshold) - F.col("_score")))
        .otherwise(base)
    )
    return F.when(decision == "NEEDS_MORE_INFO", "LOW").when(conf >= 75, "HIGH").when(conf >= 45, "MEDIUM").otherwise("LOW")


def _grade_rule(p: Policy):
    """Veto below the least grade."""
    if not p.min_grade:
        return [], [], []
    grade, cites = F.col("grade"), F.col("grade_cites")
    unknown = F.col("grade_unknown") | grade.isNull() | (grade == "")
    floor = X.GRADE_ORDER.index(p.min_grade.strip().upper().replace(" ", "")) \
        if p.min_grade.strip().upper().replace(" ", "") in X.GRADE_ORDER else None
    gaps = [_gap(unknown, f"Minimum grade policy is set ({p.min_grade}) but source grade is unknown.", "INFO_MISSING", cites)]
    asks = [_ask(unknown, "Provide the grade achieved in the source course (transcript).")]
    if floor is None:
        return gaps, [], asks
    rank = X.grade_rank(grade)
    gaps += [
        _gap(~unknown & rank.isNull(), _text("Source grade ('", grade, "') could not be parsed on the letter-grade scale."),
             "INFO_MISSING", cites),
        _gap(~unknown & (rank > floor), _text("Grade (", grade, f") does not meet minimum policy ({p.min_grade})."), "HARD", cites),
    ]
    asks.append(_ask(~unknown & rank.isNull(), "Provide grade in a standard letter format (A, B+, C-, etc.)."))
    return gaps, [_reason(~unknown & (rank <= floor), _text("Grade (", grade, f") meets the minimum policy ({p.min_grade})."), cites)], asks


def _hours(p: Policy) -> dict[str, Column]:
    """Known contact hours summed; a known but unreadable value makes the total null."""
    if p.min_contact_hours <= 0:
        return {}
    out, known = {}, {}
    for f in ("contact_hours_lecture", "contact_hours_lab"):
        known[f] = ~F.col(f"{f}_unknown") & F.col(f).isNotNull()
        out[f] = F.when(~known[f] | (F.col(f) == ""), F.lit(0)).otherwise(X.strict_int(F.col(f)))
    lec, lab = out["contact_hours_lecture"], out["contact_hours_lab"]
    return {"_hours_known": known["contact_hours_lecture"] | known["contact_hours_lab"], "_hours": lec + lab}


def _hours_rule(p: Policy):
    """Veto below the contact-hour floor."""
    if p.min_contact_hours <= 0:
        return [], [], []
    known, hours = F.col("_hours_known"), F.col("_hours")
    cites = F.concat("contact_hours_lecture_cites", "contact_hours_lab_cites")
    bad = known & hours.isNull()
    floor = p.min_contact_hours
    return [
        _gap(~known, f"Minimum contact hours policy is set ({floor}h) but source contact hours are unknown.", "INFO_MISSING", cites),
        _gap(known & (hours < floor), _text("Contact hours (", hours, f"h) below minimum policy ({floor}h)."), "HARD", cites),
        _gap(bad, "Contact hours could not be parsed as numbers.", "INFO_MISSING", cites),
    ], [
        _reason(known & (hours >= floor), _text("Contact hours (", hours, f"h) meet the minimum policy ({floor}h)."), cites),
    ], [
        _ask(~known, "Provide contact hours (lecture and/or lab) for the source course."),
        _ask(bad, "Provide contact hours in a clear numeric format."),
    ]


def _age_rule(p: Policy, current_year: int):
    """Veto for a course taken too long ago."""
    if p.max_course_age_years <= 0:
        return [], [], []
    taken, cites, limit = F.col("term_taken"), F.col("term_taken_cites"), p.max_course_age_years
    unknown = F.col("term_taken_unknown") | taken.isNull() | (taken == "")
    age = F.lit(current_year) - X.term_year(taken)
    bad = ~unknown & age.isNull()
    return [
        _gap(unknown, f"Course expiration policy is set ({limit} years) but source term is unknown.", "INFO_MISSING", cites),
        _gap(bad, _text("Term taken ('", taken, "') could not be parsed to a year."), "INFO_MISSING", cites),
        _gap(~unknown & (age > limit), _text("Source course is ", age, f" years old; policy maximum is {limit} years."), "HARD", cites),
    ], [
        _reason(~unknown & (age <= limit), _text("Source course is ", age, f" years old, within the {limit}-year limit."), cites),
    ], [
        _ask(unknown, "Provide the term/year the source course was taken (transcript)."),
        _ask(bad, "Provide term in a recognizable format (e.g., 'Fall 2022')."),
    ]


def _must_missing(p: Policy) -> Column:
    must = F.array(*[F.lit(t) for t in p.must_include_topics]).cast("array<string>")
    return _items(split_matches(_keyed(must), F.col("_found_topics")), False)


def _mandatory_rule(p: Policy):
    """Veto when a policy topic is absent."""
    if not p.must_include_topics:
        return [], [], []
    unknown, missing, cites = F.col("_topics_unknown"), F.col("_must_missing"), F.col("topics_cites")
    return [
        _gap(unknown, "Mandatory topics policy is set but source topics are unknown.", "INFO_MISSING", cites),
        _gap(~unknown & (F.size(missing) > 0),
             _text("Missing mandatory policy topics: ", F.array_join(missing, ", "), "."), "HARD", cites),
    ], [
        _reason(~unknown & (F.size(missing) == 0),
                f"All mandatory policy topics present ({len(p.must_include_topics)}).", cites),
    ], []


def missing_evidence(policy: Policy) -> Column:
    """Messages of the check made before scoring."""
    no_credits = F.col("credits_unknown") | F.col("credits").isNull() | (F.col("credits") == "") \
        if policy.require_credits_known else F.lit(False)

    def absent(f: str) -> Column:
        return F.col(f"{f}_unknown") | F.col(f).isNull() | (F.size(f) == 0)

    no_content = absent("topics") & absent("outcomes") if policy.require_topics_or_outcomes else F.lit(False)
    return F.array_compact(F.array(
        F.when(no_credits, F.lit("Missing source course credits.")),
        F.when(no_content, F.lit("Missing source course topics and learning outcomes.")),
    ))


def decide_checked(cases: DataFrame, policy: Policy, current_year: int) -> DataFrame:
    """Decisions with the pre-check in front: missing evidence gives a synthetic NEEDS_MORE_INFO."""
    df = decide(cases, policy, current_year).withColumn("_missing", missing_evidence(policy))
    stop = F.size("_missing") > 0
    as_gap = F.transform("_missing", lambda m: F.struct(
        m.alias("text"), F.lit(None).cast("string").alias("severity"), no_chunks().alias("citations")).cast(GAP))
    return df.withColumns({
        "decision": F.when(stop, "NEEDS_MORE_INFO").otherwise(F.col("decision")),
        "equivalency_score": F.when(stop, 0).otherwise(F.col("equivalency_score")),
        "confidence": F.when(stop, "LOW").otherwise(F.col("confidence")),
        "evidence_quality_score": F.when(stop, 0).otherwise(F.col("evidence_quality_score")),
        "gaps": F.when(stop, as_gap).otherwise(F.col("gaps")),
        "reasons": F.when(stop, F.array().cast(f"array<{REASON}>")).otherwise(F.col("reasons")),
        "bridge_plan_items": F.when(stop, F.array().cast(f"array<{BRIDGE}>")).otherwise(F.col("bridge_plan_items")),
        "missing_info_requests": F.when(stop, F.col("_missing")).otherwise(F.col("missing_info_requests")),
        "needs_more_info": stop | (F.col("decision") == "NEEDS_MORE_INFO"),
    }).drop("_missing", "hard_gaps", "fixable_gaps", "info_missing_gaps", "bridge_items")


def explanation(decision: Column) -> Column:
    """One sentence on why."""
    out = F.lit(NO_EXPLANATION)
    for name, text in EXPLANATIONS.items():
        out = F.when(decision == name, text).otherwise(out)
    return out


def display_decision(decision: Column, severities: Column, bridge_plan: Column) -> Column:
    """APPROVE is shown as APPROVE_WITH_BRIDGE when something has to be bridged."""
    bridged = (F.size(bridge_plan) > 0) | F.exists(severities, lambda s: s == "FIXABLE")
    return F.when((decision == "APPROVE") & bridged, "APPROVE_WITH_BRIDGE").otherwise(decision)


def packet_hash(*fields: str) -> Column:
    """sha256 of the canonical JSON of ``fields``: keys in order, nulls written."""
    return F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256)


def changed_only(packets: DataFrame, runs: DataFrame) -> DataFrame:
    """Packets whose latest completed run has another input hash or extraction run."""
    from casemill.operators.common import newest_per

    done = newest_per(runs.filter(F.col("status") == "completed"), ["request_id"], ["created_at", "decision_run_id"])
    return packets.join(done.select("request_id", "inputs_hash", "extraction_run_id"),
                        ["request_id", "inputs_hash", "extraction_run_id"], "left_anti")


def evaluation_report(decided: DataFrame, expected: DataFrame) -> DataFrame:
    """Per case: expected and actual decision, agreement, score, confidence, quality and gap counts.

    ``decided`` comes from :func:`decide`; ``expected`` has request_id and expected, null where nobody labeled the case.
    """
    rows = decided.join(expected.select("request_id", "expected"), "request_id", "left")
    return rows.select(
        "request_id", "expected", F.col("decision").alias("actual"), (F.col("expected") == F.col("decision")).alias("agrees"),
        "equivalency_score", "confidence", "evidence_quality_score", "hard_gaps", "fixable_gaps", "info_missing_gaps", "bridge_items")


def agreement(results: DataFrame, expected: str = "expected", actual: str = "actual") -> DataFrame:
    """Labeled cases, agreements and the share of agreement; unlabeled cases do not count."""
    labeled = F.col(expected).isNotNull()
    same = labeled & (F.col(expected) == F.col(actual))
    return results.agg(
        F.count(F.lit(1)).alias("n_cases"), F.count_if(labeled).alias("n_labeled"), F.count_if(same).alias("n_agree"),
        F.round(F.count_if(same) / F.nullif(F.count_if(labeled), F.lit(0)), 4).alias("agreement"),
    )
