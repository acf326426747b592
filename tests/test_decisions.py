import json

import pytest
from payloads import CASES, DEFAULTS, PROFILES, SHIPPED
from pyspark.sql import functions as F

from casemill import schemas
from casemill.operators import decision as D
from casemill.operators import evidence as E
from casemill.sources import readers


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("payloads")
    for name, (target, facts) in CASES.items():
        (root / f"{name}.json").write_text(json.dumps({"_target_course_requested": target, "facts": facts}))
    return str(root)


def wide(spark, folder):
    cases, facts = readers.read_payloads(spark, folder)
    profiles = spark.createDataFrame(PROFILES, schemas.PROFILE.replace("display_name STRING, ", ""))
    return D.with_target(E.pivot_facts(facts).join(cases, "request_id"), profiles)


def outcome(df):
    rows = df.select("request_id", "decision", "equivalency_score", "confidence", "evidence_quality_score", "hard_gaps",
                     "info_missing_gaps", "bridge_items").collect()
    return {r[0]: tuple(r[1:]) for r in rows}


def test_shipped_policy_goldens(spark, folder):
    assert outcome(D.decide(wide(spark, folder), D.SHIPPED_POLICY, 2026)) == SHIPPED


def test_class_default_goldens(spark, folder):
    assert outcome(D.decide(wide(spark, folder), D.Policy(), 2026)) == DEFAULTS


def test_precheck_asks_for_missing_evidence(spark, folder):
    rows = D.decide_checked(wide(spark, folder), D.Policy(), 2026).select(
        "request_id", "decision", "equivalency_score", "confidence", "missing_info_requests").collect()
    stopped = {r.request_id: r for r in rows if r.confidence == "LOW"}
    assert sorted(stopped) == ["case02", "case03", "case09"]
    assert all(r.decision == "NEEDS_MORE_INFO" and r.equivalency_score == 0 for r in stopped.values())
    assert stopped["case09"].missing_info_requests == [
        "Missing source course credits.", "Missing source course topics and learning outcomes."]


def evidence(spark, **changes):
    base = dict(
        request_id="r", credits="3", contact_hours_lecture="45", contact_hours_lab="0", lab_component="false",
        topics=["recursion basics", "arrays", "functions", "loops", "sorting"], outcomes=["write code", "debug code", "test code"],
        assessments=["exam", "project"], grade="A", term_taken="Fall 2024", target_credits=3, target_lab_required=False,
        required_topics=[], required_outcomes=[])
    base.update(changes)
    schema = ", ".join(f"{k} {'ARRAY<STRING>' if isinstance(v, list) else 'INT' if k == 'target_credits' else 'BOOLEAN' if isinstance(v, bool) else 'STRING'}"
                       for k, v in base.items())
    df = spark.createDataFrame([tuple(base.values())], schema)
    return df.select("*", *[F.col(f).isNull().alias(f"{f}_unknown") for f in E.FIELDS],
                     *[F.array().cast("array<string>").alias(f"{f}_cites") for f in E.FIELDS])


def gaps(df, policy, year=2026):
    row = D.decide(df, policy, year).first()
    return {(g.severity, g.text) for g in row.gaps}, row


def has(found, severity, text):
    return any(s == severity and text in t for s, t in found)


def test_rule_checks(spark):
    assert has(gaps(evidence(spark, grade="D+"), D.Policy(min_grade="C"))[0], "HARD", "does not meet minimum")
    assert has(gaps(evidence(spark, contact_hours_lecture="30"), D.Policy(min_contact_hours=45))[0], "HARD", "below minimum")
    assert has(gaps(evidence(spark, term_taken="Fall 2016"), D.Policy(max_course_age_years=5))[0], "HARD", "years old")
    assert has(gaps(evidence(spark, topics=["loops"]), D.Policy(must_include_topics=("recursion",)))[0], "HARD", "mandatory policy topics")
    found, row = gaps(evidence(spark, target_lab_required=True), D.Policy())
    assert has(found, "FIXABLE", "lab")
    assert [b.remediation_type for b in row.bridge_plan_items] == ["lab"]


def test_partial_match_lists_what_is_missing(spark):
    _, row = gaps(evidence(spark, required_topics=["arrays", "sorting", "graphs", "hash tables"],
                           required_outcomes=["write code", "prove theorems"]), D.Policy())
    assert [b.addresses_gap for b in row.bridge_plan_items] == ["topic_missing:graphs", "topic_missing:hash tables", "outcome_missing:prove theorems"]


@pytest.mark.parametrize("matched,total,points", [(9, 16, 22), (1, 8, 5), (3, 16, 8), (5, 16, 12)])
def test_points_round_half_to_even(spark, matched, total, points):
    need = [f"topic{chr(97 + i)}{i:02d}" for i in range(total)]
    row = D.decide(evidence(spark, topics=need[:matched], required_topics=need), D.Policy(), 2026).first()
    assert row.topic_points == points


def test_strict_number_text_and_substring_match(spark):
    found, row = gaps(evidence(spark, credits="3.0", topics=["Basic Circuits"], required_topics=["c"]), D.Policy())
    assert has(found, "INFO_MISSING", "could not be parsed") and row.topic_points == 40


def test_strict_info_flag(spark):
    df = evidence(spark, credits="three")
    assert D.decide(df, D.Policy(), 2026).first().decision == "APPROVE_WITH_BRIDGE"
    assert D.decide(df, D.Policy(strict_info=True), 2026).first().decision == "NEEDS_MORE_INFO"


def test_packet_hash_writes_nulls_and_sorts_keys(spark):
    df = spark.createDataFrame([(1, None)], "b INT, a STRING").select(D.packet_hash("b", "a").alias("h"))
    import hashlib
    assert df.first().h == hashlib.sha256(b'{"a":null,"b":1}').hexdigest()


def test_agreement_counts_labeled_only(spark):
    df = spark.createDataFrame([("APPROVE", "APPROVE"), ("DENY", "APPROVE"), (None, "DENY")], "expected STRING, actual STRING")
    assert tuple(D.agreement(df).first()) == (3, 2, 1, 0.5)


def test_dictionary_of_pairs_equals_the_row_rule(spark):
    import random

    rnd = random.Random(13)
    parts = ["graph", "graphs", "sorting", "of", "the", "c", "ab", "trees", "class", "hash", "tables", "data", "x1", "É", ""]
    item = lambda: " ".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 6))).strip() + rnd.choice(["", " ", "."])
    rows = [(i, [item() for _ in range(rnd.randrange(0, 5))], [item() for _ in range(rnd.randrange(0, 5))] if i % 9 else None) for i in range(150)]
    df = spark.createDataFrame(rows, "request_id LONG, need ARRAY<STRING>, have ARRAY<STRING>")
    from casemill.functions import text as X
    from casemill.operators import matching as M

    want = df.select("request_id", D.split_matches(D._keyed(F.col("need")), D._keyed(X.norm_list(F.col("have")))).alias("h"))
    key = lambda out, c: {r.request_id: [tuple(x) for x in r[c]] for r in out.collect()}
    got = key(M.with_hits(df, {"topic": ("need", "have")}), "_topic_hits")
    assert got == key(want, "h") and any(h for hits in got.values() for _, h in hits)
    assert M.with_hits(df.filter("request_id < 0"), {"topic": ("need", "have")}).count() == 0
