import json
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from casemill import schemas
from casemill.operators import cases as C
from casemill.operators.decision import Policy
from casemill.sources import buckets as B
from casemill.sources import readers, writers
from casemill.streaming import jobs as J


def test_catalog_csv_import(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text('course_code,title,subject,credits_min,prerequisites,description\nA 1,"Title, one",A,2.0,,"line one\nline two"\n'
                    'A 1,Again,A,9,,\nB 2,,,x,Need A,\n,No code,,,,\nOLD 1,Old,O,1,,\n')
    rows = readers.read_csv(spark, str(path), schemas.COURSE_CSV)
    known = spark.createDataFrame([("OLD 1",)], "course_code STRING")
    got = {r.course_code: r for r in C.import_courses(known, rows, "place").collect()}
    assert sorted(got) == ["A 1", "B 2"]
    assert got["A 1"].display_name == "Title, one" and got["A 1"].credits == 2 and got["A 1"].description == "line one\nline two"
    assert (got["B 2"].display_name, got["B 2"].department, got["B 2"].credits) == ("B 2", "General", 3)


def test_outcomes_last_row_wins(spark, tmp_path):
    path = tmp_path / "o.csv"
    path.write_text("course_code,learning_outcomes\nA 1,first\nA 1, second \n")
    rows = readers.read_csv(spark, str(path), schemas.OUTCOME_CSV)
    courses = spark.createDataFrame([("A 1",), ("B 2",)], "course_code STRING")
    assert sorted(tuple(r) for r in C.with_outcomes(courses, rows, "place").collect()) == [("A 1", "second"), ("B 2", "")]


def test_policy_and_profiles(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"approve_threshold": 85, "min_grade": None, "must_include_topics": ["x"]}))
    assert readers.read_policy(spark, str(tmp_path / "p.json")) == Policy(approve_threshold=85, must_include_topics=("x",))
    with pytest.raises(ValueError):
        readers.policy_from({"aprove": 1})
    (tmp_path / "t.json").write_text(json.dumps({"code": "A-1", "target_credits": 4, "required_topics": ["x"]}))
    assert readers.read_profiles(spark, str(tmp_path / "t.json")).first().required_topics == ["x"]


def test_case_folders_and_inventory(spark, tmp_path):
    for name in ("one/a.pdf", "one/b.pdf", "two/a.pdf", "two/b.txt"):
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True)
        f.write_bytes(b"%PDF" + name.encode())
    assert [tuple(r) for r in readers.case_folders(spark, str(tmp_path)).collect()] == [("one", 2)]
    files = {r.filename: r.size_bytes for r in readers.file_inventory(spark, str(tmp_path), "*.txt").collect()}
    assert files == {"b.txt": 13}


def test_written_tables_and_manifest(spark, tmp_path):
    df = spark.range(10).withColumn("run", F.col("id") % 2)
    assert writers.write_table(df, str(tmp_path / "t"), "csv") == 10
    assert spark.read.csv(str(tmp_path / "t"), header=True).count() == 10
    with pytest.raises(ValueError):
        writers.write_table(df.filter("id < 0"), str(tmp_path / "e"))
    rows = writers.manifest({"chunks": df, "pages": df.filter("id < 3")}, "run").orderBy("run").collect()
    assert rows[0].manifest == '{"run":0,"chunks":5,"pages":2}' and len(rows[0].manifest_sha256) == 64


def test_log_lines_survive(spark, tmp_path):
    (tmp_path / "x.log").write_text('{"a":1}\n{broken\n')
    assert [(r.file_name, r.line) for r in readers.read_log(spark, str(tmp_path)).collect()] == [("x.log", '{"a":1}'), ("x.log", "{broken")]


def test_event_log_appends_and_streams(spark, tmp_path):
    events = spark.sql("SELECT TIMESTAMP '2024-01-01 00:00:00.123456' AS ts, 'StatusChange' AS event, '7' AS request_id")
    writers.append_events(events, str(tmp_path / "in"))
    J.run_to_table(J.read_events(spark, str(tmp_path / "in")), str(tmp_path / "out")).awaitTermination()
    writers.append_events(events, str(tmp_path / "in"))
    J.run_to_table(J.read_events(spark, str(tmp_path / "in")), str(tmp_path / "out")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out" / "data")).collect()
    assert len(rows) == 2 and rows[0].ts.microsecond == 123456


VOTE_ROWS = "request_id LONG, review_cycle INT, kind STRING, person LONG, action STRING, at TIMESTAMP, ref_id LONG"


def vote_rows(spark, rows):
    return spark.createDataFrame([(*r[:5], datetime(2024, 1, 1) + timedelta(minutes=r[5]), r[6]) for r in rows], VOTE_ROWS)


def run_votes(spark, tmp_path, rows, keep="30 days"):
    """One more run of the stream from its checkpoint; the tally and refused votes after it."""
    vote_rows(spark, rows).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(VOTE_ROWS).parquet(str(tmp_path / "in"))
    J.run_updates(J.vote_results(stream, "1 hour", keep), str(tmp_path / "out"), "append").awaitTermination()
    tallies = {(r.request_id, r.review_cycle): (r.n_votes, r.n_rejected, r.n_members, r.complete, r.final_decision)
               for r in J.latest_tallies(spark, str(tmp_path / "out")).collect()}
    return tallies, {(r.person, r.ref_id, r.reason) for r in J.refused_votes(spark, str(tmp_path / "out")).collect()}


def test_second_vote_is_refused_in_the_stream_over_restarts(spark, tmp_path):
    seats = [(1, 1, "member", p, None, 0, p) for p in (5, 6)]
    tally, refused = run_votes(spark, tmp_path, seats + [(1, 1, "vote", 5, "deny", 10, 10)])
    assert tally == {(1, 1): (1, 0, 2, False, None)} and refused == set()
    # The second vote of 5 is refused where it is seen, the vote of 9, who has no seat, is not counted.
    tally, refused = run_votes(spark, tmp_path, [(1, 1, "vote", 5, "approve", 12, 11), (1, 1, "vote", 9, "approve", 12, 13)])
    assert tally == {(1, 1): (1, 2, 2, False, None)} and refused == {(5, 11, "second vote")}
    # The decision falls with the last vote; an earlier vote of 5 that comes late takes the place of the first.
    tally, refused = run_votes(spark, tmp_path, [(1, 1, "vote", 6, "approve", 15, 12), (1, 1, "vote", 5, "approve", 5, 9)])
    assert tally == {(1, 1): (2, 3, 2, True, "approve")} and refused == {(5, 11, "second vote"), (5, 10, "second vote")}
    assert spark.conf.get(J.PROVIDER, "none").endswith("HDFSBackedStateStoreProvider") or spark.conf.get(J.PROVIDER, "none") == "none"


def test_closed_cycles_leave_the_state(spark, tmp_path):
    day = 24 * 60
    run_votes(spark, tmp_path, [(1, 1, "member", 5, None, 0, 5), (1, 1, "vote", 5, "deny", 1, 10), (1, 1, "vote", 8, "deny", 2, 18)], "2 days")
    # Ten days later the watermark has passed the cycle; the batch after that drops its state and refuses the vote without a seat.
    run_votes(spark, tmp_path, [(2, 1, "member", 6, None, 10 * day, 6)], "2 days")
    tally, refused = run_votes(spark, tmp_path, [(2, 1, "vote", 6, "approve", 10 * day + 1, 12)], "2 days")
    assert tally[2, 1] == (1, 0, 1, True, "approve") and tally[1, 1] == (1, 1, 1, True, "deny")
    assert refused == {(8, 18, "no seat")}
    state = spark.read.format("statestore").option("operatorId", 1).option("stateVarName", "seat").load(str(tmp_path / "out" / "checkpoint"))
    assert {r.key.request_id for r in state.collect()} == {2}


def test_status_state_goes_and_updates_are_compacted(spark, tmp_path):
    def run(rows):
        df = spark.createDataFrame([(k, e, datetime(2024, 1, 1) + timedelta(days=d)) for k, e, d in rows], "k LONG, e STRING, at TIMESTAMP")
        df.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        J.run_updates(J.current_status(stream, "k", "e", "at", "1 day", "10 days"), str(tmp_path / "out")).awaitTermination()
        return {r.k: r.status for r in J.latest_updates(spark, str(tmp_path / "out"), ["k"]).collect()}

    assert run([(1, "a", 0), (1, "b", 2), (2, "a", 1)]) == {1: "b", 2: "a"}
    assert run([(1, "old", 2 - 1), (2, "c", 3)]) == {1: "b", 2: "c"}
    J.compact_updates(spark, str(tmp_path / "out"), ["k"])
    assert run([(3, "x", 60)]) == {1: "b", 2: "c", 3: "x"}
    assert run([(3, "y", 61)]) == {1: "b", 2: "c", 3: "y"}
    state = spark.read.format("statestore").option("stateVarName", "newest").load(str(tmp_path / "out" / "checkpoint"))
    assert {r.key.key for r in state.collect()} == {3}
    J.compact_updates(spark, str(tmp_path / "out"), ["k"])
    assert {r.k: r.status for r in J.latest_updates(spark, str(tmp_path / "out"), ["k"]).collect()} == {1: "b", 2: "c", 3: "y"}
    assert len(J._folders(spark, str(tmp_path / "out" / "snapshot"), "upto")) == 2


def test_only_touched_buckets_are_written(spark, tmp_path):
    path, key = str(tmp_path / "t"), ["k"]
    B.write_buckets(spark.range(200).selectExpr("id AS k", "'a' AS v"), path, key, 16)
    files = lambda: {str(f.relative_to(path)): f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    before = files()
    new = spark.createDataFrame([(3, "B"), (1000, "C")], "k LONG, v STRING")
    numbers = B.touched(new, key, 16)
    job = lambda old, more: C.upsert(old, more, ["k"], ["v"])
    assert B.change_buckets(spark, path, new, key, 16, job) == numbers and len(numbers) <= 2
    same = lambda a, b: {f: t for f, t in a.items() if int(f.split("=")[1].split("/")[0]) not in numbers} == {
        f: t for f, t in b.items() if int(f.split("=")[1].split("/")[0]) not in numbers}
    assert same(before, files())
    want = {**{k: "a" for k in range(200)}, 3: "B", 1000: "C"}
    table = lambda: dict(B.read_buckets(spark, path).collect())
    assert table() == want
    B.change_buckets(spark, path, new, key, 16, job)
    assert table() == want and same(before, files()), "a repeated run changes nothing"
    assert B.change_buckets(spark, path, new.filter("k < 0"), key, 16, job) == []
    asked = B.rows_of_keys(spark, path, new.filter("k = 3"), key, 16)
    assert asked.collect() == [(3, "B")] and re.search(r"PartitionFilters: \[[^\]]*_bucket#\d+ = ", asked._jdf.queryExecution().executedPlan().toString())


def test_pages_of_a_listing(spark, tmp_path):
    rows = [(i * 7919 % 5003, i % 9) for i in range(5000)]
    df = spark.createDataFrame(rows, "k LONG, g INT")
    path, order = str(tmp_path / "l"), ["g", "k"]
    C.write_listing(df, order, path, 300)
    want = sorted((g, k) for k, g in rows)
    for number in (1, 2, 13, 200, 500, 501):
        page = C.page(spark, path, order, number, 10)
        assert [(r.g, r.k) for r in page.collect()] == want[(number - 1) * 10:number * 10]
        assert number > 500 or re.search(r"PartitionFilters: \[[^\]]*_range#\d+ (=|IN)", page._jdf.queryExecution().executedPlan().toString())
    assert C.page(spark, path, order, 1000, 10).count() == 0
    last = None
    for number in range(3):
        shown = C.page_after(df, order, last, 700).collect()
        assert [(r.g, r.k) for r in shown] == want[number * 700:(number + 1) * 700]
        last = [shown[-1].g, shown[-1].k]


def test_case_objects_are_whole_or_in_ordered_chunks(spark):
    rows = [(1, 0, None, None, "1", "{}"), (1, 2, None, 4, "e4", "x"), (1, 2, None, 3, "e3", "x")]
    rows += [(2, 4, datetime(2024, 1, 1) + timedelta(minutes=i * 37 % 100), None, f"a{i}", "y") for i in range(100)] + [(2, 0, None, None, "2", "{}")]
    df = spark.createDataFrame(rows, "request_id LONG, place INT, at TIMESTAMP, seq LONG, ref_id STRING, body STRING").repartition(5)
    out = {(r.request_id, r.chunk): r for r in C.case_objects(df, 8).collect()}
    assert [x.ref_id for x in out[1, 0].evidence_rows] == ["e3", "e4"] and [x.ref_id for x in out[1, 0].case_rows] == ["1"]
    assert (out[1, 0].n_chunks, out[1, 0].n_parts, len(out)) == (1, 3, 14)
    large = [out[2, c] for c in range(13)]
    assert [r.n_chunks for r in large] == [13] * 13 and [x.ref_id for x in large[0].case_rows] == ["2"]
    seen = [x.ref_id for r in large for x in r.audit_rows]
    assert seen == [f"a{i}" for i in sorted(range(100), key=lambda i: i * 37 % 100)]
    assert max(len(r.audit_rows) + len(r.case_rows) for r in large) == 8


def test_repeated_packets_are_dropped(spark, tmp_path):
    df = spark.sql("SELECT 1L AS request_id, 'h' AS inputs_hash, TIMESTAMP '2024-01-01' AS ts UNION ALL SELECT 1L, 'h', TIMESTAMP '2024-01-01' UNION ALL SELECT 1L, 'g', TIMESTAMP '2024-01-01'")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    J.run_to_table(J.once_per_input(stream, "ts"), str(tmp_path / "out")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "data")).count() == 2


def test_upsert_and_patch(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k LONG, v STRING")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k LONG, v STRING")
    assert sorted(tuple(r) for r in C.upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, "b"), (3, "C")]
    assert sorted(tuple(r) for r in C.upsert(old, new, ["k"], ["v"]).collect()) == [(1, "a"), (2, "B"), (3, "C")]
    cleared = C.patch(old, spark.createDataFrame([(1, "")], "k LONG, v STRING"), "k", ("v",))
    assert sorted(tuple(r) for r in cleared.collect()) == [(1, None), (2, "b")]
