"""Work that grows with its tables is dealt to as many tasks, and nothing that grows is sent to every task."""

import os

from pyspark.sql import functions as F

from casemill.functions import scan as S
from casemill.operators import cases as C
from casemill.operators import chunks as K
from casemill.operators import common, matching as M, transcript as T
from casemill.session import ARROW_ROWS
from casemill.sources import readers, writers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_citations_send_no_table_to_every_task(spark):
    pages = spark.createDataFrame([(1, 1, "4 credit"), (1, 2, "none"), (2, 1, "none")], "doc_id int, page_num int, text string")
    facts = spark.createDataFrame([(1, "credits_or_units", "4 Credit"), (2, "title", "x")], "doc_id int, fact_key string, fact_value string")
    out = K.cite_facts(facts, pages, pages.select("doc_id", "page_num"))
    assert "Broadcast" not in plan(out)
    assert sorted((r.doc_id, r.fact_key, r.page_num) for r in out.collect()) == [(1, "credits_or_units", 1), (2, "title", 1)]


def test_transcript_pages_are_dealt_by_the_size_of_their_texts(spark, monkeypatch):
    rows = [(d, p, f"Fall 2022\nMATH 1530 Algebra and more {p} 4 hours\nB") for d in range(40) for p in (1, 2)]
    pages = spark.createDataFrame(rows, "doc_id int, page_num int, text string")
    few = sorted(map(tuple, T.transcript_courses(pages).collect()))
    monkeypatch.setattr(common, "CHARS_PER_TASK", 1000)
    assert common.text_tasks(pages) == 1 + sum(len(r[2]) + 100 for r in rows) // 1000
    many = T.transcript_courses(pages)
    assert "Broadcast" not in plan(many) and f", {common.text_tasks(pages)}), REPARTITION_BY_NUM" in plan(many)
    assert len(few) == 80 and sorted(map(tuple, many.collect())) == few


def case_tables(spark):
    requests = spark.range(5).select(F.col("id").alias("request_id"), F.lit("new").alias("status"))
    documents = spark.range(20).select((F.col("id") % 7).alias("request_id"), F.lit("2024-01-01").alias("created_at"), F.col("id").alias("doc_id"), F.lit("f").alias("filename"))
    evidence = documents.select("request_id", F.col("doc_id").alias("ordinal"), F.col("doc_id").cast("string").alias("evidence_id"))
    decision = requests.select("request_id", F.col("request_id").alias("decision_run_id"))
    audit = documents.select("request_id", F.col("created_at").alias("at"), F.lit("VOTE").alias("kind"), F.col("doc_id").alias("ref_id"))
    return requests, documents, evidence, decision, audit


def test_case_details_send_no_case_list_to_every_task(spark, monkeypatch):
    monkeypatch.setattr(common.tasks_for, "__kwdefaults__", {"rows": 10})
    out = C.case_detail(*case_tables(spark))
    assert "Broadcast" not in plan(out)
    assert out.filter("request_id > 4").count() == 0 and out.count() == 10 + 3 * sum(r % 7 < 5 for r in range(20))


def test_case_objects_have_tasks_by_their_rows(spark, monkeypatch):
    parts = C.case_parts(*case_tables(spark))
    usual = sorted(map(str, C.case_objects(parts, 4).collect()))
    monkeypatch.setattr(C, "ROWS_PER_TASK", 10)
    out = C.case_objects(parts, 4)
    n = 1 + parts.count() // 10
    assert f"hashpartitioning(request_id#" in plan(out) and f", {n}), REPARTITION_BY_NUM" in plan(out)
    assert sorted(map(str, out.collect())) == usual


def test_cases_are_made_once_for_their_items(spark):
    cases = spark.createDataFrame([(1, ["algebra"], ["Algebra", "x"])], "request_id int, need array<string>, have array<string>")
    made = spark.sparkContext.accumulator(0)

    def count(rows):
        for batch in rows:
            made.add(batch.num_rows)
            yield batch

    out = M.with_hits(cases.mapInArrow(count, cases.schema), {"topic": ("need", "have")})
    assert out.first()["_topic_hits"][0].hit and made.value == 1


def test_scanned_texts_go_to_python_in_small_batches(spark):
    spark.conf.set(ARROW_ROWS, "10000")
    df = spark.createDataFrame([("ｆｉne",), ("plain",), (None,)], "text string")
    assert [r[0] for r in df.select(S.scan_form(F.col("text"))).collect()] == ["fine", "plain", ""]
    assert spark.conf.get(ARROW_ROWS) == "1000"


def test_files_of_case_folders_are_written_and_counted_in_tasks(spark, tmp_path):
    path = str(tmp_path / "files")
    rows = [(f"case={i // 2}", f"text {i}") for i in range(9)] + [("case=__HIVE_DEFAULT_PARTITION__", "")]
    writers.write_files(spark.createDataFrame(rows, "folder string, text string"), path, groups=3)
    texts = [open(os.path.join(at, n)).read() for at, _, names in os.walk(path) for n in names]
    assert sorted(texts) == sorted(t for _, t in rows)
    (tmp_path / "files" / "_hidden").mkdir()
    for n in "ab":
        (tmp_path / "files" / "_hidden" / f"{n}.txt").write_text("")
    assert sorted(map(tuple, readers.case_folders(spark, path, 2, "*.txt").collect())) == [(f"case={i}", 2) for i in range(4)]
    assert readers.case_folders(spark, path, 2, "*.pdf").count() == 0


def test_payloads_on_lines_are_read_by_their_key(spark, tmp_path):
    path = str(tmp_path / "lines")
    body = '{"request_id":%d,"_target_course_requested":"A\\nB","facts":[{"factType":"course","factKey":"k%d"},{"factKey":"z"}]}'
    spark.createDataFrame([(body % (i, i),) for i in range(50)], "value string").coalesce(2).write.text(path)
    cases, facts = readers.read_payloads(spark, path, key="request_id LONG")
    assert sorted((r.request_id, r.course_requested) for r in cases.collect()) == [(i, "A\nB") for i in range(50)]
    assert [(r.ordinal, r.fact_key) for r in facts.filter("request_id = 7").orderBy("ordinal").collect()] == [(0, "k7"), (1, "z")]
