import os
import re

import pytest
from llm_cases import near_duplicate_classes

import corpus_pipeline
from casemill.llm.common import table

SF = "/root/testdata/sf0.001"


PLACED = ("doc_id", "piece", "start", "length", "ids_crc32")


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*PLACED).collect()), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver data not present")
def test_stages_take_effect_and_run_equals_them(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    counts = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        path = str(tmp_path / str(k))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            assert docs.subtract(before).count() == 0
        if name == "exact dedup":
            norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in before.collect()]
            assert docs.count() == len(set(norm))
        if name == "n-gram Jaccard join":
            classes = near_duplicate_classes([(r["doc_id"], r["text"]) for r in before.collect()])
            assert {r["doc_id"] for r in docs.collect()} == {c for _, _, c in classes}
            left = {r["doc_id"] for r in docs.collect()}
    assert counts[0] > counts[1] >= counts[2] >= counts[3] >= counts[4] > 0
    assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == left
    assert rows_of(corpus_pipeline.run(spark, SF)) == rows_of(docs)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver data not present")
def test_no_documents(spark, tmp_path):
    for name in ("documents", "labels"):
        table(spark, SF, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
