"""Readers for payload files, catalog tables, profiles, logs and file folders."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import fields
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill import schemas
from casemill.operators.decision import Policy
from casemill.session import ship_package


def read_payloads(spark: SparkSession, path: str, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(cases, facts) of payload files; the place in the payload orders the facts.

    A file holds one JSON object, and its name names the case. With ``key``, a field and its type, files hold an object on
    each line, and that field names the case: so many cases need few files.
    """
    if key is None:
        name = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
        raw = spark.read.schema(schemas.PAYLOAD).json(path, multiLine=True).withColumn("request_id", name)
    else:
        raw = spark.read.schema(f"{key}, {schemas.PAYLOAD}").json(path).withColumnRenamed(key.split()[0], "request_id")
    cases = raw.select("request_id", F.col("_target_course_requested").alias("course_requested"),
                       F.upper(F.nullif(F.trim("_expected_decision"), F.lit(""))).alias("expected"),
                       F.coalesce("_description", F.lit("")).alias("description"))
    rows = raw.select("request_id", F.posexplode("facts").alias("ordinal", "f"))
    facts = rows.select(
        "request_id", "ordinal", F.concat_ws("-", "request_id", F.col("ordinal").cast("string")).alias("evidence_id"),
        F.col("f.factType").alias("fact_type"), F.col("f.factKey").alias("fact_key"), F.col("f.factValue").alias("fact_value"),
        F.col("f.factJson.items").alias("items"), F.coalesce("f.unknown", F.lit(False)).alias("is_unknown"))
    return cases, facts


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A quoted, possibly multi-line CSV with a header, matched to ``schema`` by name.

    ``place`` orders rows as the files have them: by file name, then by the position in the file, which one task reads.
    """
    every = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    wanted = [part.split()[0] for part in schema.split(", ")]
    missing = F.lit(None).cast("string")
    return every.select(*[F.col(c) if c in every.columns else missing.alias(c) for c in wanted],
                        F.struct(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("row")).alias("place"))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Target profiles, one JSON object per line."""
    return spark.read.schema(schemas.PROFILE).json(path)


def policy_from(settings: dict) -> Policy:
    """Policy from a settings mapping; unknown keys are refused, null means the default."""
    known = {f.name for f in fields(Policy)}
    extra = set(settings) - known
    if extra:
        raise ValueError(f"unknown policy settings {sorted(extra)}")
    kept = {k: v for k, v in settings.items() if v is not None}
    if "must_include_topics" in kept:
        kept["must_include_topics"] = tuple(kept["must_include_topics"])
    return Policy(**kept)


def read_policy(spark: SparkSession, path: str) -> Policy:
    """Policy from one small JSON file on the shared file system."""
    return policy_from(json.loads(spark.read.text(path, wholetext=True).first().value))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Raw log lines with their file name; nothing is parsed, so malformed lines survive."""
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("line"))


def file_inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Name, size, time and sha256 of every file below a folder.

    A file is one binary value, so files of 2 GB and more cannot be hashed this way; filter them out by name.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), F.col("length").alias("size_bytes"),
                        "modificationTime", F.sha2("content", 256).alias("sha256"), F.substring("content", 1, 16).alias("head"))


def _shown(name: str) -> bool:
    """Whether Spark's own readers would see a file or folder of that name."""
    return not (name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name))


def case_folders(spark: SparkSession, path: str, least: int = 2, pattern: str = "*.pdf") -> DataFrame:
    """Folders that hold at least ``least`` files of a kind: one case each (S8). No file is opened.

    The driver lists the first level alone; each folder of it is listed by a task, and only counts leave the tasks.
    ``pattern`` is a file name with ``*`` and ``?``.
    """
    ship_package(spark)
    system, base = fs.FileSystem.from_uri(path)
    top = [f for f in system.get_file_info(fs.FileSelector(base)) if _shown(f.base_name)]
    folders = [f.path for f in top if f.type == fs.FileType.Directory]
    own = sum(f.type == fs.FileType.File and fnmatchcase(f.base_name, pattern) for f in top)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                files, waiting, names, counts = fs.FileSystem.from_uri(path)[0], [folder], [], []
                while waiting:
                    at = waiting.pop()
                    found = [f for f in files.get_file_info(fs.FileSelector(at)) if _shown(f.base_name)]
                    waiting.extend(f.path for f in found if f.type == fs.FileType.Directory)
                    names.append(at.rstrip("/").rsplit("/", 1)[-1])
                    counts.append(sum(f.type == fs.FileType.File and fnmatchcase(f.base_name, pattern) for f in found))
                yield pa.RecordBatch.from_pydict({"case_name": names, "n": pa.array(counts, pa.int64())})

    schema = "case_name string, n long"
    rows = spark.createDataFrame([(f,) for f in folders], "folder string").repartition(max(1, min(len(folders), 1000)))
    counts = rows.mapInArrow(listed, schema).unionByName(spark.createDataFrame([(base.rstrip("/").rsplit("/", 1)[-1], own)], schema))
    per_folder = counts.groupBy("case_name").agg(F.sum("n").alias("n_files"))
    return per_folder.filter((F.col("n_files") >= least) & (F.col("n_files") > 0))


def active_run_facts(facts: DataFrame, runs: DataFrame) -> DataFrame:
    """Externally extracted facts of cases with a queued or running extraction, under its newest such run."""
    from casemill.operators.common import newest_per

    active = runs.filter(F.col("status").isin("queued", "running")).select("request_id", "extraction_run_id", "created_at")
    newest = newest_per(active, ["request_id"], ["created_at", "extraction_run_id"])
    return facts.join(newest.select("request_id", "extraction_run_id"), "request_id")
