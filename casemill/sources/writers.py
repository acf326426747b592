"""Writers for result tables, manifests and log events."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from casemill.session import ship_package


def write_table(df: DataFrame, path: str, fmt: str = "parquet", allow_empty: bool = False, **options: str) -> int:
    """Write a table and return its row count; a table without rows is an error unless allowed.

    Rows are counted while they are written, so the plan runs once.
    """
    seen = Observation("written")
    counted = df.observe(seen, F.count(F.lit(1)).alias("n"))
    if fmt == "csv":
        options = {"header": "true", "quote": '"', "escape": '"', **options}
    counted.write.format(fmt).options(**options).mode("overwrite").save(path)
    n = seen.get["n"]
    if n == 0 and not allow_empty:
        raise ValueError(f"no rows written to {path}")
    return n


def write_files(texts: DataFrame, path: str, groups: int = 256) -> None:
    """Each row (folder, text) as one file ``<path>/group=<n>/<folder>/<name>.txt``; the groups keep every level listable.

    Tasks write straight to the shared folder. Spark's own writer starts a committer, a checksum file and mode changes for
    each file, which costs some tens of milliseconds a file on a local disk. A file is named by its task's place and its own
    in the task, so a task that runs again writes the same files.
    """
    ship_package(texts.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(path)
        part, n, made = TaskContext.get().partitionId(), 0, set()
        for batch in batches:
            for folder, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = f"{base}/group={zlib.crc32(folder.encode()) % groups:03d}/{folder}"
                if at not in made:
                    system.create_dir(at, recursive=True)
                    made.add(at)
                with system.open_output_stream(f"{at}/part-{part:05d}-{n:07d}.txt") as out:
                    out.write(text.encode())
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    fs.FileSystem.from_uri(path)[0].create_dir(fs.FileSystem.from_uri(path)[1], recursive=True)
    texts.select("folder", "text").mapInArrow(write, "n long").agg(F.sum("n")).collect()


def manifest(groups: dict[str, DataFrame], run: str) -> DataFrame:
    """One JSON manifest per run with the row count of each table, and its sha256."""
    out = None
    for name in sorted(groups):
        part = groups[name].groupBy(run).agg(F.count(F.lit(1)).alias(name))
        out = part if out is None else out.join(part, run, "full")
    counts = out.select(run, *[F.coalesce(n, F.lit(0)).alias(n) for n in sorted(groups)])
    body = counts.withColumn("manifest", F.to_json(F.struct(run, *sorted(groups))))
    return body.select(run, "manifest", F.sha2("manifest", 256).alias("manifest_sha256"))


def append_events(events: DataFrame, path: str) -> None:
    """Append log events as JSON lines, times to the microsecond."""
    time = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    events.write.mode("append").options(timestampFormat=time + "XXX", timestampNTZFormat=time).json(path)
