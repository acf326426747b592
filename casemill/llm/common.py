"""Small helpers that the operators share: tables in the shared folder, Arrow batches, hashing."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.session import shared_dir, ship_package, small_batches

ROWS_PER_CHUNK = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans nobody holds any more; it does so when the driver collects garbage,
    which a driver with little to do would put off while the executors' disks fill."""
    gc.collect()
    spark._jvm.System.gc()


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the folder that all executors share: later readers neither recompute nor lose them."""
    release(df.sparkSession)
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ready(spark: SparkSession) -> None:
    """Sends the package, and has whole texts handed to Python in small batches."""
    ship_package(spark)
    small_batches(spark)


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever other columns there are; other names cannot clash."""
    ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def carried(docs: DataFrame) -> DataFrame:
    """doc_id and text, and the whole row as `_row`, so that no working column can clash with one of the table."""
    ready(docs.sparkSession)
    return docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def rows_of(held: DataFrame) -> DataFrame:
    return held.select("_row.*")


def trim_memory() -> None:
    """Gives what numpy and Arrow have freed back to the system: Python workers live on between tasks, and several of
    them share an executor's memory with its heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library, which trims by itself
        pass


def by_batch(df: DataFrame, rows: Callable[..., dict], schema: str) -> DataFrame:
    """mapInArrow in chunks of few rows; `rows` takes the columns of a chunk as lists and gives the new ones.

    Chunks are small so that a run of very long texts does not pile up.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS_PER_CHUNK):
                part = batch.slice(low, ROWS_PER_CHUNK)
                out = rows(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        trim_memory()

    return df.mapInArrow(run, schema)


def spread_mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
