"""Tables laid out by a hash of their key, so that a job reads and writes only the buckets its keys fall in.

A bucket is a partition folder `_bucket=<number>`. Work on some keys first finds their buckets, at most as many small
numbers as the table has buckets, and names them in the filter: Spark then lists and reads no other folder. Writing uses
dynamic partition overwrite: touched buckets are written beside the old ones and moved in place when the job has ended, so
untouched files stay as they are and a repeated run gives the same table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "_bucket"


def bucket_of(key: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def write_buckets(df: DataFrame, path: str, key: Sequence[str], buckets: int, salt: int = 1) -> None:
    """Write a whole table; with ``salt`` > 1 a bucket is written by as many tasks, should one key hold many rows."""
    placed = df.withColumn(BUCKET, bucket_of(key, buckets))
    spread = placed.repartition(buckets * salt, BUCKET, F.pmod(F.xxhash64(*df.columns), F.lit(salt)))
    spread.write.partitionBy(BUCKET).mode("overwrite").parquet(path)


def touched(rows: DataFrame, key: Sequence[str], buckets: int) -> list[int]:
    """The buckets that the keys of ``rows`` fall in."""
    return sorted(r[0] for r in rows.select(bucket_of(key, buckets)).distinct().collect())


def read_buckets(spark: SparkSession, path: str, numbers: Sequence[int] | None = None) -> DataFrame:
    """The table, or some of its buckets, without the bucket column."""
    table = spark.read.parquet(path)
    return (table if numbers is None else table.filter(F.col(BUCKET).isin(list(numbers)))).drop(BUCKET)


def rows_of_keys(spark: SparkSession, path: str, keys: DataFrame, key: Sequence[str], buckets: int) -> DataFrame:
    """Rows of the given keys; files of other buckets are not read."""
    return read_buckets(spark, path, touched(keys, key, buckets)).join(keys.select(*key).distinct(), list(key), "left_semi")


def change_buckets(spark: SparkSession, path: str, incoming: DataFrame, key: Sequence[str], buckets: int,
                   job: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
    """Replace the buckets that ``incoming`` touches by ``job(their rows, incoming)``; gives their numbers.

    ``job`` must keep every row in its bucket. A bucket that is not there yet counts as empty.
    """
    numbers = touched(incoming, key, buckets)
    if numbers:
        new = job(read_buckets(spark, path, numbers), incoming).withColumn(BUCKET, bucket_of(key, buckets))
        (new.repartition(len(numbers), BUCKET).write.partitionBy(BUCKET).mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").parquet(path))
    return numbers
