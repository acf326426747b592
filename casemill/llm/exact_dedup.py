"""Exact dedup by two-pass Bloom filtering.

Pass one turns every text into a hash and drops `PROBES` cells per row into a counting filter whose counters stop at
two. A row can only have an equal if all its cells were hit twice. Pass two looks rows up: those that cannot repeat pass
straight through, and only the others are shuffled and grouped by their whole hash. The filter may name too many rows,
never too few, so the result is exact at every size of filter.

Nulls count as empty texts; a null doc_id is an id of its own that is larger than all others; repeated rows are members
of one group, and `exact_groups` marks all rows with the smallest doc_id as kept, of which `drop_copies` leaves one. An
empty table gives no rows. Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import carried, rows_of, saved, spread_mix, texts_of

PROBES = 4
CELLS_PER_ROW = 16
SLICE_CELLS = 1 << 16
#: Cells of the broadcast filter at most: 128 MB as bits. Beyond it more unique rows are grouped in vain; nothing is lost.
MAX_CELLS = 1 << 30


#: Runs of blanks that are not one space already.
LOOSE_BLANKS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), LOOSE_BLANKS, " ")


def hashed_texts(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of the normalised text."""
    return texts_of(docs).select("doc_id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("sha"))


def filter_cells(rows: int, max_cells: int = MAX_CELLS) -> int:
    cells = SLICE_CELLS
    while cells < rows * CELLS_PER_ROW and cells < max_cells:
        cells *= 2
    return cells


def cells_of(hashes: np.ndarray, cells: int) -> np.ndarray:
    """`PROBES` cells for each 64-bit hash, one row each."""
    step = spread_mix(hashes) | np.uint64(1)
    probes = np.arange(PROBES, dtype=np.uint64)[None, :]
    return (hashes[:, None] + probes * step[:, None]) >> np.uint64(64 - int(cells).bit_length() + 1)


def _first_words(hashes) -> np.ndarray:
    """The first 8 bytes of each 32-byte hash as a number."""
    return np.frombuffer(b"".join(hashes), dtype="<u8")[::4].copy()


def repeated_cells(hashes: DataFrame, cells: int) -> bytes:
    """Pass one: the cells hit at least twice, as bits; `cells` / 8 bytes, whatever the number of rows."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def dealt():
            at = np.sort(np.concatenate(held).ravel())
            cuts = np.flatnonzero(np.diff(at >> np.uint64(16))) + 1
            groups = np.split(at, cuts)
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([int(g[0] >> np.uint64(16)) for g in groups], pa.int32()),
                 pa.array([g.astype("<u2").tobytes() for g in groups], pa.binary())], names=["slice", "hits"])

        for batch in batches:
            if batch.num_rows:
                held.append(cells_of(_first_words(batch.column(0).to_pylist()), cells))
            if sum(map(len, held)) >= 1 << 20:
                yield dealt()
        if held:
            yield dealt()

    def twice(key, frame):
        counts = np.zeros(SLICE_CELLS, np.int64)
        for hits in frame["hits"]:
            counts += np.bincount(np.frombuffer(hits, "<u2"), minlength=SLICE_CELLS)
        return pd.DataFrame({"slice": [key[0]], "bits": [np.packbits(counts >= 2).tobytes()]})

    parts = hashes.select("sha").mapInArrow(probe, "slice int, hits binary")
    bits = bytearray(cells // 8)
    for row in parts.groupBy("slice").applyInPandas(twice, "slice int, bits binary").toLocalIterator():
        bits[row["slice"] * SLICE_CELLS // 8:(row["slice"] + 1) * SLICE_CELLS // 8] = row["bits"]
    return bytes(bits)


def repeat_test(spark, bits: bytes, cells: int):
    """Pass two: a column function of the hash that is false only where no equal hash can exist."""
    shared = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def maybe(sha: pd.Series) -> pd.Series:
        plane = np.frombuffer(shared.value, np.uint8)
        at = cells_of(_first_words(sha), cells)
        hit = (plane[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1
        return pd.Series(hit.all(axis=1))

    return maybe


def _tested(docs: DataFrame, max_cells: int):
    hashes = saved(hashed_texts(docs), "text-hashes")
    cells = filter_cells(hashes.count(), max_cells)
    return hashes, repeat_test(docs.sparkSession, repeated_cells(hashes, cells), cells)


def _groups(repeats: DataFrame) -> DataFrame:
    """Written before it is joined, so that both sides of the join are plain exchanges and a hot hash can be split."""
    return saved(repeats.groupBy("sha").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "text-groups")


def exact_groups(docs: DataFrame, max_cells: int = MAX_CELLS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, sha for every row."""
    hashes, maybe = _tested(docs, max_cells)
    rows = saved(hashes.withColumn("maybe", maybe("sha")), "bloom-flags")
    alone = rows.where("NOT maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    repeats = rows.where("maybe").select("doc_id", "sha")
    grouped = repeats.join(_groups(repeats), "sha").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "sha")
    return alone.unionByName(grouped)


def drop_copies(docs: DataFrame, max_cells: int = MAX_CELLS) -> DataFrame:
    """One row of each text: that with the smallest doc_id. Rows that cannot repeat are neither joined nor shuffled."""
    hashes, maybe = _tested(docs, max_cells)
    keep = _groups(hashes.where(maybe("sha"))).select(F.col("sha").alias("_sha"), F.col("keep_id").alias("_keep"))
    own = carried(docs).withColumn("_sha", F.unhex(F.sha2(normalised(F.col("text")), 256)))
    own = own.withColumn("_maybe", maybe("_sha"))
    repeats = own.where("_maybe").join(keep, "_sha").where(F.col("doc_id").eqNullSafe(F.col("_keep")))
    one = repeats.dropDuplicates(["_sha"])
    return rows_of(own.where("NOT _maybe")).unionByName(rows_of(one))
