"""Token ids in files of patched frame-of-reference blocks, written in ascending doc_id order and read back.

A block holds up to `BLOCK` ids: its minimum is subtracted, the differences are packed at a width that the given
percentile of them fits, and the others stand in an exception list of places and high bits. A file is

    "PFR1" | blocks | block starts, 8 bytes each | doc_ids, doc_id marks and lengths | counts and places of these, 40 bytes

so a reader finds any block by its number. Files are cut by ranges of doc_id; the manifest, a small table, names the
files in order. A task writes a file under a name of its own, and only the manifest rows of tasks that ended count, so a
lost executor leaves at most a file nobody reads. Files are opened through the file system of the shared folder's URI.

A null text is an empty one and still has its end id; rows without doc_id come first; rows with equal doc_id are ordered
by text; an empty table has no files and gives no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casemill.llm.common import saved, shared_path, texts_of
from casemill.llm.vocab import DOCUMENT_VOCAB, document_encoder

MAGIC = b"PFR1"
BLOCK = 1024
PERCENTILE = 90
END_ID = 2
#: Blocks coded in one go.
RUN = 256
HEAD = np.dtype([("n", "<u2"), ("width", "u1"), ("high", "u1"), ("exceptions", "<u2"), ("low", "<u4")])
MANIFEST = "part int, path string, documents long, ids long"


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of numbers as rows of bytes, `width` bits each, lowest bit first."""
    planes = (values[:, :, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(planes.astype(np.uint8).reshape(len(values), -1), axis=1, bitorder="little")


def _unbits(packed: np.ndarray, n: int, width: int) -> np.ndarray:
    planes = np.unpackbits(packed, axis=1, bitorder="little")[:, :n * width].reshape(len(packed), n, width)
    out = np.zeros((len(packed), n), np.uint32)
    for k in range(width):
        out |= planes[:, :, k].astype(np.uint32) << np.uint32(k)
    return out


def _width(x: int) -> int:
    return int(x).bit_length()


def encode_blocks(ids: np.ndarray, percentile: int = PERCENTILE) -> list[bytes]:
    """One byte string for each block of `BLOCK` ids, the last one shorter."""
    out: list[bytes] = []
    whole = len(ids) // BLOCK
    for matrix in ([ids[:whole * BLOCK].reshape(whole, BLOCK)] if whole else []) + ([ids[None, whole * BLOCK:]] if len(ids) % BLOCK else []):
        n = matrix.shape[1]
        low = matrix.min(axis=1)
        rest = (matrix - low[:, None]).astype(np.uint32)
        place = min(n - 1, n * percentile // 100)
        chosen = np.partition(rest, place, axis=1)[:, place]
        widths = np.array([_width(x) for x in chosen])
        highs = np.array([_width(int(top) >> int(w)) for top, w in zip(rest.max(axis=1), widths)])
        blocks: list[bytes] = [b""] * len(matrix)
        for w in np.unique(widths):
            rows = np.flatnonzero(widths == w)
            packed = _bits(rest[rows] & np.uint32((1 << int(w)) - 1), int(w)) if w else np.zeros((len(rows), 0), np.uint8)
            for k, row in enumerate(rows):
                at = np.flatnonzero(rest[row] >> np.uint32(w)) if highs[row] else np.zeros(0, np.int64)
                head = np.array([(n, w, highs[row], len(at), low[row])], HEAD).tobytes()
                over = _bits((rest[row, at] >> np.uint32(w))[None, :], int(highs[row])).tobytes() if len(at) else b""
                blocks[row] = head + packed[k].tobytes() + at.astype("<u2").tobytes() + over
        out += blocks
    return out


def decode_block(data: bytes) -> np.ndarray:
    head = np.frombuffer(data, HEAD, 1)[0]
    n, width, high, exceptions = (int(head[k]) for k in ("n", "width", "high", "exceptions"))
    end = HEAD.itemsize + (n * width + 7) // 8
    packed = np.frombuffer(data, np.uint8, end - HEAD.itemsize, HEAD.itemsize)[None, :]
    out = _unbits(packed, n, width)[0] if width else np.zeros(n, np.uint32)
    if exceptions:
        at = np.frombuffer(data, "<u2", exceptions, end)
        over = np.frombuffer(data, np.uint8, offset=end + 2 * exceptions)[None, :]
        out[at] |= _unbits(over, exceptions, high)[0] << np.uint32(width)
    return out + np.uint32(head["low"])


class FileWriter:
    """Takes documents one by one and holds at most `RUN` blocks of ids."""

    def __init__(self, out, percentile: int = PERCENTILE):
        self.out, self.percentile = out, percentile
        self.held: list[np.ndarray] = []
        self.held_ids, self.at, self.total = 0, len(MAGIC), 0
        self.starts: list[int] = []
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.held.append(ids)
        self.held_ids += len(ids)
        self.total += len(ids)
        if self.held_ids >= RUN * BLOCK:
            self._flush(self.held_ids - self.held_ids % BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held)
        for block in encode_blocks(ids[:n], self.percentile):
            self.starts.append(self.at)
            self.out.write(block)
            self.at += len(block)
        self.held, self.held_ids = [ids[n:]], len(ids) - n

    def close(self) -> None:
        if self.held_ids:
            self._flush(self.held_ids)
        marks = np.array([d is not None for d in self.doc_ids], np.uint8)
        sections = (np.array([*self.starts, self.at], "<u8"), np.array([d or 0 for d in self.doc_ids], "<i8"), marks, np.array(self.lengths, "<u8"))
        places = [self.at]
        for section in sections:
            self.out.write(section.tobytes())
            places.append(places[-1] + section.nbytes)
        self.out.write(np.array([places[0], len(self.starts), places[1], len(self.doc_ids), places[-1]], "<u8").tobytes())


class FileReader:
    """Finds documents and blocks of a file; `source` is a seekable file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        first, n_blocks, second, n_docs, end = (int(x) for x in np.frombuffer(self._read(size - 40, 40), "<u8"))
        if self._read(0, len(MAGIC)) != MAGIC or end != size - 40:
            raise ValueError("not a file of token blocks")
        self.starts = np.frombuffer(self._read(first, 8 * (n_blocks + 1)), "<u8").astype(np.int64)
        tail = self._read(second, 17 * n_docs)
        marks = np.frombuffer(tail, np.uint8, n_docs, 8 * n_docs)
        self.doc_ids = [int(d) if m else None for d, m in zip(np.frombuffer(tail, "<i8", n_docs), marks)]
        self.lengths = np.frombuffer(tail, "<u8", n_docs, 9 * n_docs).astype(np.int64)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def blocks(self, low: int, high: int) -> np.ndarray:
        """The ids of blocks `low` to `high`, read in one go."""
        at = self.starts[low:high + 1]
        data = self._read(int(at[0]), int(at[-1] - at[0]))
        return np.concatenate([decode_block(data[a - at[0]:b - at[0]]) for a, b in zip(at, at[1:])])

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        n_blocks, block = len(self.starts) - 1, 0
        rest = np.zeros(0, np.uint32)
        for doc_id, length in zip(self.doc_ids, self.lengths):
            parts, have = [rest], len(rest)
            while have < length:
                more = self.blocks(block, min(n_blocks, block + RUN))
                block = min(n_blocks, block + RUN)
                parts.append(more)
                have += len(more)
            ids = np.concatenate(parts) if len(parts) > 1 else rest
            rest = ids[length:]
            yield doc_id, ids[:length]


def write_files(docs: DataFrame, folder: str, vocab: str = DOCUMENT_VOCAB, end_id: int = END_ID, percentile: int = PERCENTILE) -> DataFrame:
    """Writes the files and gives the manifest (part, path, documents, ids), stored; parts ascend with doc_id."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, writer, out, path = document_encoder(vocab), TaskContext.get().partitionId(), None, None, ""
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if writer is None:
                    system, base = fs.FileSystem.from_uri(folder)
                    system.create_dir(base, recursive=True)
                    path = f"part-{part:06d}-{uuid.uuid4().hex}.pfr"
                    out = system.open_output_stream(f"{base}/{path}")
                    writer = FileWriter(out, percentile)
                writer.add(doc_id, np.array([*encoder.ids(text.as_py() or ""), end_id], np.uint32))
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([f"{folder}/{path}"]), pa.array([len(writer.doc_ids)], pa.int64()), pa.array([writer.total], pa.int64())],
                names=["part", "path", "documents", "ids"])

    ordered = texts_of(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return saved(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def with_starts(manifest: DataFrame, group: int = 1024) -> DataFrame:
    """The manifest with `first`, the number of ids in all files before: sums of groups of files, then sums inside a group."""
    cut = manifest.withColumn("_group", F.floor(F.col("part") / group))
    before = (Window.unboundedPreceding, -1)
    groups = cut.groupBy("_group").agg(F.sum("ids").alias("_n")).select(
        "_group", F.coalesce(F.sum("_n").over(Window.orderBy("_group").rowsBetween(*before)), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum("ids").over(Window.partitionBy("_group").orderBy("part").rowsBetween(*before)), F.lit(0))
    return cut.withColumn("_inside", inside).join(groups, "_group").select(
        "part", "path", (F.col("_base") + F.col("_inside")).alias("first"))


def read_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; one file is read by one task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                system, at = fs.FileSystem.from_uri(path)
                out: tuple[list, list, list, list] = ([], [], [], [])
                with system.open_input_file(at) as source:
                    for doc_id, ids in FileReader(source).documents():
                        for column, value in zip(out, (doc_id, first, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))):
                            column.append(value)
                        first += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = with_starts(manifest)
    files = max(1, manifest.count())
    return placed.repartitionByRange(files, "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, folder: str | None = None, vocab: str = DOCUMENT_VOCAB) -> DataFrame:
    return read_files(write_files(docs, folder or shared_path(docs.sparkSession, "token-files"), vocab))
