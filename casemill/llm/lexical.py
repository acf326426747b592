"""Ranked lexical search by a hybrid of term-at-a-time and document-at-a-time evaluation.

One pass over the texts writes an index of the terms that items ask for, in blocks of documents: ids and lengths of the
documents, and for each term its places in the block and its counts there. The blocks are summed up to the corpus
counts, one number for each asked term. A second pass goes over the blocks: each task scores every item on its blocks and
keeps the best documents it has seen so far, whose last score is the threshold for its later blocks; the tasks' lists are
then ranked together. So no posting is shuffled, no term's list is ever gathered, and a term that every document holds
is dealt out like the documents.

Within a block, an item's short lists are first summed up term at a time. The sums, ordered by document, are one more list
with a bound of its own, the largest sum. This list and the long ones are then walked together in windows of ascending
documents: lists whose bounds together stay under the threshold cannot bring a document in and are only looked into, by
binary search, at documents that the other lists give and whose bound still reaches the threshold. Bounds are exact
maxima of the block, and only scores under the threshold are passed over, so ties are kept and nothing is lost.

A query set of any size is taken in passes of a bounded number of terms. Rows of one item_id are one item with the terms
of all of them; null texts and texts without terms hold none, and an item without terms has no result. Every row of the
documents counts, repeated doc_ids each for themselves; a row without doc_id counts in the statistics, but is not ranked.
Empty tables give no rows, and other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casemill.llm.common import by_batch, ready, saved, texts_of, trim_memory

TOP = 10
#: Distinct terms of the items of one pass.
TERMS_PER_PASS = 1 << 18
DOCUMENTS_PER_BLOCK, WORDS_PER_BLOCK = 1 << 16, 4_000_000
#: A list is short if it holds at most one document in so many; documents of a window.
SHORT_SHARE, WINDOW = 32, 2048

#: Letters and digits stand for themselves, A-Z lower-cased, and all bytes of other characters too; the rest parts terms.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLDED).split()


# ---- index ----

BLOCK = "n_documents long, n_words long, doc_ids binary, named binary, lengths binary, terms binary, starts binary, places binary, counts binary"


def block_row(doc_ids: list, lengths: list[int], keys: list[np.ndarray]) -> list:
    """`keys` hold term << 16 | place for each occurrence."""
    found, counts = np.unique(np.concatenate(keys or [np.zeros(0, np.int64)]), return_counts=True)
    held, starts = np.unique(found >> 16, return_index=True)
    named = np.array([d is not None for d in doc_ids], bool)
    sizes = np.array(lengths, np.int64)
    return [int((sizes > 0).sum()), int(sizes.sum()), np.array([d or 0 for d in doc_ids], np.int64).tobytes(), named.tobytes(), sizes.tobytes(),
            held.astype(np.uint32).tobytes(), np.append(starts, len(found)).astype(np.uint32).tobytes(),
            (found & 0xFFFF).astype(np.uint16).tobytes(), counts.astype(np.uint32).tobytes()]


def index_blocks(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Blocks of documents with the postings of the terms in `vocabulary`."""

    def record(*row) -> pa.RecordBatch:
        types = [pa.int64()] * 2 + [pa.binary()] * 7
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(block_row(*row), types)], names=[c.split()[0] for c in BLOCK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids, lengths, keys, weight = [], [], [], 0
        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms(value.as_py())
                own = np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int64, len(words))
                keys.append((own[own >= 0] << 16) | len(doc_ids))
                doc_ids.append(doc_id)
                lengths.append(len(words))
                weight += len(words)
                if len(doc_ids) >= DOCUMENTS_PER_BLOCK or weight >= WORDS_PER_BLOCK:
                    yield record(doc_ids, lengths, keys)
                    doc_ids, lengths, keys, weight = [], [], [], 0
                    trim_memory()
        if doc_ids:
            yield record(doc_ids, lengths, keys)
        trim_memory()

    return docs.mapInArrow(run, BLOCK)


def corpus_counts(blocks: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all words, and documents of each term of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n_terms, np.int64)
        for batch in batches:
            for held, starts in zip(*(c.to_pylist() for c in batch.columns)):
                sums[np.frombuffer(held, np.uint32)] += np.diff(np.frombuffer(starts, np.uint32).astype(np.int64))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at], pa.int64())], names=["term", "df"])

    totals = blocks.agg(F.coalesce(F.sum("n_documents"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    df = np.zeros(n_terms, np.int64)
    # One row for each asked term at most.
    for term, n in blocks.select("terms", "starts").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        df[term] = n
    return totals[0], totals[1], df


def term_weights(n_documents: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)


# ---- evaluation ----

class Block:
    """A block's lists with their scores, which depend on no item."""

    def __init__(self, row: dict, n_documents: int, n_words: int, weights: np.ndarray):
        read = lambda c, kind: np.frombuffer(row[c], kind)
        self.doc_ids, self.named = read("doc_ids", np.int64), read("named", bool)
        self.size = len(self.doc_ids)
        lengths = read("lengths", np.int64)
        if len(lengths) and 90 * n_documents * int(lengths.max()) >= 1 << 63:
            lengths = lengths.astype(object)
        norm = (10 + (90 * n_documents * lengths) // max(n_words, 1)).astype(np.int64)
        held = read("terms", np.uint32).astype(np.int64)
        self.starts = read("starts", np.uint32).astype(np.int64)
        self.places = read("places", np.uint16).astype(np.int64)
        tf = read("counts", np.uint32).astype(np.int64)
        self.scores = np.repeat(weights[held], np.diff(self.starts)) * ((1_000_000_000 * tf) // (1000 * tf + 8 * norm[self.places]))
        self.at = {int(t): k for k, t in enumerate(held) if weights[t] > 0}
        self.bounds = np.maximum.reduceat(self.scores, self.starts[:-1]).tolist() if len(held) else []

    def lists(self, wanted: list[int]) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(bound, places, scores) of the terms that the block holds."""
        found = [self.at[t] for t in wanted if t in self.at]
        return [(self.bounds[k], self.places[self.starts[k]:self.starts[k + 1]], self.scores[self.starts[k]:self.starts[k + 1]]) for k in found]


class Best:
    """The best documents of an item so far."""

    def __init__(self, top: int):
        self.top = top
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def threshold(self) -> int:
        """What a document must reach; a score of 0 never does."""
        return max(1, int(self.scores[-1])) if len(self.scores) == self.top else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[:self.top]
        self.scores, self.ids = scores[order], ids[order]


def accumulated(lists: list, size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Short lists summed up term at a time, as one list."""
    sums = np.zeros(size, np.int64)
    for _, places, scores in lists:
        sums[places] += scores
    at = np.flatnonzero(sums)
    return int(sums.max(initial=0)), at, sums[at]


def search_block(block: Block, wanted: list[int], best: Best, short_share: int = SHORT_SHARE, window: int = WINDOW) -> None:
    """Adds the block's best documents for the terms `wanted`."""
    lists = block.lists(wanted)
    if sum(bound for bound, _, _ in lists) < best.threshold:
        return
    short = [x for x in lists if len(x[1]) * short_share <= block.size]
    members = [x for x in lists if len(x[1]) * short_share > block.size]
    if short:
        members.append(accumulated(short, block.size))
    members.sort(key=lambda x: x[0])
    reach = np.cumsum([bound for bound, _, _ in members])  # of the lists up to each
    for low in range(0, block.size, window):
        high = min(low + window, block.size)
        threshold = best.threshold
        first = int(np.searchsorted(reach, threshold))  # lists before it reach less together
        if first == len(members):
            return
        sums = np.zeros(high - low, np.int64)
        for _, places, scores in members[first:]:
            a, b = np.searchsorted(places, (low, high))
            sums[places[a:b] - low] += scores[a:b]
        documents = np.flatnonzero((sums > 0) & block.named[low:high])
        sums = sums[documents]
        documents += low
        for k in range(first - 1, -1, -1):
            able = sums + reach[k] >= threshold
            documents, sums = documents[able], sums[able]
            if not len(documents):
                break
            _, places, scores = members[k]
            at = np.searchsorted(places, documents)
            at[at == len(places)] = 0
            sums = sums + np.where(places[at] == documents, scores[at], 0)
        good = sums >= threshold
        if good.any():
            best.add(sums[good], block.doc_ids[documents[good]])


def best_in_tasks(blocks: DataFrame, items: list[list[int]], n_documents: int, n_words: int, weights: np.ndarray, top: int) -> DataFrame:
    """item (its place in `items`), doc_id, score: the best of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in items]
        for batch in batches:
            for k in range(batch.num_rows):
                block = Block({c: batch.column(c)[k].as_py() for c in batch.schema.names if c not in ("n_documents", "n_words")}, n_documents, n_words, weights)
                for own, wanted in zip(best, items):
                    search_block(block, wanted, own)
                del block
        found = [np.full(len(b.ids), k, np.int64) for k, b in enumerate(best)]
        columns = [np.concatenate(c) for c in (found, [b.ids for b in best], [b.scores for b in best])]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "doc_id", "score"])
        trim_memory()

    return blocks.mapInArrow(run, "item long, doc_id long, score long")


def item_passes(items: DataFrame, terms_per_pass: int) -> Iterator[tuple[list, list[list[int]], dict[bytes, int]]]:
    """Item ids, their terms by number, and the vocabulary of each pass."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    held = by_batch(rows, lambda ids, texts: {"item_id": [i for i, t in zip(ids, texts) for _ in set(terms(t))],
                                              "term": [w for t in texts for w in set(terms(t))]}, "item_id long, term binary")
    ids, wanted, vocabulary = [], [], {}
    # A query set may be of any size, so it comes partition by partition.
    for item_id, own in held.groupBy("item_id").agg(F.collect_set("term")).toLocalIterator():
        ids.append(item_id)
        wanted.append([vocabulary.setdefault(bytes(t), len(vocabulary)) for t in own])
        if len(vocabulary) >= terms_per_pass:
            yield ids, wanted, vocabulary
            ids, wanted, vocabulary = [], [], {}
    if ids:
        yield ids, wanted, vocabulary


RANKED = "item_id long, rank int, doc_id long, score long"


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, terms_per_pass: int = TERMS_PER_PASS) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` best documents of each item with a score above 0."""
    spark = docs.sparkSession
    ready(spark)
    out = spark.createDataFrame([], RANKED)
    for ids, wanted, vocabulary in item_passes(items, terms_per_pass):
        blocks = saved(index_blocks(texts_of(docs), vocabulary), "term-blocks")
        n_documents, n_words, df = corpus_counts(blocks, len(vocabulary))
        found = best_in_tasks(blocks, wanted, n_documents, n_words, term_weights(n_documents, df), top)
        order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        names = spark.createDataFrame([*enumerate(ids)], "item long, item_id long")
        out = out.unionByName(best.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return out
