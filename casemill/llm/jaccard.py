"""Jaccard join of word n-gram sets by PartEnum signatures (Arasu, Ganti, Kaushik).

Sets are banded by size, so that similar sets lie in one band or in neighbours. Inside a band, similarity bounds the
number of features in which two sets differ. The domain of feature hashes is cut into partitions and these into
sub-partitions; a signature is what a set has in one subset of the sub-partitions of a partition. Two sets that differ
in few features must agree on a signature, so similar sets share one; the others are verified away. A set of size s
needs only the first partitions, as many as its own largest possible distance calls for, and a signature of an empty
projection is left out wherever the bound shows that another one is shared as well.

Signatures are dealt to buckets as packed arrays, one row for each batch and bucket; the number of buckets grows with the
number of words. A bucket yields the pairs of sets that share a signature, but for those of unlike size and those of two sets
that both have the signature for the sake of larger partners: these meet in their own band as well. Where many sets share one, only the pairs
with its smallest id are formed, and those sets are joined once more by coarser partitions with larger subsets, which
passages that many documents share no longer fill. What shares even such a signature and is not yet in one component is
compared pair by pair between components, so no link is lost; tasks return sets and links that join components, not pairs.

Pairs are verified by exact intersections, after a bit sketch whose distance never exceeds that of the sets. Sketches come
with the first signatures; whole sets are made from the texts again, of close pairs alone, so features are never stored for
all documents. First each set is compared with its smallest partner; pairs that these links already connect need no look.

Null or empty texts have no features and link with nothing; equal sets are one node; rows with equal doc_id are one
node; a row without doc_id links with nothing and has no component. Empty tables give no rows. All words of a text count.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import by_batch, saved, spread_mix, texts_of, trim_memory
from casemill.llm.components import components

SHINGLE_WORDS = 5
PERCENT = 75
#: More sets than this at one signature are not paired off inside the bucket.
CROWD = 16
SIGNATURES_PER_BUCKET = 750_000
#: Bits of a sketch for each feature at least, and of a sketch at least and at most.
SKETCH_RATE, SKETCH_LEAST, SKETCH_MOST = 2, 512, 1 << 14
#: Documents whose signatures are packed together.
DOCUMENTS_PER_PACK = 4096
WORDS_PER_PACK = 300_000


# ---- features ----

def shingles(text: str | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct hashes of the word n-grams in ascending order; the whole sequence if it is shorter."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = min(width, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k:len(words) - n + 1 + k]
    return np.unique(spread_mix(out))


def set_key(features: np.ndarray) -> int:
    """A number that equal sets share."""
    total = np.add.reduce(spread_mix(features ^ np.uint64(0xA0761D6478BD642F)), dtype=np.uint64)
    return int(spread_mix(np.array([total + np.uint64(len(features))], np.uint64)).view(np.int64)[0])


def sketch_bits(size: int) -> int:
    """Bits of the sketch of a set of this size."""
    bits = SKETCH_LEAST
    while bits < min(SKETCH_MOST, SKETCH_RATE * size):
        bits *= 2
    return bits


def sketch(features: np.ndarray) -> bytes:
    """Parities of the features by their low bits: two sets differ in no more bits than features.

    The size follows the set's and is a power of two, so the longer of two sketches can be folded onto the shorter.
    """
    bits = sketch_bits(len(features))
    places = (features & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(places, minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def bits_apart(x: bytes, y: bytes) -> int:
    """Differing bits of two sketches, on the size of the shorter."""
    if len(x) < len(y):
        x, y = y, x
    a, size = int.from_bytes(x, "little"), len(x)
    while size > len(y):
        size //= 2
        a = (a >> 8 * size) ^ (a & ((1 << 8 * size) - 1))
    return (a ^ int.from_bytes(y, "little")).bit_count()


# ---- signatures ----

@lru_cache(maxsize=None)
def band_tops(percent: int) -> np.ndarray:
    """The largest size of each band: sizes of similar sets are at most a band apart."""
    tops, low = [], 1
    while low < 1 << 40:
        tops.append(low * 100 // percent)
        low = tops[-1] + 1
    return np.array(tops, np.int64)


@dataclass(frozen=True)
class Scheme:
    """`parts` sub-partitions in a partition, of which subsets of all but `misses` are enumerated."""

    parts: int
    misses: int
    slack: float = 1.1

    def subsets(self) -> np.ndarray:
        chosen = [*combinations(range(self.parts), self.parts - self.misses)]
        table = np.zeros((self.parts, len(chosen)), np.uint64)
        for column, subset in enumerate(chosen):
            table[list(subset), column] = 1
        return table

    def agreeing(self) -> np.ndarray:
        """Subsets that agree when 0, 1, 2 ... sub-partitions of a partition differ."""
        kept = self.parts - self.misses
        return np.array([math.comb(max(0, self.parts - d), kept) for d in range(self.parts + 2)], np.int64)


SCHEMES = (Scheme(4, 1), Scheme(12, 1))


@lru_cache(maxsize=4096)
def _layout(scheme: Scheme, top: int, percent: int):
    """Partitions of a band, the bounds of its sub-partitions and the subset table."""
    distance = (100 - percent) * 2 * top // (100 + percent)
    partitions = math.ceil((distance + 1) / (scheme.misses + 1) * scheme.slack) + 2
    n = partitions * scheme.parts
    bounds = np.array([(i << 64) // n for i in range(n)], np.uint64) if n < 1 << 12 else (np.arange(n, dtype=np.uint64) * np.uint64((1 << 64) // n))
    return partitions, bounds, scheme.subsets(), scheme.agreeing()


#: The low bits of a marked signature: whether it is one of the set's own band, and the set's size.
MARK_BITS, OWN_BAND = 8, 128
#: Steps of the size in a mark while it grows from one size to the largest that is similar; seven bits of it are kept.
SIZE_STEPS = 32


def marks(size: int, percent: int) -> tuple[int, int]:
    """The marks of a set's signatures for its own band and for the next one."""
    step = int(math.log(size) / math.log(100 / percent) * SIZE_STEPS) % OWN_BAND if percent < 100 else 0
    return OWN_BAND | step, step


def may_link(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of sets that share a signature, by its marks: whether their sizes leave room for the similarity and none of their own
    bands is below that of the signature. Two sets of the band below share a signature of that band as well."""
    apart = (x - y) % OWN_BAND
    # Two steps for rounding. Sets that share a signature are at most two bands apart, which does not wrap to a small number.
    return ((x | y) >= OWN_BAND) & (np.minimum(apart, OWN_BAND - apart) <= SIZE_STEPS + 2)


def signatures(features: np.ndarray, scheme: Scheme, percent: int = PERCENT, marked: bool = False) -> np.ndarray:
    """64-bit signatures of a set; two sets with a Jaccard similarity of `percent` or more share one.

    If `marked`, the low bits of each are its mark.
    """
    size = len(features)
    if not size:
        return np.zeros(0, np.uint64)
    tops = band_tops(percent)
    band = int(np.searchsorted(tops, size))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread_mix(features), dtype=np.uint64)])
    out = []
    for tag, mark in zip((band, band + 1), marks(size, percent)):
        top = int(tops[tag])
        partitions, bounds, subsets, agreeing = _layout(scheme, top, percent)
        at = np.append(np.searchsorted(features, bounds), size)
        shape = (partitions, scheme.parts)
        values = (sums[at[1:]] - sums[at[:-1]]).reshape(shape)
        counts = (at[1:] - at[:-1]).reshape(shape)
        if scheme.parts - scheme.misses > 1:
            values, counts = values @ subsets, counts @ subsets.astype(np.int64)
        # The largest distance to a similar partner that also has this tag, spread over the first x partitions.
        distance = (100 - percent) * (size + min(top, size * 100 // percent)) // (100 + percent)
        x = np.arange(1, partitions + 1)
        q = np.minimum(distance // x, scheme.parts)
        shared = (distance % x) * agreeing[q + 1] + (x - distance % x) * agreeing[q]
        bound = shared > np.cumsum((counts == 0).sum(axis=1))
        enough = int(bound.argmax()) + 1 if bound.any() else partitions
        place = np.arange(enough * values.shape[1], dtype=np.uint64)
        salt = np.uint64(((tag << 40) + scheme.misses * 1_000_003) * 0xE7037ED1A0B428DB % (1 << 64))
        values = spread_mix(values[:enough].ravel() ^ spread_mix(place * np.uint64(0x8EBC6AF09C88C6E3) + salt))
        if marked:
            values = values >> np.uint64(MARK_BITS) << np.uint64(MARK_BITS) | np.uint64(mark)
        out.append(values[counts[:enough].ravel() > 0] if bound.any() else values)
    return np.concatenate(out)


# ---- shared signatures ----

def _pack(numbers: np.ndarray, size: int = 8) -> bytes:
    """The low bytes of each number, planes of equal rank together, which block compression shrinks well."""
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def _unpack(data: bytes, size: int = 8) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(size, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :size] = planes.T
    return out.view(np.uint64).ravel()


SIGNATURE_BYTES = 6


def _ordered(sigs: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The order by signature and node; only rows of repeated signatures are sorted by both."""
    order = np.argsort(sigs)
    same = sigs[order[1:]] == sigs[order[:-1]]
    many = np.zeros(len(order), bool)
    many[1:] |= same
    many[:-1] |= same
    held = order[many]
    order[many] = held[np.lexsort((nodes[held], sigs[held]))]
    return order


def _unmarked(sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures without marks, and their marks."""
    low = np.uint64((1 << MARK_BITS) - 1)
    return sigs & ~low, (sigs & low).astype(np.int16)


def shared(sigs: np.ndarray, nodes: np.ndarray, crowd: int, sent: np.ndarray | None = None, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows ordered by signature and node: pairs of rows that share a signature; (smallest, other) rows of crowded
    signatures; and a mask of the rows left when the others of crowded ones go. Signatures in `sent` are crowded at any
    number of rows: others of them have gone before. If `own` tells the rows of sets' own bands, signatures that are in none
    are not crowded for want of pairs."""
    if not len(sigs):
        return np.zeros((0, 2), np.int64), np.zeros((0, 2), np.int64), np.zeros(0, bool)
    new = np.append(True, sigs[1:] != sigs[:-1])
    first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    length = np.diff(np.append(first, len(sigs)))[run]
    crowded = length > crowd
    if own is not None:
        crowded &= np.logical_or.reduceat(own, first)[run]
    if sent is not None and len(sent):
        crowded |= np.isin(sigs, sent)
    small = np.flatnonzero((length > 1) & (length <= crowd) & ~crowded)
    pairs = []
    for step in range(1, crowd):
        low = small[small + step < len(sigs)]
        low = low[run[low] == run[low + step]]
        if not len(low):
            break
        pairs.append(np.stack([low, low + step], axis=1))
    others = np.flatnonzero(crowded & ~new)
    stars = np.stack([first[run[others]], others], axis=1)
    return np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64), stars, ~(crowded & ~new)


def _distinct(pairs: np.ndarray) -> np.ndarray:
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    return pairs[np.append(True, (pairs[1:] != pairs[:-1]).any(axis=1))] if len(pairs) else pairs


def _pairs_of(nodes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    ends = nodes[rows]
    return _distinct(np.sort(ends[ends[:, 0] != ends[:, 1]], axis=1))


def _found(pairs: np.ndarray, stars: np.ndarray, star_sigs: np.ndarray) -> dict:
    """Rows of kind 1 (a pair) and kind 2 (smallest and other at a crowded signature)."""
    n, m = len(pairs), len(stars)
    return {"kind": np.repeat(np.array([1, 2], np.int8), [n, m]), "a": np.concatenate([pairs[:, 0], stars[:, 0]]),
            "b": np.concatenate([pairs[:, 1], stars[:, 1]]), "n": np.zeros(n + m, np.int64),
            "sig": np.concatenate([np.zeros(n, np.int64), star_sigs]), "bits": np.full(n + m, None)}


FOUND = "kind byte, a long, b long, n long, sig long, bits binary"
PACKS = "bucket int, kind byte, x binary, y binary, z binary, bits binary"


def _deal(docs: DataFrame, scheme: Scheme, buckets: int, percent: int, width: int, crowd: int, named: bool) -> DataFrame:
    """Packed rows by bucket: signatures with their documents (0), documents with size, key and sketch (1, unless
    `named`), crowded stars (2), and the crowded signatures themselves (3).

    `docs` has doc_id and either text or features.
    """
    whole = "text" in docs.columns

    def packs(held: list[tuple[int, np.ndarray]]) -> Iterator[tuple]:
        ids = np.array([d for d, _ in held], np.int64)
        keys = np.array([set_key(f) for _, f in held], np.int64)
        sizes = np.array([len(f) for _, f in held], np.int64)
        if not named:
            # Any bucket will do for this list; its first id spreads the lists.
            to = int(spread_mix(ids[:1].view(np.uint64))[0] % np.uint64(buckets))
            yield to, 1, _pack(ids), _pack(sizes), _pack(keys), b"".join(sketch(f) for _, f in held)
        _, one = np.unique(keys, return_index=True)
        own = [signatures(held[i][1], scheme, percent, marked=True) for i in one]
        sigs = np.concatenate(own)
        nodes = np.repeat(ids[one], [len(s) for s in own])
        bucket = (sigs >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)
        keys48, marked = _unmarked((bucket << np.uint64(48)) | (sigs & np.uint64((1 << 48) - 1)))
        order = _ordered(keys48, nodes)
        keys48, nodes, marked = keys48[order], nodes[order], marked[order]
        _, stars, left = shared(keys48, nodes, crowd)
        if len(stars):
            where = (keys48[stars[:, 1]] >> np.uint64(48)).astype(np.int64)
            low = keys48[stars[:, 1]] & np.uint64((1 << 48) - 1)
            for k in np.unique(where):
                rows = where == k
                # The stars of a pack go to any bucket: a signature's own one gets only its number, however many sets share it.
                spread = int(spread_mix(ids[:1].view(np.uint64) + np.uint64(k))[0] % np.uint64(buckets))
                if named:
                    yield spread, 2, _pack(nodes[stars[rows, 0]]), _pack(nodes[stars[rows, 1]]), _pack(keys48[stars[rows, 1]]), b""
                yield int(k), 3, _pack(np.unique(low[rows])), b"", b"", b""
            if not named:
                a, b = _distinct(nodes[stars]).T
                yield spread, 2, _pack(a), _pack(b), b"", b""
        keys48, nodes = keys48[left] | marked[left].astype(np.uint64), nodes[left]
        bucket = (keys48 >> np.uint64(48)).astype(np.int64)
        cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else [0]
        for low, high in zip(cuts, cuts[1:]):
            yield int(bucket[low]), 0, _pack(keys48[low:high], SIGNATURE_BYTES), _pack(nodes[low:high]), b"", b""

    def rows(batch: list[tuple]) -> pa.RecordBatch:
        types = (pa.int32(), pa.int8(), *[pa.binary()] * 4)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*batch), types)], names=["bucket", "kind", "x", "y", "z", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []
        weight = 0
        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                features = shingles(value.as_py(), width) if whole else np.frombuffer(value.as_py(), np.uint64)
                held.append((doc_id, features))
                weight += len(features) * scheme.parts // SCHEMES[0].parts
                if len(held) >= DOCUMENTS_PER_PACK or weight >= WORDS_PER_PACK:
                    for pack in packs(held):
                        yield rows([pack])
                    held, weight = [], 0
                    trim_memory()
        if held:
            for pack in packs(held):
                yield rows([pack])
        trim_memory()

    return docs.mapInArrow(run, PACKS)


def share_signatures(docs: DataFrame, scheme: Scheme, buckets: int, percent: int = PERCENT, width: int = SHINGLE_WORDS, crowd: int = CROWD, named: bool = True) -> DataFrame:
    """Rows of kind 1 (a and b share a signature), 2 (a smallest, b other at crowded `sig`).

    Unless `named`, rows of kind 2 have sig 0 and come once for each pack and bucket, not for each signature, and there are
    rows of kind 0 (doc_id a, key b, size n, sketch bits).
    """

    def meet(key: tuple, packs: pd.DataFrame) -> pd.DataFrame:
        own = packs[packs["kind"] == 0]
        sigs = np.concatenate([_unpack(x, SIGNATURE_BYTES) for x in own["x"]] or [np.zeros(0, np.uint64)])
        nodes = np.concatenate([_unpack(y) for y in own["y"]] or [np.zeros(0, np.uint64)]).view(np.int64)
        sigs, marked = _unmarked(sigs)
        order = _ordered(sigs, nodes)
        sigs, nodes, marked = sigs[order], nodes[order], marked[order]
        sent = packs[packs["kind"] == 2]
        # What a pack found crowded is crowded for all packs, however few rows they left.
        crowds = np.concatenate([np.zeros(0, np.uint64), *map(_unpack, packs.loc[packs["kind"] == 3, "x"])])
        pairs, stars, _ = shared(sigs, nodes, crowd, crowds, marked >= OWN_BAND)
        pairs = pairs[may_link(*marked[pairs].T)]
        star_ends = np.concatenate([nodes[stars], *[np.stack([_unpack(x), _unpack(y)], axis=1).view(np.int64) for x, y in zip(sent["x"], sent["y"])]])
        # Signatures are told apart across buckets by the bucket number on top.
        here = sigs[stars[:, 1]] | (np.uint64(key[0]) << np.uint64(48))
        star_sigs = np.concatenate([here, *[_unpack(z) for z in sent["z"]]]).view(np.int64)
        if not named:
            star_ends = _distinct(star_ends)
            star_sigs = np.zeros(len(star_ends), np.int64)
        out = _found(_pairs_of(nodes, pairs), star_ends, star_sigs)
        for x, y, z, data in zip(*(packs.loc[packs["kind"] == 1, c] for c in ("x", "y", "z", "bits"))):
            ids, sizes, keys = (_unpack(c).view(np.int64) for c in (x, y, z))
            ends = np.cumsum([sketch_bits(n) // 8 for n in sizes.tolist()]).tolist()
            bits = np.empty(len(ids), object)
            bits[:] = [data[low:high] for low, high in zip([0, *ends], ends)]
            more = {"kind": np.zeros(len(ids), np.int8), "a": ids, "b": keys, "n": sizes, "sig": np.zeros(len(ids), np.int64), "bits": bits}
            out = {c: np.concatenate([out[c], more[c]]) for c in out}
        del sigs, nodes, order, own, sent
        trim_memory()
        return pd.DataFrame(out)

    return _deal(docs, scheme, buckets, percent, width, crowd, named).groupBy("bucket").applyInPandas(meet, FOUND)


# ---- verification ----

def _sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, features, n, bits and crowded of doc_id, text, crowded."""
    def rows(doc_ids: list, texts: list, crowded: list) -> dict:
        own = [shingles(t, width) for t in texts]
        return {"doc_id": doc_ids, "features": [f.tobytes() for f in own], "n": [len(f) for f in own],
                "bits": [sketch(f) for f in own], "crowded": crowded}

    return by_batch(docs, rows, "doc_id long, features binary, n long, bits binary, crowded boolean")


def _close(percent: int):
    """Whether sizes and sketches leave room for the similarity."""

    def close(n: pd.Series, m: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([
            100 * min(a, b) >= percent * max(a, b) and bits_apart(p, q) * (100 + percent) <= (100 - percent) * (a + b)
            for a, b, p, q in zip(n.tolist(), m.tolist(), x, y)], dtype=bool)

    return F.pandas_udf(close, "boolean")


def linked(x: bytes, y: bytes, percent: int) -> bool:
    """Whether two sets are similar, by their whole intersection."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= percent * (len(a) + len(b) - both) and both > 0


def _similar(percent: int):
    def similar(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([linked(p, q, percent) for p, q in zip(x, y)], dtype=bool)

    return F.pandas_udf(similar, "boolean")


def _verified(pairs: DataFrame, sets: DataFrame, whole: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """The pairs (a, b) that are links, stored; `whole` gives doc_id and features of the doc_ids of a table."""
    bits = sets.select("doc_id", "n", "bits")
    left, right = (bits.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"x{c}")) for c in "ab")
    near = saved(pairs.join(left, "a").join(right, "b").where(_close(percent)("na", "nb", "xa", "xb")).select("a", "b"), "close-pairs")
    # Only the sets of close pairs move.
    ends = near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    wanted = saved(whole(ends), "close-sets")
    left, right = (wanted.select(F.col("doc_id").alias(c), F.col("features").alias(f"f{c}")) for c in "ab")
    return saved(near.join(left, "a").join(right, "b").where(_similar(percent)("fa", "fb")).select("a", "b"), "links")


def _relabelled(pairs: DataFrame, labels: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """With a column l<c> for each named column c: its label, or itself."""
    for c in columns:
        own = labels.select(F.col("node").alias(c), F.col("component").alias(f"l{c}"))
        pairs = pairs.join(own, c, "left").withColumn(f"l{c}", F.coalesce(f"l{c}", F.col(c)))
    return pairs


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends have different labels."""
    return _relabelled(pairs, labels, ("a", "b")).where("la <> lb").select("a", "b")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE_WORDS, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    texts = texts_of(docs)
    known = texts.where("doc_id IS NOT NULL")
    # About 1.3 signatures come from a word of the first scheme and 4 of the second; a word and its blank have some six characters.
    chars = known.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    buckets = max(16, math.ceil(chars / 4.6 / SIGNATURES_PER_BUCKET))
    found = saved(share_signatures(known, SCHEMES[0], buckets, percent, width, crowd, named=False), "signature-pairs")
    own = found.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("key"), "n", "bits")
    # The smallest document of equal sets stands for them.
    heads = saved(own.groupBy("key", "n").agg(F.min("doc_id").alias("head")), "set-heads")
    members = saved(own.drop("bits").join(heads, ["key", "n"]).select("doc_id", "n", "head"), "set-members")
    heads_of = members.where("doc_id <> head").select(F.col("doc_id").alias("node"), F.col("head").alias("component")).distinct()

    def between_heads(rows: DataFrame) -> DataFrame:
        named = _relabelled(rows, heads_of, ("a", "b")).where("la <> lb")
        return named.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"))

    # A pair is found in many buckets, the more the more there are: from here on it comes once.
    met = saved(found.where("kind > 0").groupBy("a", "b").agg(F.max("kind").alias("kind")), "met-pairs")
    # Of every set that shares a signature: whether one of them was crowded.
    nodes = met.select(F.explode(F.array("a", "b")).alias("node"), "kind").groupBy("node").agg(F.bool_or(F.col("kind") == 2).alias("crowded"))
    ends = _relabelled(nodes, heads_of, ("node",)).groupBy(F.col("lnode").alias("doc_id")).agg(F.bool_or("crowded").alias("crowded"))
    ends = saved(ends, "candidate-ends")
    sets = saved(own.drop("key").join(ends.hint("merge"), "doc_id"), "candidate-sets")

    def only(ids: DataFrame) -> DataFrame:
        # The texts are shuffled again each time, but none of these shuffles outlives its step.
        return known.join(ids.hint("merge"), "doc_id", "left_semi")

    def whole(ids: DataFrame) -> DataFrame:
        return _sets(only(ids).withColumn("crowded", F.lit(False)), width).select("doc_id", "features")

    candidates, finer = met.select("a", "b"), None
    crowded = sets.where("crowded")
    words = crowded.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if words:
        again = only(crowded.select("doc_id")).select("doc_id", "text")
        finer = saved(share_signatures(again, SCHEMES[1], max(16, math.ceil(4 * words / SIGNATURES_PER_BUCKET)), percent, width, crowd), "signature-pairs")
        candidates = candidates.unionByName(finer.where("kind > 0").select("a", "b"))
    candidates = saved(between_heads(candidates.distinct()).distinct(), "candidate-pairs")
    first = _verified(candidates.groupBy("b").agg(F.min("a").alias("a")), sets, whole, percent)
    # Two steps down the first links: a label is only ever that of a set that is linked.
    one = first.groupBy("b").agg(F.min("a").alias("a")).select(F.col("b").alias("node"), F.col("a").alias("component"))
    up = one.select(F.col("node").alias("component"), F.col("component").alias("_up"))
    two = saved(one.join(up, "component", "left").select("node", F.coalesce("_up", "component").alias("component")), "first-labels")
    # Texts of rows with one doc_id are one node: their sets are linked.
    least = members.groupBy("doc_id").agg(F.min("head").alias("a"), F.max("head").alias("z")).where("a <> z").select("doc_id", "a")
    same = members.join(least, "doc_id").where("head <> a").select("a", F.col("head").alias("b"))
    links = first.unionByName(_verified(_apart(candidates, two), sets, whole, percent)).unionByName(same)
    labels = saved(components(links), "component-labels")
    if finer is not None:
        labels = _settle(finer.where("kind = 2").select("sig", "a", "b"), heads_of, labels, sets, percent, whole)
    placed = members.join(labels.withColumnRenamed("node", "head"), "head", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "head").alias("component_id"))
    nameless = by_batch(texts.where("doc_id IS NULL"), lambda ids, t: {
        "doc_id": ids, "n_shingles": [len(shingles(x, width)) for x in t], "component_id": ids}, "doc_id long, n_shingles long, component_id long")
    empty = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    return placed.select("doc_id", "n_shingles", empty).unionByName(nameless)


def keep_one_of_each(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE_WORDS) -> DataFrame:
    """The rows whose doc_id is the smallest of its component, and those without doc_id or words."""
    gone = near_duplicates(docs, percent, width).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def _folded(bits: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, folded to the size of the shortest."""
    lengths = np.fromiter(map(len, bits), np.int64, len(bits))
    size = int(lengths.min())
    out = np.empty((len(bits), size // 8), np.uint64)
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        own = np.frombuffer(b"".join([bits[k] for k in at]), np.uint64)
        out[at] = np.bitwise_xor.reduce(own.reshape(len(at), -1, size // 8), axis=1)
    return out


#: Of a set's signatures, the smallest so many go with it, by which its pairs are told from those of other signatures.
LEAST = [f"s{k}" for k in range(8)]


def _blocks_of(frame: pd.DataFrame) -> Iterator[tuple[int, dict]]:
    """The signature and the columns of each block, `least` as one array."""
    columns = {c: frame[c].to_numpy() for c in frame.columns if c not in LEAST} | {"least": frame[LEAST].to_numpy()}
    order = np.lexsort((columns["j"], columns["i"], columns["sig"]))
    columns = {c: v[order] for c, v in columns.items()}
    new = np.zeros(len(order), bool)
    for c in ("sig", "i", "j"):
        new[1:] |= columns[c][1:] != columns[c][:-1]
    for low, high in zip([0, *np.flatnonzero(new)], [*np.flatnonzero(new), len(order)]):
        yield int(columns["sig"][low]), {c: v[low:high] for c, v in columns.items()}


def _close_in_block(sig: int, block: dict, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of sets of different components whose sketches are close, those outside the main component with all.

    Pairs that share a smaller signature among their smallest ones are left to that one: at the smallest signature that
    two sets share they always come.
    """
    words, n, part, least = _folded(block["bits"].tolist()), block["n"], block["component"], block["least"]
    rest = block["rest"].astype(bool)
    mine, all_ = np.flatnonzero(rest), np.flatnonzero(~rest)
    for low in range(0, len(mine), 32):
        at = mine[low:low + 32]
        apart = np.bitwise_count(words[at][:, None, :] ^ words[all_][None, :, :]).sum(axis=2, dtype=np.int64)
        both, less, more = n[at][:, None] + n[all_], np.minimum(n[at][:, None], n[all_]), np.maximum(n[at][:, None], n[all_])
        good = (apart * (100 + percent) <= (100 - percent) * both) & (100 * less >= percent * more) & (part[at][:, None] != part[all_])
        x, y = np.nonzero(good)
        x, y = at[x], all_[y]
        elsewhere = np.zeros(len(x), bool)
        for c in range(len(LEAST)):
            elsewhere |= (least[x, c] < sig) & (least[y] == least[x, c][:, None]).any(axis=1)
        yield x[~elsewhere], y[~elsewhere]


def close_rows(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """(sig, node) of the sets that are close to one of another component, at most the rows there are."""
    sigs, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for sig, block in _blocks_of(frame):
        ends = [np.concatenate(found) for found in _close_in_block(sig, block, percent)]
        nodes.append(np.unique(block["node"][np.concatenate([np.zeros(0, np.int64), *ends])]))
        sigs.append(np.full(len(nodes[-1]), sig, np.int64))
    pairs = _distinct(np.stack([np.concatenate(sigs), np.concatenate(nodes)], axis=1))
    return pd.DataFrame({"sig": pairs[:, 0], "node": pairs[:, 1]})


def joining_links(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links (a, b) that join components, fewer than there are components: close pairs are compared by their whole sets unless
    links found before have joined them."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while x in up:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    out = []
    for sig, block in _blocks_of(frame):
        node, part, features = block["node"].tolist(), block["component"].tolist(), block["features"].tolist()
        for found in _close_in_block(sig, block, percent):
            for x, y in zip(*(ends.tolist() for ends in found)):
                p, q = top(part[x]), top(part[y])
                if p != q and linked(features[x], features[y], percent):
                    up[max(p, q)] = min(p, q)
                    out.append((min(node[x], node[y]), max(node[x], node[y])))
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


BLOCK_SETS = 1024
BLOCK_ROWS_PER_BUCKET = 20_000
#: Sets that go whole weigh one more for each so many features.
FEATURES_PER_ROW = 256


def _in_blocks(rows: DataFrame, traits: DataFrame, meet, schema: str, percent: int) -> DataFrame:
    """`meet` over blocks of the sets at each signature that are not in one component.

    `rows` has sig, node, component and load; `traits` what goes with a node. Sets outside a signature's largest component
    meet all of its sets, block by block; the number of tasks follows the load that all blocks have together, so a
    signature of any size is spread over tasks of bounded size.
    """
    sizes = rows.groupBy("sig", "component").agg(F.sum("load").alias("n"))
    open_ = sizes.groupBy("sig").agg(F.count("*").alias("k"), F.sum("n").alias("n_all"), F.max("n").alias("n_main"),
                                     F.max_by("component", F.struct("n", "component")).alias("main")).where("k > 1")
    open_ = saved(open_.select("sig", "main", "n_all", (F.col("n_all") - F.col("n_main")).alias("n_rest"), F.ceil(F.col("n_all") / BLOCK_SETS).cast("int").alias("n_j"),
                               F.ceil((F.col("n_all") - F.col("n_main")) / BLOCK_SETS).cast("int").alias("n_i")), "open-signatures")
    known = rows.drop("load").join(open_.drop("n_all", "n_rest"), "sig").join(traits, "node")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["sig", "component", *traits.columns]
    rest = known.where("component <> main").select(*columns, F.lit(True).alias("rest"), place("n_i").alias("i"), upto("n_j").alias("j"))
    all_ = known.select(*columns, F.lit(False).alias("rest"), place("n_j").alias("j"), upto("n_i").alias("i"))
    blocks = rest.unionByName(all_)
    weight = F.col("n_rest") * F.col("n_j") + F.col("n_all") * F.col("n_i")
    buckets = max(16, math.ceil(open_.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0] / BLOCK_ROWS_PER_BUCKET))
    blocks = blocks.withColumn("bucket", F.pmod(F.xxhash64("sig", "i", "j"), F.lit(buckets)).cast("int"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return meet(frame, percent)

    return blocks.groupBy("bucket").applyInPandas(run, schema).distinct()


def _settle(stars: DataFrame, heads_of: DataFrame, labels: DataFrame, sets: DataFrame, percent: int,
            whole: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Compares the sets at a crowded signature that are still in different components.

    Signatures with the same sets count as one. First the sets are found that are close to another one by their sketches;
    only these are compared whole, and only links that join components leave the tasks. Without `whole`, `sets` has features.
    """
    if whole is None:
        def whole(ids: DataFrame) -> DataFrame:
            return sets.select("doc_id", "features").join(ids.hint("merge"), "doc_id", "left_semi")

    both = stars.select("sig", F.explode(F.array("a", "b")).alias("node")).distinct()
    rows = _relabelled(both, heads_of, ("node",)).select("sig", F.col("lnode").alias("node")).distinct()
    rows = saved(_relabelled(rows, labels, ("node",)).select("sig", "node", F.col("lnode").alias("component")), "crowded-rows")
    # Leaving out any sub-partition in which none of the sets has a feature gives the same sets again.
    member = F.xxhash64("node")
    alike = rows.groupBy("sig").agg(F.bit_xor(member).alias("x"), F.sum(F.pmod(member, F.lit(1 << 31))).alias("s"), F.count("*").alias("n"))
    one = alike.groupBy("x", "s", "n").agg(F.min("sig").alias("sig")).select("sig")
    rows = saved(rows.join(one.hint("merge"), "sig", "left_semi"), "crowded-rows")
    least = rows.groupBy("node").agg(F.array_sort(F.collect_list("sig")).alias("s"))
    least = least.select("node", *[F.coalesce(F.get("s", F.lit(k)), F.lit((1 << 63) - 1)).alias(c) for k, c in enumerate(LEAST)])
    traits = saved(sets.select(F.col("doc_id").alias("node"), "n", "bits").join(least.hint("merge"), "node"), "set-traits")
    close = saved(_in_blocks(rows.withColumn("load", F.lit(1)), traits, close_rows, "sig long, node long", percent), "close-rows")
    if close.isEmpty():
        return labels
    load = traits.select("node", F.ceil(1 + F.col("n") / FEATURES_PER_ROW).alias("load"))
    rows = saved(rows.join(close.hint("merge"), ["sig", "node"], "left_semi").join(load, "node"), "close-rows")
    wanted = whole(rows.select(F.col("node").alias("doc_id")).distinct()).withColumnRenamed("doc_id", "node")
    close_sets = saved(traits.join(wanted.hint("merge"), "node"), "close-sets")
    more = saved(_in_blocks(rows, close_sets.hint("merge"), joining_links, "a long, b long", percent), "links")
    if more.isEmpty():
        return labels
    # The components found so far are the nodes that the new links join.
    top = saved(components(_relabelled(more, labels, ("a", "b")).select(F.col("la").alias("a"), F.col("lb").alias("b"))), "component-labels")
    up = top.select(F.col("node").alias("component"), F.col("component").alias("_up"))
    moved = labels.join(up, "component", "left").select("node", F.coalesce("_up", "component").alias("component"))
    return saved(moved.unionByName(top), "component-labels")
