"""Groups of spelling variants by k-d trees over letter-count vectors.

One inserted, deleted or replaced letter moves a word's vector of letter counts by an L1 distance of at most two: exactly
two between words of one length, exactly one between neighbouring lengths. So the near words of a word lie in three range
searches, one for each pair of lengths.

A top tree, cut at medians of a bounded sample of words, divides the space of vectors into boxes; every word lives in the
box of its vector and visits, for each of the three lengths, the boxes within reach. In each pair of length and box a k-d
tree over the words that live there answers the visitors together: a branch goes on with the visitors whose distance to
its bounding box is in reach, and words left over are compared by letter order. A word's near words are counted and the
largest chosen inside the task, so no pair of words is ever a row. A box that holds more words than planned, such as many
words of the same letters, is dealt out in blocks of both sides.

Words are counted inside tasks first, so a frequent one is a few rows. Null and empty texts have no words; every row
counts, repeated ones too; in rows without doc_id no letter is deleted. Empty tables give no rows; other columns are not
read; runs and texts of any length count whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import saved, texts_of, trim_memory

MIN_LETTERS, MIN_COUNT, RATIO = 6, 5, 5
#: One (document, run) in so many loses a letter.
DELETED = 199
#: Words in the sample for the top tree, words planned for a box, words of a block, words of a leaf in a task.
SAMPLE_WORDS, BOX_WORDS, BLOCK_WORDS, LEAF_WORDS = 50_000, 8_000, 16_000, 256
#: Distinct words that a task counts before it hands them on.
TALLY_WORDS = 200_000

#: Of each code point below U+0100, its place in the vector. Letters that are not a-z share eight places: adding counts up
#: never makes a distance larger.
PLACES = 26 + 8
PLACE_OF = np.array([c - 97 if 97 <= c < 123 else 26 + c % 8 for c in range(256)], np.int64)


# ---- words ----

def run_pattern(min_letters: int) -> re.Pattern:
    """Whole runs of at least so many letters, in texts with A-Z lower-cased."""
    return re.compile(f"[a-zÀ-ÿ]{{{min_letters},}}")


def word_counts(docs: DataFrame, min_letters: int = MIN_LETTERS, deleted: int = DELETED) -> DataFrame:
    """word, n: partial counts of words with at least `min_letters` letters."""

    def tallied(tally: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array(list(tally.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, crc, tally = run_pattern(min_letters).findall, zlib.crc32, Counter()
        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                runs = Counter(find((value.as_py() or "").encode().lower().decode()))
                seed = crc(f"{doc_id}:".encode())
                for word, n in runs.items():
                    h = crc(word.encode(), seed)
                    if h % deleted == 0 and doc_id is not None:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < min_letters:
                            continue
                    tally[word] += n
                if len(tally) >= TALLY_WORDS:
                    yield tallied(tally)
                    tally = Counter()
        yield tallied(tally)
        trim_memory()

    return docs.mapInArrow(run, "word string, n long")


# ---- vectors ----

def codes_of(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)


def letter_counts(words: list[str]) -> np.ndarray:
    """A row of letter counts for each word. Counts end at 255, which never makes a distance larger."""
    rows = np.repeat(np.arange(len(words)), [len(w) for w in words])
    places = rows * PLACES + PLACE_OF[codes_of(words) & 0xFF]
    return np.minimum(np.bincount(places, minlength=len(words) * PLACES), 255).astype(np.int16).reshape(len(words), PLACES)


def marks(vectors: np.ndarray) -> np.ndarray:
    """Which places have a count of one or more, and which of a-z of two or more, as bits: two vectors are at least as far
    apart as the number of bits in which they differ."""
    bits = np.zeros((len(vectors), 64), bool)
    bits[:, :PLACES] = vectors > 0
    bits[:, PLACES:PLACES + 26] = vectors[:, :26] > 1
    return np.packbits(bits, axis=1).view(np.uint64).ravel()


def halves(vectors: np.ndarray) -> tuple[int, int] | None:
    """The place whose counts spread most and a cut that leaves words on both sides; None if all are equal."""
    spread = vectors.astype(np.float32).var(axis=0)
    place = int(spread.argmax())
    if spread[place] == 0:
        return None
    values = vectors[:, place]
    cut = int(np.median(values))
    return place, cut if cut < values.max() else cut - 1


# ---- boxes ----

#: A tree is (place, cut, low side, high side), or the number of a box.
def top_tree(vectors: np.ndarray, boxes: int):
    numbers = iter(range(1 << 30))

    def grown(own: np.ndarray, share: int):
        split = halves(own) if share > 1 and len(own) > 1 else None
        if split is None:
            return next(numbers)
        low = own[:, split[0]] <= split[1]
        left = min(max(1, round(share * low.mean())), share - 1)
        return (*split, grown(own[low], left), grown(own[~low], share - left))

    return grown(vectors, boxes)


def homes(tree, vectors: np.ndarray) -> np.ndarray:
    """The box of each vector."""
    out = np.zeros(len(vectors), np.int64)

    def walk(node, at: np.ndarray) -> None:
        if isinstance(node, int):
            out[at] = node
            return
        place, cut, low, high = node
        side = vectors[at, place] <= cut
        walk(low, at[side])
        walk(high, at[~side])

    walk(tree, np.arange(len(vectors)))
    return out


def boxes_in_reach(tree, vectors: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, box) of the boxes whose L1 distance to a vector is at most `radius`."""
    rows, found = [], []

    def walk(node, at: np.ndarray, bounds: dict[int, tuple[int, int]]) -> None:
        if bounds:
            away = np.zeros(len(at), np.int64)
            for place, (least, most) in bounds.items():
                own = vectors[at, place].astype(np.int64)
                away += np.maximum(least - own, 0) + np.maximum(own - most, 0)
            at = at[away <= radius]
        if not len(at):
            return
        if isinstance(node, int):
            rows.append(at)
            found.append(np.full(len(at), node, np.int64))
            return
        place, cut, low, high = node
        least, most = bounds.get(place, (0, 255))
        walk(low, at, bounds | {place: (least, min(most, cut))})
        walk(high, at, bounds | {place: (max(least, cut + 1), most)})

    walk(tree, np.arange(len(vectors)), {})
    return (np.concatenate(rows), np.concatenate(found)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def radius_of(length: int, other: int) -> int:
    return 2 if length == other else 1


DEALT = "length int, box long, home boolean, word string, n long"


def dealt(words: DataFrame, tree, min_letters: int) -> DataFrame:
    """Each word at home, and as a visitor of the boxes in reach for its own length and the two next to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                own, n = np.array(part.column(0).to_pylist(), object), part.column(1).to_numpy()
                if not len(own):
                    continue
                vectors, lengths = letter_counts(own.tolist()), np.array([len(w) for w in own], np.int64)
                rows, boxes, sizes, home = [np.arange(len(own))], [homes(tree, vectors)], [lengths], [np.ones(len(own), bool)]
                for step in (-1, 0, 1):
                    at, box = boxes_in_reach(tree, vectors, radius_of(0, step))
                    rows.append(at)
                    boxes.append(box)
                    sizes.append(lengths[at] + step)
                    home.append(np.zeros(len(at), bool))
                rows, boxes, sizes, home = map(np.concatenate, (rows, boxes, sizes, home))
                good = sizes >= min_letters
                rows, boxes, sizes, home = rows[good], boxes[good], sizes[good], home[good]
                columns = [pa.array(sizes, pa.int32()), pa.array(boxes, pa.int64()), pa.array(home), pa.array(own[rows], pa.string()), pa.array(n[rows], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in DEALT.split(", ")])
        trim_memory()

    return words.select("word", "n").mapInArrow(run, DEALT)


# ---- range search ----

def in_range(targets: np.ndarray, visitors: np.ndarray, radius: int, leaf: int = LEAF_WORDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(visitor, target) rows with an L1 distance of at most `radius`, leaf by leaf of a k-d tree over the targets."""
    target_marks, visitor_marks = marks(targets), marks(visitors)
    work = [(np.arange(len(targets)), np.arange(len(visitors)))]
    while work:
        own, guests = work.pop()
        held = targets[own]
        least, most = held.min(axis=0), held.max(axis=0)
        kept = []
        for low in range(0, len(guests), 4096):
            at = guests[low:low + 4096]
            seen = visitors[at]
            kept.append(at[(np.maximum(least - seen, 0) + np.maximum(seen - most, 0)).sum(axis=1) <= radius])
        guests = np.concatenate(kept) if kept else guests
        if not len(guests):
            continue
        split = halves(held) if len(own) > leaf else None
        if split is not None:
            side = held[:, split[0]] <= split[1]
            work += [(own[side], guests), (own[~side], guests)]
            continue
        for first in range(0, len(own), leaf):
            some = own[first:first + leaf]
            for low in range(0, len(guests), 1024):
                at = guests[low:low + 1024]
                x, y = np.nonzero(np.bitwise_count(visitor_marks[at][:, None] ^ target_marks[some][None, :]) <= radius)
                x, y = at[x], some[y]
                good = np.abs(visitors[x] - targets[y]).sum(axis=1) <= radius
                if good.any():
                    yield x[good], y[good]


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether rows of code points differ by exactly one replaced letter, or one more letter in `long`."""
    n = short.shape[1]
    if n == long.shape[1]:
        return (short != long).sum(axis=1) == 1
    ahead = np.cumprod(short == long[:, :n], axis=1).sum(axis=1)
    behind = np.cumprod((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return ahead + behind >= n


PARTIAL = "word string, n_near long, best_n long, best string"


def searched(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
    """Of each visitor with a near word in this block: how many, and the one of largest n, the smallest of several."""
    length = key[0].as_py()
    words_of = lambda home: block.filter(pc.equal(block["home"], home))
    live = words_of(True)
    out: dict[str, list] = {"word": [], "n_near": [], "best_n": [], "best": []}
    if live.num_rows:
        # By falling n and rising word, so that the first of several is the best.
        ranked = sorted(zip(live["word"].to_pylist(), live["n"].to_pylist()), key=lambda x: (-x[1], x[0]))
        targets, sizes = [w for w, _ in ranked], [n for _, n in ranked]
        vectors, codes = letter_counts(targets), codes_of(targets).reshape(len(targets), length)
        guests = words_of(False)["word"].to_pylist()
        for step in (-1, 0, 1):
            words = [w for w in guests if len(w) == length + step]
            if not words:
                continue
            own = codes_of(words).reshape(len(words), length + step)
            near, first = np.zeros(len(words), np.int64), np.full(len(words), len(targets), np.int64)
            for v, t in in_range(vectors, letter_counts(words), radius_of(0, step)):
                good = one_edit(codes[t], own[v]) if step > 0 else one_edit(own[v], codes[t])
                np.add.at(near, v[good], 1)
                np.minimum.at(first, v[good], t[good])
            at = np.flatnonzero(near)
            out["word"] += [words[k] for k in at]
            out["n_near"] += near[at].tolist()
            out["best_n"] += [sizes[k] for k in first[at]]
            out["best"] += [targets[k] for k in first[at]]
    trim_memory()
    return pa.table({"word": pa.array(out["word"], pa.string()), "n_near": pa.array(out["n_near"], pa.int64()),
                     "best_n": pa.array(out["best_n"], pa.int64()), "best": pa.array(out["best"], pa.string())})


def near_words(words: DataFrame, min_letters: int = MIN_LETTERS, box_words: int = BOX_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """word, n_near, best_n, best for each word with near words; `words` has distinct words and n, and is read more than once."""
    total = words.count()
    boxes = math.ceil(total / box_words)
    tree = 0
    if boxes > 1:
        # About SAMPLE_WORDS rows, chosen by hash.
        sample = sorted(r["word"] for r in words.where(F.pmod(F.xxhash64("word"), F.lit(total)) < SAMPLE_WORDS).select("word").collect())
        tree = top_tree(letter_counts(sample), max(1, min(boxes, len(sample) // 4)))
    rows = saved(dealt(words, tree, min_letters), "spelling-boxes")
    # Blocks of a box by the words that live in it: both sides are dealt out, and every block of one meets every block of the other.
    sizes = rows.where("home").groupBy("length", "box").agg(F.ceil(F.count("*") / block_words).cast("int").alias("blocks"))
    placed = rows.join(sizes, ["length", "box"]).withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    live, guest = (F.when(F.col("home"), a).otherwise(b) for a, b in ((F.col("own"), F.col("other")), (F.col("other"), F.col("own"))))
    blocks = placed.select("length", "box", live.alias("live"), guest.alias("guest"), "home", "word", "n")
    partial = blocks.groupBy("length", "box", "live", "guest").applyInArrow(searched, PARTIAL)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return partial.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_best")).select(
        "word", "n_near", (-F.col("_best.less")).alias("best_n"), F.col("_best.word").alias("best"))


def with_roots(forms: DataFrame, max_n: int, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """`forms` (word, form) -> word, root for the words that have a form. n grows by `ratio` with every step, so paths are short."""
    steps = math.floor(math.log(max(max_n, min_count) / min_count, ratio)) + 1
    up = saved(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        above = up.select(F.col("word").alias("root"), F.col("root").alias("_above"))
        up = saved(up.join(above, "root", "left").select("word", F.coalesce("_above", "root").alias("root")), "spelling-roots")
    return up


def spelling_groups(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, ratio: int = RATIO, deleted: int = DELETED,
                    box_words: int = BOX_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word with at least `min_count` occurrences."""
    counts = word_counts(texts_of(docs), min_letters, deleted).groupBy("word").agg(F.sum("n").alias("n"))
    words = saved(counts.where(F.col("n") >= min_count), "spelling-words")
    near = near_words(words, min_letters, box_words, block_words)
    larger = F.col("best_n") >= ratio * F.col("n")
    forms = saved(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(larger, F.col("best")).alias("form"),
        F.when(larger, F.col("best_n")).alias("form_n")), "spelling-forms")
    most = words.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    roots = with_roots(forms, most, min_count, ratio)
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
