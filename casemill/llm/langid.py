"""Language identification by unigram pieces, summed over all segmentations.

The pieces of a fixed public vocabulary have a probability in each language. A word's probability is the sum over all
ways to cut it into pieces, found by the forward algorithm; a text's is the product over its words. The probabilities
are learned by expectation maximisation: forward and backward sums give the expected uses of every piece in labelled
words, and these become the next probabilities.

Learned from at most `DOCUMENTS_PER_LANGUAGE` documents of each language, chosen by a hash of doc_id among the rows that
`learnable` allows; predictions see nothing but the text, all of it. Null texts and texts without a letter are `und`
with score 0; without labelled rows every text is. Repeated rows and null doc_ids are predicted like others; ties go to
the language that sorts first.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.llm.common import carried, ready, rows_of, saved, texts_of, trim_memory

PIECE_VOCAB = public_tokenizers.path("piece_bpe_32k.model")
WORD_MARK = "▁"
UNKNOWN = "und"
#: Labelled documents that each language is learned from, at most, and of all languages together.
DOCUMENTS_PER_LANGUAGE = 200
SAMPLE_DOCUMENTS = 20_000
ROUNDS = 3
#: Of a character that no piece has, in any language; and the pseudo-count of every piece.
FLOOR = 1e-7
SMOOTHING = 0.05
CHUNK_CHARS = 2_000_000
_BASE = 0x9E3779B97F4A7C15
_SLOTS = 20

WORDS = regex.compile(r"\p{L}+")
LETTER = regex.compile(r"\p{L}")


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case."""
    return WORDS.findall((text or "").lower())


@lru_cache(maxsize=2)
def pieces(path: str = PIECE_VOCAB) -> tuple[str, ...]:
    """The pieces that words can have: lower-case letters, with or without the mark of a word's start."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return tuple(sorted({p for p in own if (p == WORD_MARK or WORDS.fullmatch(p.removeprefix(WORD_MARK))) and p == p.lower()}))


def _prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes of each row, the empty one first."""
    out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    for i in range(codes.shape[1]):
        out[:, i + 1] = out[:, i] * np.uint64(_BASE) + codes[:, i] * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(1)
    return out


class Pieces:
    """Finds pieces by the hash of their characters."""

    def __init__(self, own: tuple[str, ...]):
        self.size, self.longest = len(own), max(map(len, own))
        keys = np.array([_prefix_hash(np.array([[ord(c) for c in p]], np.uint64))[0, -1] for p in own], np.uint64)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have one hash")
        self.powers = [np.uint64(pow(_BASE, k, 1 << 64)) for k in range(self.longest + 1)]
        # Open addressing with a bounded number of steps, so that a lookup is a few array reads.
        self.keys = np.zeros(1 << _SLOTS, np.uint64)
        self.ids = np.full(1 << _SLOTS, -1, np.int64)
        self.steps = 1
        for i, key in enumerate(keys):
            slot, steps = int(key) >> (64 - _SLOTS), 1
            while self.ids[slot] >= 0:
                slot, steps = (slot + 1) % (1 << _SLOTS), steps + 1
            self.keys[slot], self.ids[slot], self.steps = key, i, max(self.steps, steps)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each piece, -1 for what is none."""
        slot = (keys >> np.uint64(64 - _SLOTS)).astype(np.int64)
        out = np.full(len(keys), -1, np.int64)
        for step in range(self.steps):
            at = (slot + step) & ((1 << _SLOTS) - 1)
            hit = (self.keys[at] == keys) & (self.ids[at] >= 0)
            out[hit] = self.ids[at[hit]]
        return out


@lru_cache(maxsize=2)
def piece_finder(path: str = PIECE_VOCAB) -> Pieces:
    return Pieces(pieces(path))


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of words of one length, and their characters with the mark in front."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        for low in range(0, len(at), 1 << 16):
            some = at[low:low + (1 << 16)]
            codes = np.frombuffer("".join([WORD_MARK + words[i] for i in some]).encode("utf-32-le"), "<u4")
            yield some, codes.reshape(len(some), size + 1).astype(np.uint64)


def forward(codes: np.ndarray, table: np.ndarray, finder: Pieces) -> np.ndarray:
    """Log probability of each word in each language; `table` has a row for each piece and one of zeros at the end."""
    n, size = codes.shape
    hashes = _prefix_hash(codes)
    alpha = {0: np.ones((n, table.shape[1]))}
    scale = np.zeros((n, 1))
    for i in range(1, size + 1):
        total = np.zeros((n, table.shape[1]))
        for k in range(1, min(finder.longest, i) + 1):
            found = finder.find(hashes[:, i] - hashes[:, i - k] * finder.powers[k])
            hit = np.flatnonzero(found >= 0)
            if len(hit):
                total[hit] += alpha[i - k][hit] * table[found[hit]]
            if k == 1 and len(hit) < n:
                lone = np.flatnonzero(found < 0)
                total[lone] += alpha[i - 1][lone] * FLOOR
        alpha[i] = np.maximum(total, 1e-290)
        alpha.pop(i - finder.longest, None)
        if i % 8 == 0:
            top = alpha[i].max(axis=1, keepdims=True)
            scale += np.log(top)
            for j in alpha:
                alpha[j] = np.maximum(alpha[j] / top, 1e-290)
    return np.log(alpha[size]) + scale


def expected_uses(word: str, probability: dict[str, float], longest: int) -> dict[str, float]:
    """How often each piece is used in a word, over all segmentations by their probability.

    At every place the forward sum is divided out, so that it stands at one; the backward sums are kept by the same
    factors, and a word of any length stays within the range of numbers.
    """
    text, n = WORD_MARK + word, len(word) + 1
    factor = [1.0] * (n + 1)
    edges: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]  # by end: where a piece begins, and its scaled probability
    for j in range(1, n + 1):
        between, total = 1.0, 0.0
        for k in range(1, min(longest, j) + 1):
            p = probability.get(text[j - k:j], FLOOR if k == 1 else 0.0) * between
            if p:
                edges[j].append((j - k, p))
                total += p
            between *= factor[j - k]
        factor[j] = 1.0 / total
    behind = [0.0] * n + [1.0]
    out: dict[str, float] = {}
    for j in range(n, 0, -1):
        for i, p in edges[j]:
            share = p * factor[j] * behind[j]
            behind[i] += share
            if text[i:j] in probability:
                out[text[i:j]] = out.get(text[i:j], 0.0) + share
    return out


class Model:
    """Languages in sorted order and the log-free piece table, a row for each piece."""

    def __init__(self, languages: list[str], table: np.ndarray, path: str = PIECE_VOCAB):
        self.languages, self.path = languages, path
        self.table = table

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        low = 0
        while low < len(texts):
            high, chars = low, 0
            while high < len(texts) and (high == low or chars + len(texts[high] or "") <= CHUNK_CHARS):
                chars += len(texts[high] or "")
                high += 1
            for logs in self._logs(texts[low:high]):
                if logs is None or not self.languages:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    share = np.exp(logs - logs.max())
                    k = int(share.argmax())
                    names.append(self.languages[k])
                    scores.append(float(share[k] / share.sum()))
            low = high
        return names, scores

    def _logs(self, texts: list[str | None]) -> list[np.ndarray | None]:
        number: dict[str, int] = {}
        places, ends = [], [0]
        for text in texts:
            own = words_of(text)
            places.append(np.fromiter((number.setdefault(w, len(number)) for w in own), np.int64, len(own)))
            ends.append(ends[-1] + len(own))
        words = list(number)
        logs = np.zeros((len(words), len(self.languages)))
        for at, codes in _by_length(words):
            logs[at] = forward(codes, self.table, piece_finder(self.path))
        return [logs[p].sum(axis=0) if len(p) else None for p in places]


def learnable() -> Column:
    """Rows that may teach: the checksum of doc_id as text leaves other than 1 at division by 3, and lang is given."""
    return (~held_out()) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, path: str = PIECE_VOCAB, per_language: int = DOCUMENTS_PER_LANGUAGE, rounds: int = ROUNDS) -> Model:
    """Piece probabilities from a bounded sample of the rows that may teach."""
    ready(docs.sparkSession)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).where(learnable())
    n_languages = max(1, known.select("lang").distinct().count())
    per = max(1, min(per_language, SAMPLE_DOCUMENTS // n_languages))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    sample = known.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= per).select("doc_id", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.update((lang, w) for w in words_of(text))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[i] for k in held], pa.string()) for i in (0, 1)] + [pa.array(list(held.values()), pa.int64())], names=["lang", "word", "n"])

    # At most SAMPLE_DOCUMENTS rows of a number and a language name.
    chosen = texts_of(docs).join(F.broadcast(sample), "doc_id").select("lang", "text")
    counted = saved(chosen.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    languages = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    own = pieces(path)
    table = np.full((len(own) + 1, len(languages)), 1.0 / len(own))
    number, longest = {p: i for i, p in enumerate(own)}, max(map(len, own))
    for _ in range(rounds if languages else 0):
        shared = docs.sparkSession.sparkContext.broadcast(table)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = {lang: dict(zip(pieces(path), shared.value[:, k].tolist())) for k, lang in enumerate(languages)}
            sums: dict[tuple[str, str], float] = {}
            for batch in batches:
                for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                    for piece, uses in expected_uses(word, now[lang], longest).items():
                        sums[lang, piece] = sums.get((lang, piece), 0.0) + n * uses
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[i] for k in sums], pa.string()) for i in (0, 1)] + [pa.array(list(sums.values()), pa.float64())], names=["lang", "piece", "n"])

        uses = counted.repartition("word").mapInArrow(expect, "lang string, piece string, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        table = np.full((len(own) + 1, len(languages)), SMOOTHING)
        for row in uses.collect():  # one row for each piece and language at most
            table[number[row["piece"]], languages.index(row["lang"])] += round(row["n"], 6)
        table[-1] = 0.0
        table /= table.sum(axis=0)
    return Model(languages, table, path)


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows with `_lang` and `_score`."""
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(text: pd.Series) -> pd.DataFrame:
        names, scores = shared.value.predict(text.tolist())
        trim_memory()
        return pd.DataFrame({"lang": names, "score": scores}, columns=["lang", "score"])

    said = F.pandas_udf(predict, "lang string, score double")(F.col("text").cast("string"))
    return docs.withColumn("_said", said).withColumns({"_lang": F.col("_said.lang"), "_score": F.col("_said.score")}).drop("_said")


def language_predictions(docs: DataFrame, path: str = PIECE_VOCAB) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    return predicted(texts_of(docs), fit(docs, path)).select(
        "doc_id", held_out().alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


MIN_SCORE = 0.5


def keep_known(docs: DataFrame, path: str = PIECE_VOCAB, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows whose text has a language, with a score of `min_score` at least."""
    known = (F.col("_lang") != UNKNOWN) & (F.col("_score") >= min_score)
    return rows_of(predicted(carried(docs), fit(docs, path)).where(known))
