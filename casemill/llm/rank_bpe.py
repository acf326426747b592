"""BPE encoding and decoding with a contiguous rank array for each word.

A text is cut into words by the splitting pattern, special tokens first. For a word the boundaries of its parts and the
rank that joining each part with its right neighbour would have stand in two short arrays; the least rank is looked for by
scanning, its boundary deleted and the ranks of the two neighbours found anew, until no join is known. Words repeat, so
ids of short ones are kept, up to a fixed number of words. Over a word of `SCAN_BYTES` or more the scans would cost its
length squared; there the same joins are taken from a heap.

Python's `regex` and the tokenizers library know different versions of Unicode, so a text with characters outside ranges
that both have long known is cut by the library's own splitter.

Nulls count as empty texts, which have no ids and decode to an empty text. Repeated rows and rows without doc_id are rows
like others; an empty table gives no rows; other columns are not read. Any length of text or word is encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from casemill.llm.common import by_batch, texts_of
from casemill.llm.vocab import DOCUMENT_VOCAB, byte_alphabet

#: From this number of bytes on, joins come from a heap.
SCAN_BYTES = 96
#: Words whose ids are kept, and the longest of them in characters.
KEPT_WORDS, KEPT_CHARS = 1 << 18, 48
#: A character outside ranges whose classes have not changed since Unicode 6.
RARE = re.compile("[^\x00-ԣ‐-‧‰-⁞₠-₵、-〠ぁ-ゖァ-ヺ一-龥가-힣！-～]")
NEVER = 1 << 60


class WordIds(dict):
    """The packed ids of words, found when first asked for."""

    def __init__(self, coder: "RankCoder"):
        super().__init__()
        self.coder = coder

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.coder.word_ids(word.encode()), "<u4").tobytes()
        if len(word) <= KEPT_CHARS:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = ids
        return ids


class RankCoder:
    """Encodes and decodes as the JSON tokenizer at `path` does without special tokens added."""

    def __init__(self, path: str = DOCUMENT_VOCAB):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        raw = lambda token: bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.ranks: dict[bytes, int] = {}
        for rank, (left, right) in enumerate(spec["model"]["merges"]):
            self.ranks.setdefault(raw(left) + raw(right), rank)
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        by_length = sorted(self.special, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, by_length)) + ")") if by_length else None
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.words = WordIds(self)

    @property
    def splitter(self):
        from tokenizers import pre_tokenizers

        return pre_tokenizers.ByteLevel(add_prefix_space=False)

    def split(self, text: str) -> list[str]:
        if text.isascii() or not RARE.search(text):
            return self.pattern.findall(text)
        return [text[low:high] for _, (low, high) in self.splitter.pre_tokenize_str(text)]

    def word_ids(self, word: bytes) -> list[int]:
        cuts = self.scanned(word) if len(word) < SCAN_BYTES else self.heaped(word)
        return [self.ids[word[low:high]] for low, high in zip(cuts, cuts[1:])]

    def scanned(self, word: bytes) -> list[int]:
        """Part boundaries, by scans of the rank array."""
        cuts = list(range(len(word) + 1))
        rank = self.ranks.get
        ranks = [rank(word[i:i + 2], NEVER) for i in range(len(word) - 1)]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            at = ranks.index(least)
            del cuts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = rank(word[cuts[at]:cuts[at + 2]], NEVER)
            if at:
                ranks[at - 1] = rank(word[cuts[at - 1]:cuts[at + 1]], NEVER)
        return cuts

    def heaped(self, word: bytes) -> list[int]:
        """The same boundaries, with the joins in a heap by rank and place; outdated ones are skipped."""
        n, rank = len(word), self.ranks.get
        after, before = list(range(1, n + 2)), list(range(-1, n))
        ends = [i + 2 for i in range(n)]  # where the join now known for a part ends; 0 if the part is gone
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(word[i:i + 2])) is not None]
        heapq.heapify(heap)

        def renew(i: int) -> None:
            ends[i] = 0
            if after[i] < n:
                ends[i] = after[after[i]]
                r = rank(word[i:ends[i]])
                if r is not None:
                    heapq.heappush(heap, (r, i, ends[i]))

        while heap:
            _, i, end = heapq.heappop(heap)
            if ends[i] != end:
                continue
            ends[after[i]] = 0
            after[i] = end
            if end < n:
                before[end] = i
            renew(i)
            if i:
                renew(before[i])
        cuts, i = [0], 0
        while i < n:
            i = after[i]
            cuts.append(i)
        return cuts

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        pieces = self.marks.split(text or "") if self.marks else [text or ""]
        out = []
        for k, piece in enumerate(pieces):
            if k % 2:
                out.append(np.array([self.special[piece]], "<u4").tobytes())
            elif piece:
                out.extend(map(self.words.__getitem__, self.split(piece)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def rank_coder(path: str = DOCUMENT_VOCAB) -> RankCoder:
    """One coder for each vocabulary and Python process."""
    return RankCoder(path)


def encoded(docs: DataFrame, path: str = DOCUMENT_VOCAB) -> DataFrame:
    """doc_id, ids."""

    def rows(doc_ids: list, texts: list) -> dict:
        coder = rank_coder(path)
        return {"doc_id": doc_ids, "ids": [np.frombuffer(coder.encode(t), "<u4").astype(np.int32) for t in texts]}

    return by_batch(texts_of(docs), rows, "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, path: str = DOCUMENT_VOCAB) -> DataFrame:
    """doc_id, text of a table with doc_id and ids; null ids give a null text."""

    def rows(doc_ids: list, ids: list) -> dict:
        coder = rank_coder(path)
        return {"doc_id": doc_ids, "text": [None if i is None else coder.decode(np.array(i, "<u4").tobytes()) for i in ids]}

    return by_batch(tokens.select("doc_id", "ids"), rows, "doc_id long, text string")


def coding_digests(docs: DataFrame, path: str = DOCUMENT_VOCAB) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: both ways in one pass over the texts."""

    def rows(doc_ids: list, texts: list) -> dict:
        coder = rank_coder(path)
        ids = [coder.encode(t) for t in texts]
        return {"doc_id": doc_ids, "n_tokens": [len(i) // 4 for i in ids], "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
                "decoded_sha256": [hashlib.sha256(coder.decode(i).encode()).hexdigest() for i in ids]}

    return by_batch(texts_of(docs), rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
