"""Byte-level BPE encoding and decoding as a tree of joins.

A text is cut in halves down to leaves; leaves are encoded alone, and neighbours are joined by encoding a window around
the cut anew. Inside a text, a blank that follows a character other than a blank always begins a new match of the
splitting pattern, whatever stands before or behind: no alternative of the pattern runs from a non-blank into a blank.
So tokens before the last such place left of the cut, and tokens from the first such place right of it, are those of the
whole text, and only what lies between is encoded again. The window grows until it reaches such a place on either side,
or the end of its half.

Decoding joins the bytes of halves in the same way. Nulls count as empty texts, which have no ids; repeated rows and null
doc_ids are rows like others; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from casemill.llm.common import by_batch, texts_of
from casemill.llm.vocab import RANK_VOCAB, rank_encoding

LEAF_CHARS = 2048
WINDOW_CHARS = 64
LEAF_IDS = 4096


class TreeCoder:
    """Encodes and decodes with the ranks at `path`."""

    def __init__(self, path: str = RANK_VOCAB, leaf_chars: int = LEAF_CHARS):
        self.flat = rank_encoding(path)
        self.leaf_chars = leaf_chars
        pairs = [(i, self.flat.decode_single_token_bytes(i)) for i in range(self.flat.n_vocab)]
        self.tokens = [token for _, token in pairs]
        self.sizes = np.array([len(token) for token in self.tokens], np.int64)

    @staticmethod
    def _starts_match(text: str, at: int) -> bool:
        return text[at] in " \n" and not text[at - 1].isspace()

    def _last_start(self, text: str, low: int, cut: int) -> int:
        """The last place in (low, cut) where a match begins in any context, else low; looked for in growing windows."""
        reach = WINDOW_CHARS
        high = cut
        while high > low:
            bottom = max(low, cut - reach)
            at = max(text.rfind(" ", bottom, high), text.rfind("\n", bottom, high))
            while at > low:
                if self._starts_match(text, at):
                    return at
                at = max(text.rfind(" ", bottom, at), text.rfind("\n", bottom, at))
            high, reach = bottom, reach * 2
        return low

    def _first_start(self, text: str, cut: int, high: int) -> int:
        """The first place in (cut, high) where a match begins in any context, else high."""
        reach, low = WINDOW_CHARS, cut + 1
        while low < high:
            top = min(high, cut + reach)
            found = [at for at in range(low, top) if self._starts_match(text, at)]
            if found:
                return found[0]
            low, reach = top, reach * 2
        return high

    def _prefix_ids(self, ids: np.ndarray, drop: int) -> int:
        """How many ids are left when those that make up the last `drop` bytes go."""
        return self._suffix_start(ids[::-1], drop, backwards=True)

    def _suffix_start(self, ids: np.ndarray, skip: int, backwards: bool = False) -> int:
        """How many ids make up the first `skip` bytes; counted from the end of the ids if backwards."""
        n, look = 0, 64
        while True:
            sizes = np.cumsum(self.sizes[ids[:look]])
            n = int(np.searchsorted(sizes, skip, side="left")) + 1 if skip else 0
            if not skip or n <= len(sizes):
                break
            look *= 4
        return len(ids) - n if backwards else n

    def _join(self, text: str, low: int, cut: int, high: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        a, b = self._last_start(text, low, cut), self._first_start(text, cut, high)
        window = np.array(self.flat.encode_ordinary(text[a:b]), np.int64)
        keep_left = self._prefix_ids(left, len(text[a:cut].encode()))
        skip_right = self._suffix_start(right, len(text[cut:b].encode()))
        return np.concatenate([left[:keep_left], window, right[skip_right:]])

    def _encode(self, text: str, low: int, high: int) -> np.ndarray:
        if high - low <= self.leaf_chars:
            return np.array(self.flat.encode_ordinary(text[low:high]), np.int64)
        cut = (low + high) // 2
        return self._join(text, low, cut, high, self._encode(text, low, cut), self._encode(text, cut, high))

    def encode(self, text: str | None) -> np.ndarray:
        return self._encode(text or "", 0, len(text or ""))

    def decode(self, ids) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_coders: dict[tuple, TreeCoder] = {}


def tree_coder(path: str = RANK_VOCAB, leaf_chars: int = LEAF_CHARS) -> TreeCoder:
    """One coder for each vocabulary and Python process."""
    if (path, leaf_chars) not in _coders:
        _coders[path, leaf_chars] = TreeCoder(path, leaf_chars)
    return _coders[path, leaf_chars]


def encoded(docs: DataFrame, path: str = RANK_VOCAB, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """doc_id, ids."""

    def rows(doc_ids: list, texts: list) -> dict:
        coder = tree_coder(path, leaf_chars)
        return {"doc_id": doc_ids, "ids": [coder.encode(t) for t in texts]}

    return by_batch(texts_of(docs), rows, "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, path: str = RANK_VOCAB) -> DataFrame:
    """doc_id, bytes of a table with doc_id and ids; null ids give null bytes."""

    def rows(doc_ids: list, ids: list) -> dict:
        coder = tree_coder(path)
        return {"doc_id": doc_ids, "bytes": [None if i is None else coder.decode(i) for i in ids]}

    return by_batch(tokens.select("doc_id", "ids"), rows, "doc_id long, bytes binary")


def coding_digests(docs: DataFrame, path: str = RANK_VOCAB, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: both ways in one pass over the texts."""

    def rows(doc_ids: list, texts: list) -> dict:
        coder = tree_coder(path, leaf_chars)
        out: dict[str, list] = {"doc_id": doc_ids, "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in texts:
            ids = coder.encode(text).tolist()
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(coder.decode(ids)).hexdigest())
        return out

    return by_batch(texts_of(docs), rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
