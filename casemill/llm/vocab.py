"""Byte-level BPE vocabularies by path, loaded once per Python process."""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import public_tokenizers
import tiktoken

DOCUMENT_VOCAB = public_tokenizers.path("byte_bpe_50k.json")
RANK_VOCAB = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in the JSON vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class DocumentEncoder:
    """The ids that the JSON tokenizer gives without special tokens added.

    The vocabulary lists tokens in merge order, so they serve as ranks; special tokens written out in a text keep their
    own id, as in the tokenizer. tests/llm compares both over whole texts and every seventh code point up to U+30000.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.plain = tiktoken.Encoding("document", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = set(special)

    def ids(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.plain.encode(text, allowed_special=self.special)
        return self.plain.encode_ordinary(text)


@lru_cache(maxsize=4)
def document_encoder(path: str = DOCUMENT_VOCAB) -> DocumentEncoder:
    return DocumentEncoder(path)


@lru_cache(maxsize=4)
def rank_encoding(path: str = RANK_VOCAB) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
