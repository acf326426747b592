import hashlib
import random

import numpy as np
import pytest
from llm_cases import SCHEMA, odd_rows, row
from tokenizers import Tokenizer

from casemill.llm import rank_bpe
from casemill.llm.vocab import DOCUMENT_VOCAB


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(DOCUMENT_VOCAB)


@pytest.fixture(scope="module")
def coder():
    return rank_bpe.RankCoder()


def texts():
    rnd = random.Random(5)
    alphabet = "abcdeè漢 \n\t'1290.,<|>éß😀​́" + "the ing tion"
    yield from ("", " ", "a", "<|endoftext|>", "x <|endoftext|><|endoftext|> y", "<|endoftext", "I'll we've it's", "a" * 3000, "ab" * 999, "é" * 400, "\x00\x01")
    for _ in range(300):
        yield "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 200)))


def test_same_ids_and_text_as_the_library(coder, library):
    for text in texts():
        ids = np.frombuffer(coder.encode(text), "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert coder.decode(coder.encode(text)) == library.decode(ids, skip_special_tokens=False)


def test_all_of_unicode(coder, library):
    points = [c for c in range(0x33480) if not 0xD800 <= c < 0xE000] + [*range(0x33480, 0x110000, 997)]
    for low in range(0, len(points), 1000):
        for before in "a" if low % 7000 else "a1!":
            text = "".join(before + chr(c) + " " for c in points[low:low + 1000])
            assert np.frombuffer(coder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, hex(points[low])


def test_points_that_need_no_splitter(coder):
    """Each character outside RARE alone is cut as the library cuts it."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not rank_bpe.RARE.match(chr(c))]
    for before in ("a", "1", "!", " "):
        text = "".join(before + c + " " for c in points)
        assert coder.pattern.findall(text) == [text[low:high] for _, (low, high) in coder.splitter.pre_tokenize_str(text)]


def test_scan_and_heap_agree(coder):
    rnd = random.Random(6)
    for _ in range(400):
        word = "".join(rnd.choice("abcdetin ") for _ in range(rnd.randrange(0, 90))).encode()
        assert coder.scanned(word) == coder.heaped(word)


def test_kept_words_are_bounded(coder, monkeypatch):
    monkeypatch.setattr(rank_bpe, "KEPT_WORDS", 10)
    small = rank_bpe.RankCoder()
    text = " ".join(f"w{i}" for i in range(500))
    assert small.encode(text) == coder.encode(text) and len(small.words) <= 10


def test_digests(spark, library):
    rows = odd_rows()
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, rank_bpe.coding_digests(df).collect()), key=repr) == sorted(want, key=repr)
    back = rank_bpe.decoded(rank_bpe.encoded(df)).collect()
    assert sorted(map(tuple, back), key=repr) == sorted([(r[0], r[1] or "") for r in rows], key=repr)
    none = spark.createDataFrame([], SCHEMA)
    assert rank_bpe.coding_digests(none).count() == rank_bpe.encoded(none).count() == 0
    assert rank_bpe.decoded(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first()["text"] is None
