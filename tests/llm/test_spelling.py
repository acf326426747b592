import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_cases import SCHEMA, odd_rows, row

from casemill.llm import spelling


def brute_words(rows, deleted=199):
    count = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{r[0]}:{run}".encode())
            if h % deleted == 0 and r[0] is not None:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(rows, deleted=199):
    words = brute_words(rows, deleted)
    form, n_near = {}, {}
    for w, n in words.items():
        own = [x for x in words if x != w and near(x, w)]
        n_near[w] = len(own)
        best = min(own, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n, n_near[w], words.get(form[w])) for w, n in words.items()), key=repr)


def variants(seed=3):
    """Words with misspellings of falling frequency, chains of forms, anagrams and many ties."""
    rnd = random.Random(seed)
    letters = "aeinrstléÿÀ"
    base = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(6, 11))) for _ in range(60)]
    count = Counter()
    for w in base:
        n = rnd.choice([5, 30, 140, 700])
        count[w] += n
        for _ in range(4):
            k, c = rnd.randrange(len(w)), rnd.choice(letters)
            w = rnd.choice([w[:k] + w[k + 1:], w[:k] + c + w[k:], w[:k] + c + w[k + 1:]])
            n = max(5, n // rnd.choice([1, 5, 6]))
            count[w] += n
    for _ in range(120):
        w = list("stainer")
        rnd.shuffle(w)
        count["".join(w)] += rnd.choice([4, 5, 9, 50])
    words = [w.upper() if w.isascii() and rnd.random() < 0.2 else w for w, n in count.items() for _ in range(n)]
    rnd.shuffle(words)
    return [row(i, ", ".join(words[low:low + 50])) for i, low in enumerate(range(0, len(words), 50))]


def got(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


@pytest.mark.parametrize("box, block, deleted", [(20_000, 40_000, 199), (12, 40_000, 7), (50, 9, 3)])
def test_spelling_groups(spark, box, block, deleted):
    rows = variants()
    found = got(spelling.spelling_groups(spark.createDataFrame(rows, SCHEMA).repartition(3), deleted=deleted, box_words=box, block_words=block))
    assert found == brute(rows, deleted)
    assert any(f[1] is not None and f[2] != f[1] for f in found)


def test_odd_rows_and_empty_tables(spark):
    rows = odd_rows() * 5
    assert got(spelling.spelling_groups(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert spelling.spelling_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_range_search_finds_all():
    rng = np.random.default_rng(4)
    words = list({"".join(rng.choice(list("abcdeé"), 7)) for _ in range(900)})
    vectors = spelling.letter_counts(words)
    for radius in (1, 2):
        found = {(int(v), int(t)) for x, y in spelling.in_range(vectors, vectors, radius, 10) for v, t in zip(x, y)}
        apart = np.abs(vectors[:, None] - vectors[None]).sum(axis=2)
        assert found == {(int(a), int(b)) for a, b in zip(*np.nonzero(apart <= radius))}


def test_boxes_in_reach_hold_every_neighbour():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghé"), int(rng.integers(6, 9)))) for _ in range(600)]
    vectors = spelling.letter_counts(words)
    tree = spelling.top_tree(vectors[:200], 20)
    box = spelling.homes(tree, vectors)
    assert len(set(box.tolist())) > 10
    apart = np.abs(vectors[:, None] - vectors[None]).sum(axis=2)
    for radius in (1, 2):
        reach = set(zip(*(x.tolist() for x in spelling.boxes_in_reach(tree, vectors, radius))))
        assert all((int(a), int(box[b])) in reach for a, b in zip(*np.nonzero(apart <= radius)))
