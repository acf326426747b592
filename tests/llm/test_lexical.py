import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_cases import SCHEMA, odd_rows, row

from casemill.llm import lexical

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, doc_id long, score long, rank int, item long"


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=10):
    held = [(d, words(t)) for d, t in docs]
    n_docs, n_words = sum(bool(w) for _, w in held), sum(len(w) for _, w in held)
    counts = [Counter(w) for _, w in held]
    df = Counter(t for c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    out = []
    for i, wanted in asked.items():
        found = []
        for (d, w), c in zip(held, counts):
            norm = 100 - 90 + (90 * len(w) * n_docs) // max(n_words, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * norm)) for t in wanted if c[t])
            if score > 0 and d is not None:
                found.append((-score, d))
        out += [(i, k, d, -s) for k, (s, d) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


def corpus(seed, n=400):
    """Words of very different frequency, copies of documents, and so equal scores."""
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(600)]
    weights = [1 / (i + 1) for i in range(600)]
    texts = [" ".join(rnd.choices(vocab, weights, k=rnd.randrange(0, 80))) for _ in range(n)]
    texts += [rnd.choice(texts).upper() for _ in range(n // 4)]
    items = [(i, ", ".join(rnd.choices(vocab, weights if i % 2 else None, k=rnd.randrange(1, 25)))) for i in range(30)]
    return [*enumerate(texts)], items


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block, window, short", [(1 << 16, 2048, 32), (64, 16, 4), (100, 1000, 1), (33, 7, 10**6)])
def test_blocks_windows_and_short_lists(spark, monkeypatch, block, window, short):
    docs, items = corpus(block)
    vocabulary = {}
    wanted = [sorted({vocabulary.setdefault(w.encode(), len(vocabulary)) for w in words(t)}) for _, t in items]
    rows, counts, total = [], np.zeros(len(vocabulary), np.int64), [0, 0]
    for low in range(0, len(docs), block):
        part = [(d, lexical.terms(t)) for d, t in docs[low:low + block]]
        keys = [np.array([vocabulary[w] << 16 | k for w in ws if w in vocabulary], np.int64) for k, (_, ws) in enumerate(part)]
        rows.append(dict(zip((c.split()[0] for c in lexical.BLOCK.split(", ")), lexical.block_row([d for d, _ in part], [len(ws) for _, ws in part], keys))))
        total = [total[0] + rows[-1]["n_documents"], total[1] + rows[-1]["n_words"]]
        counts[np.frombuffer(rows[-1]["terms"], np.uint32)] += np.diff(np.frombuffer(rows[-1]["starts"], np.uint32).astype(np.int64))
    best = [lexical.Best(10) for _ in items]
    for r in rows:
        held = lexical.Block(r, *total, lexical.term_weights(total[0], counts))
        for b, w in zip(best, wanted):
            lexical.search_block(held, w, b, short, window)
    found = [(i, k, int(d), int(s)) for (i, _), b in zip(items, best) for k, (d, s) in enumerate(zip(b.ids, b.scores), 1)]
    assert sorted(found, key=repr) == brute(docs, items)


def test_ranked(spark, monkeypatch):
    docs, items = corpus(9, 150)
    frame = spark.createDataFrame([row(*d) for d in docs], SCHEMA).repartition(3)
    asked = spark.createDataFrame([(*i, 1, 1, 1, 1) for i in items], ITEMS)
    want = brute(docs, items)
    assert got(lexical.ranked(frame, asked)) == want
    assert got(lexical.ranked(frame, asked, terms_per_pass=60)) == want


def test_odd_rows(spark):
    rows = odd_rows()
    items = [(1, "The lazy DOG"), (1, "w1x1"), (2, None), (3, ""), (None, "lonely line"), (4, "Émile 漢字"), (5, "one two x y"), (6, "?!")]
    asked = spark.createDataFrame([(*i, 1, 1, 1, 1) for i in items], ITEMS)
    assert got(lexical.ranked(spark.createDataFrame(rows, SCHEMA), asked)) == brute([r[:2] for r in rows], items)


def test_empty_tables(spark):
    asked = spark.createDataFrame([(1, "one", 1, 1, 1, 1)], ITEMS)
    none = spark.createDataFrame([], SCHEMA)
    assert lexical.ranked(none, asked).count() == 0
    assert lexical.ranked(spark.createDataFrame(odd_rows(), SCHEMA), spark.createDataFrame([], ITEMS)).count() == 0


def test_long_documents_keep_their_norm():
    keys = [np.array([0], np.int64)]
    fields = dict(zip((c.split()[0] for c in lexical.BLOCK.split(", ")), lexical.block_row([1], [1 << 40], keys)))
    block = lexical.Block(fields, 1 << 40, 1 << 60, np.array([5], np.int64))
    norm = 10 + 90 * (1 << 40) * (1 << 40) // (1 << 60)
    assert block.scores.tolist() == [5 * (10**9 // (1000 + 8 * norm))]
