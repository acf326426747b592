"""Small document tables with every odd case, and brute-force versions of the operators."""

from __future__ import annotations

import collections
import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n long, _row string, component long, sig string"
BASE = ("the quick brown fox jumps over the lazy dog while seven grey geese drift along a cold river and nobody in the "
        "village hears the church bell ring for the last time before winter comes down from the northern hills again").split()


def row(doc_id, text, lang="en"):
    return doc_id, text, lang, "s", None, "k", 1, "r", 5, "x"


def odd_rows():
    long_text = " ".join(f"w{i % 4001}x{i % 37}" for i in range(60_000))
    return [
        row(1, None), row(2, ""), row(3, "   \n\t "), row(4, "one"), row(5, "one"), row(6, "One\ttwo"), row(7, "one  two"),
        row(8, " ".join(BASE)), row(8, " ".join(BASE)), row(9, " ".join(BASE), None), row(10, " ".join(BASE[:-1] + ["tomorrow"])),
        row(11, long_text), row(12, long_text + " end"), row(None, "lonely words stand here without a number"), row(None, None),
        row(13, "Émile naïve 漢字 😀   line"), row(14, "a" * 50_000), row(15, "x\x00y"), row(-3, "negative id text"),
    ]


def crowd_rows(seed=7):
    """A large group of near copies, a passage that many documents share, and unrelated documents."""
    rnd = random.Random(seed)
    vocab = [f"v{i}" for i in range(5000)]
    passage = [rnd.choice(vocab) for _ in range(60)]
    base = [rnd.choice(vocab) for _ in range(120)]
    out = []
    for i in range(90):
        words = list(base)
        for _ in range(rnd.randrange(0, 5)):
            words[rnd.randrange(len(words))] = rnd.choice(vocab)
        out.append(words)
    for i in range(90):
        own = [rnd.choice(vocab) for _ in range(rnd.randrange(60, 140))]
        out.append(own[:20] + passage + own[20:])
    for i in range(60):
        out.append([rnd.choice(vocab) for _ in range(rnd.randrange(1, 80))])
    for i in range(40):
        words = list(rnd.choice(out))
        k = rnd.randrange(len(words))
        out.append(words[:k] + [rnd.choice(vocab)] + words[k:])
    rnd.shuffle(out)
    return [row(i, " ".join(words)) for i, words in enumerate(out)]


def near_duplicate_classes(rows, percent=75, width=5):
    """(doc_id, set size) -> smallest doc_id of the class, by comparing all sets that share a shingle."""
    sets = []
    for r in rows:
        words = (r[1] or "").encode().lower().split()
        n = min(width, len(words))
        sets.append((r[0], frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1)) if words else frozenset()))
    up = {d: d for d, _ in sets if d is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = collections.defaultdict(list)
    for k, (d, s) in enumerate(sets):
        if d is None:
            continue
        shared = collections.Counter(j for x in s for j in holders[x])
        for j, both in shared.items():
            if 100 * both >= percent * (len(s) + len(sets[j][1]) - both):
                a, b = find(d), find(sets[j][0])
                up[max(a, b)] = min(a, b)
        for x in s:
            holders[x].append(k)
    return sorted(((d, len(s), None if d is None else find(d)) for d, s in sets), key=repr)
