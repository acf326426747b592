import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from llm_cases import SCHEMA, crowd_rows, near_duplicate_classes, odd_rows, row

from casemill.llm import bpe_tree, exact_dedup, jaccard, langid, packing, quality, token_files
from casemill.llm.vocab import document_encoder, rank_encoding

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- exact dedup ----

def brute_copies(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows]
    ids = {t: [r[0] for r, n in zip(rows, norm) if n == t] for t in norm}
    keep = {t: min((d for d in own if d is not None), default=None) for t, own in ids.items()}
    return sorted(((r[0], keep[t], len(ids[t]), r[0] == keep[t], hashlib.sha256(t.encode()).hexdigest()) for r, t in zip(rows, norm)), key=repr)


@pytest.mark.parametrize("cells", [exact_dedup.SLICE_CELLS, exact_dedup.MAX_CELLS])
def test_exact_groups(odd, cells):
    out = exact_dedup.exact_groups(odd, cells).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")))
    assert got(out) == brute_copies(odd_rows())


def test_full_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "repeated_cells", lambda hashes, cells: b"\xff" * (cells // 8))
    rows = odd_rows()
    out = exact_dedup.exact_groups(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")))
    assert got(out) == brute_copies(rows)


def test_drop_copies(odd, none):
    left = exact_dedup.drop_copies(odd)
    assert left.columns == odd.columns
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in left.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in odd_rows()})
    assert {r["key"] for r in left.collect()} == {"k"} and {r["_row"] for r in left.collect()} == {"r"}
    assert exact_dedup.drop_copies(none).count() == exact_dedup.exact_groups(none).count() == 0


# ---- Jaccard join ----

def test_signatures_are_complete():
    rng = np.random.default_rng(3)
    for _ in range(1500):
        size = int(rng.choice([1, 2, 3, 4, 7, 13, 30, 90, 300]))
        base = rng.integers(0, 2**64, size, dtype=np.uint64)
        k = int(size * rng.uniform(0, 0.16))
        other = np.concatenate([base[k:], rng.integers(0, 2**64, k if rng.random() < 0.5 else int(size * rng.uniform(0, 0.34)), dtype=np.uint64)])
        a, b = np.unique(base), np.unique(other)
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= 75 * (len(a) + len(b) - both):
            for scheme in jaccard.SCHEMES:
                assert len(np.intersect1d(jaccard.signatures(a, scheme), jaccard.signatures(b, scheme)))


def test_near_duplicates_of_odd_rows(odd, none):
    assert got(jaccard.near_duplicates(odd)) == near_duplicate_classes(odd_rows())
    assert jaccard.near_duplicates(none).count() == 0


def test_rows_with_one_id_are_one_node(spark):
    texts = ["a b c d e f", "a b c d e f", "p q r s t u", "p q r s t u", "only here today is this text"]
    rows = [row(i, t) for i, t in zip((3, 7, 7, 9, 9), texts)] + [row(20, None), row(20, "p q r s t u"), row(21, "")]
    out = jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert {(r.doc_id, r.component_id) for r in out.where("n_shingles > 0").collect()} == {(3, 3), (7, 3), (9, 3), (20, 3)}
    assert {(r.doc_id, r.component_id) for r in out.where("n_shingles = 0").collect()} == {(20, 20), (21, 21)}


@pytest.mark.parametrize("crowd", [2, 16])
def test_near_duplicates_in_crowds(spark, crowd):
    rows = crowd_rows()
    out = jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA), crowd=crowd)
    assert got(out) == near_duplicate_classes(rows)


def crowd_in_one_pack():
    """Sixty sets of one pack that are only similar to a set of another pack, by a passage that all of them hold."""
    passage = " ".join(f"p{i}" for i in range(104))
    own = [row(i, passage + " " + " ".join(f"o{i}x{k}" for k in range(20))) for i in range(1, 61)]
    other = [row(70, passage + " " + " ".join(f"q{k}" for k in range(10))), row(71, "a few words that stand in no other text")]
    return own, other


@pytest.mark.parametrize("scheme", jaccard.SCHEMES)
def test_crowd_of_one_pack_is_a_crowd_of_its_bucket(spark, scheme, monkeypatch):
    own, other = crowd_in_one_pack()
    monkeypatch.setattr(jaccard, "DOCUMENTS_PER_PACK", len(own))
    docs = spark.createDataFrame(own + other, SCHEMA).select("doc_id", "text").coalesce(1)
    found = jaccard.share_signatures(docs, scheme, 16).where("kind > 0").select("kind", "sig", "a", "b").collect()
    held = {}
    for kind, sig, a, b in found:
        held.setdefault((kind, sig) if kind == 2 else (a, b), set()).update((a, b))
    assert {x for nodes in held.values() if 70 in nodes for x in nodes} == {*range(1, 61), 70}


def test_links_to_a_crowd_of_another_pack(spark, monkeypatch):
    own, other = crowd_in_one_pack()
    monkeypatch.setattr(jaccard, "DOCUMENTS_PER_PACK", len(own))
    out = jaccard.near_duplicates(spark.createDataFrame(own + other, SCHEMA).coalesce(1))
    assert got(out) == near_duplicate_classes(own + other)
    assert {r.component_id for r in out.collect()} == {1, 71}


def kept_tables(monkeypatch):
    """The tables that the join stores from here on, by name."""
    kept, plain = {}, jaccard.saved

    def saved(df, name):
        kept.setdefault(name, []).append(plain(df, name))
        return kept[name][-1]

    monkeypatch.setattr(jaccard, "saved", saved)
    return kept


def test_settling_a_crowd_gives_no_more_rows_than_it_has(spark, monkeypatch):
    """Sixty sets of which all are similar, and sixty that share nearly as much and are not, at five signatures."""
    words = [f"w{k}" for k in range(200)]
    texts = {i: " ".join(words[:i % 7] + [f"own{i}"] + words[i % 7:]) for i in range(1, 61)}
    # Two words far apart cost ten shingles of either set: 168 of 224 is similar, 158 of 234 is not.
    texts |= {i: " ".join(f"own{i}x{k}" if k % 33 == 16 else w for k, w in enumerate(words)) for i in range(61, 121)}
    rows = [row(i, t) for i, t in texts.items()]
    sets = jaccard._sets(spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "true AS crowded"), jaccard.SHINGLE_WORDS)
    at = {-5: range(1, 121), 1: range(1, 80), 2: range(40, 121), 3: range(1, 121, 2), 4: range(2, 121, 2)}
    stars = spark.createDataFrame([(s, min(ids), i) for s, ids in at.items() for i in ids], "sig long, a long, b long")
    none = spark.createDataFrame([], "node long, component long")
    kept = kept_tables(monkeypatch)
    labels = {r.node: r.component for r in jaccard._settle(stars, none, none, sets, jaccard.PERCENT).collect()}
    assert {(i, labels.get(i, i)) for i in texts} == {(i, c) for i, _, c in near_duplicate_classes(rows)}
    members = sum(map(len, at.values()))
    assert all(t.count() <= members for name, found in kept.items() for t in found)


def test_sets_of_one_crowd_meet_once_for_all_signatures(spark, monkeypatch):
    own, other = crowd_in_one_pack()
    kept = kept_tables(monkeypatch)
    out = jaccard.near_duplicates(spark.createDataFrame(own + other, SCHEMA).coalesce(1))
    assert got(out) == near_duplicate_classes(own + other)
    first = kept["signature-pairs"][0]
    assert 0 < first.where("kind = 2").count() <= 16 * len(own + other)


def test_marks_leave_a_shared_signature_of_similar_sets():
    rng = np.random.default_rng(5)
    for scheme in jaccard.SCHEMES:
        for size in [*range(1, 40), 90, 133, 134, 300, 800]:
            for extra in {0, 1, size // 7, size // 3}:
                a = np.unique(rng.integers(0, 2**64, size + extra, dtype=np.uint64))
                b = rng.permutation(a)[:size]
                if 100 * len(b) < 75 * len(a):
                    continue
                (x, own_x), (y, own_y) = (jaccard._unmarked(jaccard.signatures(np.sort(f), scheme, marked=True)) for f in (a, b))
                _, i, j = np.intersect1d(x, y, return_indices=True)
                assert jaccard.may_link(own_x[i], own_y[j]).any()


def test_sets_of_one_band_meet_in_it_alone():
    low, own = jaccard.marks(100, 75)[1], jaccard.marks(100, 75)[0]
    assert jaccard.may_link(np.array([own, own, low, own]), np.array([own, low, low, jaccard.marks(170, 75)[0]])).tolist() == [True, True, False, False]
    sigs, nodes = np.zeros(5, np.uint64), np.arange(5)
    pairs, stars, left = jaccard.shared(sigs, nodes, 3, None, np.zeros(5, bool))
    assert not len(pairs) and not len(stars) and left.all()
    assert len(jaccard.shared(sigs, nodes, 3, None, np.arange(5) == 2)[1]) == 4


def test_only_close_sets_are_stored_whole(spark, monkeypatch):
    """Ten texts share half of their words, one of them has a near copy."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [row(i, passage + " " + " ".join(f"o{i}x{k}" for k in range(30))) for i in range(1, 11)]
    rows.append(row(11, rows[0][1] + " more"))
    kept = kept_tables(monkeypatch)
    out = jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert got(out) == near_duplicate_classes(rows)
    assert {name for name, tables in kept.items() if any("features" in t.columns for t in tables)} == {"close-sets"}
    assert {r.doc_id for t in kept["close-sets"] for r in t.collect()} == {1, 11}


def test_one_of_each_near_copy(spark):
    rows = crowd_rows()
    left = jaccard.keep_one_of_each(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r["doc_id"] for r in left.collect()) == sorted({c for _, _, c in near_duplicate_classes(rows)})


# ---- packing ----

def test_pieces_and_places(spark, odd, none):
    tokens = {i: document_encoder().ids(r[1] or "") + [2] for i, r in enumerate(odd_rows())}
    out = packing.pack_documents(odd).collect()
    want = Counter()
    for i, r in enumerate(odd_rows()):
        first = (len(tokens[i]) - 1) % 1024 + 1
        cuts = [0, *range(first, len(tokens[i]) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r[0], k, a, b - a, zlib.crc32(np.array(tokens[i][a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    by_sequence = {}
    for r in out:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(none).count() == 0


def least_sequences(lengths, demand, width):
    """Martello and Toth: long pieces stand alone, pieces above the half take the rest of the small ones."""
    best = 0
    for k in range(1, width // 2 + 1):
        alone, half = lengths > width - k, (lengths > width // 2) & (lengths <= width - k)
        small = (lengths >= k) & (lengths <= width // 2)
        room = int((demand[half] * (width - lengths[half])).sum())
        best = max(best, int(demand[alone | half].sum()) + max(0, -(-(int((demand[small] * lengths[small]).sum()) - room) // width)))
    return best


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(1)
    lengths = np.unique(rng.integers(1, 1025, 200))
    demand = rng.integers(1, 60, len(lengths))
    plan = packing.whole_plan(lengths, demand, 1024)
    assert (sum(c * t for c, t in plan) == demand).all()
    assert all((c * lengths).sum() <= 1024 for c, _ in plan)
    assert sum(t for _, t in plan) <= 1.01 * least_sequences(lengths, demand, 1024) + 1
    exact = packing.whole_plan(np.array([1]), np.array([3]), 1024)
    assert sum(t for _, t in exact) == 1


def test_bound_holds_and_no_plan_is_worse_than_best_fit():
    rng = np.random.default_rng(6)
    for width, high, n in ((1024, 1025, 40), (100, 60, 30), (50, 51, 12), (300, 120, 20)):
        lengths = np.unique(rng.integers(1, high, n))
        demand = rng.integers(1, 40, len(lengths))
        used, bound = packing.fractional_cover(lengths, demand, width)
        total = sum(step for _, step in used)
        assert (lengths * demand).sum() / width - 1e-6 <= bound <= total + 1e-6
        plain = packing.best_fit_decreasing(lengths, demand, width)
        assert (sum(c * t for c, t in plain) == demand).all() and all((c * lengths).sum() <= width for c, _ in plain)
        plan = packing.whole_plan(lengths, demand, width)
        assert math.ceil(bound - 1e-6) <= packing.sequences(plan) <= packing.sequences(plain)


def test_best_fit_is_the_usual_one():
    rng = np.random.default_rng(9)
    for _ in range(60):
        width = int(rng.integers(5, 40))
        pieces = sorted(rng.integers(1, width + 1, 25).tolist(), reverse=True)
        rooms = []
        for x in pieces:
            room = min((r for r in rooms if r >= x), default=None)
            if room is not None:
                rooms.remove(room)
            rooms.append((width if room is None else room) - x)
        lengths, demand = np.unique(pieces, return_counts=True)
        assert packing.sequences(packing.best_fit_decreasing(lengths, demand, width)) == len(rooms)


def test_pricing_is_optimal():
    rng = np.random.default_rng(2)
    for _ in range(40):
        lengths = np.unique(rng.integers(1, 12, 4))
        prices = rng.random(len(lengths))
        counts = packing.best_configuration(lengths, prices, 17)
        best = max(sum(p * c for p, c in zip(prices, cs)) for cs in itertools.product(*[range(17 // n + 1) for n in lengths])
                   if sum(n * c for n, c in zip(lengths, cs)) <= 17)
        assert math.isclose(float((prices * counts).sum()), best)


# ---- byte-level BPE ----

def test_tree_equals_flat_encoding():
    coder, rnd = bpe_tree.TreeCoder(leaf_chars=8), random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "'re", "1", "é", "漢", "😀", "the ", "\x1c", "\x85", " ", ".", "!!", "ing", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 90)))
        ids = coder.encode(text)
        assert ids.tolist() == rank_encoding().encode_ordinary(text)
        assert coder.decode(ids.tolist()) == text.encode()


def test_coding_digests(odd, none):
    want = []
    for r in odd_rows():
        ids = rank_encoding().encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert got(bpe_tree.coding_digests(odd)) == sorted(want, key=repr)
    back = bpe_tree.decoded(bpe_tree.encoded(odd))
    assert sorted(bytes(r["bytes"]) for r in back.collect()) == sorted((r[1] or "").encode() for r in odd_rows())
    assert bpe_tree.coding_digests(none).count() == 0


# ---- token files ----

def test_document_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    own, public = document_encoder(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r[1] or "" for r in odd_rows()] + ["a <|endoftext|> b", "<|endoftext|><|endoftext|>\n", "  <|endoftext|>"]
    texts += [f"a{chr(c)}b {chr(c)} {chr(c)}1  {chr(c)}{chr(c)} x" for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    for text, e in zip(texts, public.encode_batch(texts, add_special_tokens=False)):
        assert own.ids(text) == e.ids


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    for n, top, percentile in itertools.product([1, 5, 1024, 3000], [1, 2, 300, 50257, 2**32], [0, 50, 90, 100]):
        ids = rng.integers(0, top, n).astype(np.uint32)
        back = np.concatenate([token_files.decode_block(b) for b in token_files.encode_blocks(ids, percentile)])
        assert (back == ids).all()
    outlier = np.zeros(1024, np.uint32)
    outlier[7] = 50_000
    assert sum(map(len, token_files.encode_blocks(outlier))) < 20


def test_file_round_trip(odd, none):
    rows = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start = [], 0
    for r in rows:
        ids = document_encoder().ids(r[1] or "") + [2]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_files.round_trip(odd).collect()), key=lambda r: r[1]) == want
    assert token_files.round_trip(none).count() == 0


# ---- language ID ----

def test_forward_sums_all_segmentations():
    finder, own = langid.piece_finder(), langid.pieces()
    number = {p: i for i, p in enumerate(own)}
    table = np.vstack([np.random.default_rng(0).random((len(own), 2)) * 0.01, np.zeros((1, 2))])
    for word in ("the", "für", "ß漢x", "abcdefgh", "ingrationess"):
        text, total = langid.WORD_MARK + word, np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(text) - 1):
            ends = [0, *[i for i, c in enumerate(cuts, 1) if c], len(text)]
            p = np.ones(2)
            for a, b in zip(ends, ends[1:]):
                piece = text[a:b]
                p = p * (table[number[piece]] if piece in number else (langid.FLOOR if len(piece) == 1 else 0))
            total += p
        (_, codes), = langid._by_length([word])
        assert np.allclose(langid.forward(codes, table, finder)[0], np.log(total))


def test_expected_uses_cover_the_word():
    probability = dict.fromkeys(langid.pieces(), 1e-4)
    longest = max(map(len, langid.pieces()))
    assert longest > 10
    for word in ("nations", "nation" * 5000):
        uses = langid.expected_uses(word, probability, longest)
        assert math.isclose(sum(len(p) * n for p, n in uses.items()), len(word) + 1)


def test_expected_uses_equal_the_sum_over_segmentations():
    rnd = random.Random(8)
    word = "banana"
    text = langid.WORD_MARK + word
    probability = {text[i:j]: rnd.random() * 10.0 ** -rnd.randrange(0, 9) for i in range(7) for j in range(i + 1, 8)}
    want, total = Counter(), 0.0
    for cuts in itertools.product([0, 1], repeat=6):
        ends = [0, *(i + 1 for i, c in enumerate(cuts) if c), 7]
        own = [text[a:b] for a, b in zip(ends, ends[1:])]
        p = math.prod(probability[x] for x in own)
        total += p
        for x in own:
            want[x] += p
    uses = langid.expected_uses(word, probability, 7)
    assert all(math.isclose(uses.get(x, 0.0), n / total, rel_tol=1e-9, abs_tol=1e-12) for x, n in want.items())


def language_rows():
    rnd = random.Random(5)
    words = {"en": "the of and with from that this which there people water house".split(), "de": "der die und nicht auch über werden haben straße wasser haus".split()}
    rows = [row(i, " ".join(rnd.choice(words[lang]) for _ in range(30)), lang) for i, lang in enumerate(["en", "de"] * 60)]
    return rows + [row(1000, None), row(1001, ""), row(1002, "123 456 !!"), row(1003, "the water and the house", None), row(1004, "x" * 30_000), row(None, "nicht das haus")]


def test_languages(spark, none):
    rows = language_rows()
    out = {r["doc_id"]: r for r in langid.language_predictions(spark.createDataFrame(rows, SCHEMA)).collect()}
    right = [out[r[0]]["lang_pred"] == r[2] for r in rows[:120] if out[r[0]]["held_out"]]
    assert right and all(right)
    assert all(out[d]["lang_pred"] == "und" and out[d]["score"] == 0 for d in (1000, 1001, 1002))
    assert out[1003]["lang_pred"] == "en" and out[None]["lang_pred"] == "de" and not out[None]["held_out"]
    assert all(out[r[0]]["held_out"] == (zlib.crc32(str(r[0]).encode()) % 3 == 1) for r in rows if r[0] is not None)
    assert all(0 <= r["score"] <= 1 for r in out.values())
    left = langid.keep_known(spark.createDataFrame(rows, SCHEMA))
    assert {r["doc_id"] for r in left.collect()} >= {r[0] for r in rows[:120]} and left.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert langid.language_predictions(none).count() == 0


def test_held_out_rows_teach_nothing(spark):
    rows = [row(i, "only this teaches" if zlib.crc32(str(i).encode()) % 3 == 1 else "the other words", "aa" if zlib.crc32(str(i).encode()) % 3 == 1 else "bb") for i in range(40)]
    assert langid.fit(spark.createDataFrame(rows, SCHEMA)).languages == ["bb"]


# ---- quality rules ----

def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_counts(odd):
    texts = [r[1] for r in odd_rows()] + ["a b c d e f a b c d e", "x\nx\n\nx\n y\n\n", "a a a a a a a", "##$%&|<>* x"]
    rnd = random.Random(2)
    texts += [" ".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 60))) for _ in range(200)]
    for text in texts:
        assert quality.counts_of(text)[:5] == brute_counts(text)


def test_rules_find_planted_faults(spark, none):
    rnd = random.Random(3)
    vocab = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        words = [rnd.choice(vocab) for _ in range(60)]
        bad = i % 4 == 0
        text = " ".join(w + "***" if bad else w for w in words) + "."
        rows.append(row(i, text))
        labels += [(i, 0 if bad else 1, 0)]
    labels += [(None, 1, 0), (5, None, 0), (99_999, 0, 0), (0, 0, 1)]
    docs, table = spark.createDataFrame(rows + odd_rows()[:4], SCHEMA), spark.createDataFrame(labels, LABELS)
    out = {r["doc_id"]: r for r in quality.quality_verdicts(spark.createDataFrame(rows, SCHEMA), table).collect()}
    assert all(out[i]["kept"] == (i % 4 != 0) for i in range(400))
    assert quality.fit(docs, table, 200) and quality.fit(docs, spark.createDataFrame([], LABELS)) == []
    left = quality.keep_good(docs, table)
    assert left.columns == docs.columns and {r["_row"] for r in left.collect()} == {"r"}
    assert quality.quality_verdicts(none, table).count() == 0


def test_base_test(spark):
    rows = odd_rows()
    out = got(quality.quality_verdicts(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], LABELS)))
    want = []
    for r in rows:
        c = brute_counts(r[1])
        failed = c[0] < 10 or 100 * c[4] > 20 * c[0]
        want.append((r[0], *c, failed, not failed, None))
    assert out == sorted(want, key=repr)
