"""Best-fit packing by a configuration linear program over the length histogram.

A configuration says how many pieces of each length one sequence holds. The covering program over all configurations is
solved by multiplicative weights: every length has a price, a knapsack dynamic program finds the configuration of the
highest price, it is used as far as it goes, and prices are multiplied by what the lengths have cost. Prices of which no
configuration is worth more than one are a solution of the dual program, so every round also gives a bound that no packing
can go below, and the search ends where the cover has reached it. The fractional solution is rounded down to whole
sequences, then up as far as pieces are left, and what remains is packed largest first into the tightest room. A plain
best-fit decreasing plan of the same histogram is kept instead where it needs fewer sequences. All of this sees only the
histogram: at most `width` numbers, however many documents there are.

The plan is a table of slots: pieces number `first` to `first + times` of a length go to sequences `sequence` onward at
`offset`. Pieces are numbered inside a length by Spark, in parts of bounded size, so no length is gathered in one task.

A null text is an empty one and still has its end id. A null doc_id is kept as it is. Repeated rows are packed as often
as they occur. An empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casemill.llm.common import by_batch, saved, texts_of
from casemill.llm.vocab import DOCUMENT_VOCAB, document_encoder

WIDTH = 1024
END_ID = 2
#: Rounds of prices at most, rounds without a better cover that end them, and how their steps shrink.
PASSES, IDLE = 8, 2
RATE = 0.25
PIECES_PER_PART = 50_000


def pieces(docs: DataFrame, vocab: str = DOCUMENT_VOCAB, width: int = WIDTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: whole documents, and those above `width` cut so that the first piece is the short one."""

    def rows(doc_ids: list, texts: list) -> dict:
        encoder = document_encoder(vocab)
        out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
        for doc_id, text in zip(doc_ids, texts):
            ids = np.array([*encoder.ids(text or ""), end_id], "<u4")
            cuts = [0, *range((len(ids) - 1) % width + 1, len(ids) + 1, width)]
            for k, (low, high) in enumerate(zip(cuts, cuts[1:])):
                for name, value in zip(out, (doc_id, k, low, high - low, zlib.crc32(ids[low:high].tobytes()))):
                    out[name].append(value)
        return out

    return by_batch(texts_of(docs), rows, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_configuration(lengths: np.ndarray, prices: np.ndarray, width: int) -> np.ndarray:
    """Knapsack by dynamic programming: how many of each length give the highest price within `width`.

    `lengths` ascend. Of equal prices the longer piece is taken.
    """
    best = np.zeros(width + 1)
    choice = np.full(width + 1, -1)
    fits = np.searchsorted(lengths, np.arange(width + 1), side="right")
    for room in range(1, width + 1):
        best[room], choice[room] = best[room - 1], -1
        if fits[room]:
            n = fits[room]
            worth = best[room - lengths[:n]] + prices[:n]
            k = n - 1 - int(worth[::-1].argmax())
            if worth[k] > best[room]:
                best[room], choice[room] = worth[k], k
    counts = np.zeros(len(lengths), np.int64)
    room = width
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            counts[choice[room]] += 1
            room -= lengths[choice[room]]
    return counts


def priced_cover(lengths: np.ndarray, demand: np.ndarray, width: int, prices: np.ndarray, rate: float = RATE) -> tuple[list[tuple[np.ndarray, float]], float]:
    """Configurations and how often each is used so that the demand is covered, found by the prices, and the dual bound.

    The first configuration is the dearest of all at the given prices: divided by its worth, they are feasible, and
    what the whole demand is then worth is a lower bound of the number of sequences.

    In a round the best configuration is used until one of its lengths is covered, so there are at most as many rounds
    as lengths; the prices of its lengths fall by the share covered.
    """
    left = demand.astype(float)
    weights = np.ones(len(lengths))
    used, bound = [], 0.0
    while True:
        open_ = np.flatnonzero(left > 1e-9)
        if not len(open_):
            return used, bound
        counts = np.zeros(len(lengths), np.int64)
        counts[open_] = best_configuration(lengths[open_], (prices * weights)[open_], width)
        if not used:
            bound = float((prices * demand).sum() / (prices * counts).sum())
        taken = np.flatnonzero(counts)
        step = (left[taken] / counts[taken]).min()
        used.append((counts, step))
        left[taken] = np.maximum(0, left[taken] - step * counts[taken])
        weights[taken] *= np.exp(-rate * step * counts[taken] / demand[taken])


def fractional_cover(lengths: np.ndarray, demand: np.ndarray, width: int, passes: int = PASSES, known: float = math.inf) -> tuple[list[tuple[np.ndarray, float]], float]:
    """The cover of the least sequences that rounds of prices lead to, and the highest dual bound seen.

    Prices start at the share of the width, at which a full sequence is worth one. After a pass every price is multiplied
    by what a piece of the length has cost, a sequence being charged to its pieces by their prices: lengths that leave
    room no other piece fills become dear, and are combined first. Rounds end when no whole number of sequences lies
    between the bound and the cover or a plan of `known` sequences, or when they bring nothing better.
    """
    share = lengths / width
    volume = float((share * demand).sum())
    prices, best, least, bound, idle = share.copy(), [], math.inf, volume, 0
    for _ in range(passes):
        used, dual = priced_cover(lengths, demand, width, prices)
        total, bound = sum(step for _, step in used), max(bound, dual)
        idle = 0 if total < least else idle + 1
        if total < least:
            best, least = used, total
        if math.ceil(min(least, known) - 1e-6) <= math.ceil(bound - 1e-6) or idle >= IDLE:
            break
        cost = np.zeros(len(lengths))
        for counts, step in used:
            cost += step * counts / (counts * prices).sum()
        prices = prices * cost / demand
        prices *= volume / (prices * demand).sum()
    return best, bound


def best_fit_decreasing(lengths: np.ndarray, demand: np.ndarray, width: int) -> list[tuple[np.ndarray, int]]:
    """Largest pieces first, each into the tightest room that takes it; sequences alike are handled as one."""
    rooms: list[list[tuple[np.ndarray, int]]] = [[] for _ in range(width + 1)]

    def put(counts: np.ndarray, k: int, n: int, times: int, room: int) -> None:
        counts = counts.copy()
        counts[k] += n
        rooms[room - n * lengths[k]].append((counts, times))

    for k in range(len(lengths) - 1, -1, -1):
        left, size = int(demand[k]), int(lengths[k])
        room = size
        while left:
            while room <= width and not rooms[room]:
                room += 1
            if room > width:
                whole, rest = divmod(left, width // size)
                empty = np.zeros(len(lengths), np.int64)
                if whole:
                    put(empty, k, width // size, whole, width)
                if rest:
                    put(empty, k, rest, 1, width)
                break
            counts, times = rooms[room].pop()
            # The room left over is the tightest now, if it takes another one.
            each = room // size
            full, rest = divmod(min(left, each * times), each)
            if full:
                put(counts, k, each, full, room)
            if rest:
                put(counts, k, rest, 1, room)
            if full + (rest > 0) < times:
                rooms[room].append((counts, times - full - (rest > 0)))
            left -= full * each + rest
    return [x for held in rooms for x in held]


def sequences(plan: list[tuple[np.ndarray, int]]) -> int:
    return sum(times for _, times in plan)


def whole_plan(lengths: np.ndarray, demand: np.ndarray, width: int, passes: int = PASSES) -> list[tuple[np.ndarray, int]]:
    """Configurations with whole multiplicities that hold every piece exactly once: the better of two plans."""
    plain = best_fit_decreasing(lengths, demand, width)
    return min(rounded_plan(lengths, demand, width, passes, sequences(plain)), plain, key=sequences)


def rounded_plan(lengths: np.ndarray, demand: np.ndarray, width: int, passes: int = PASSES, known: float = math.inf) -> list[tuple[np.ndarray, int]]:
    """The fractional cover in whole sequences."""
    left = demand.copy()
    shares: dict[bytes, float] = {}
    for counts, step in fractional_cover(lengths, demand, width, passes, known)[0]:
        shares[counts.tobytes()] = shares.get(counts.tobytes(), 0.0) + step
    plan: dict[bytes, int] = {}

    def use(key: bytes, times: int) -> None:
        counts = np.frombuffer(key, np.int64)
        taken = np.flatnonzero(counts)
        times = min(times, int((left[taken] // counts[taken]).min()))
        if times > 0:
            plan[key] = plan.get(key, 0) + times
            left[taken] -= times * counts[taken]

    ordered = sorted(shares.items(), key=lambda x: (-x[1], x[0]))
    for key, share in ordered:
        use(key, math.floor(share + 1e-9))
    for key, share in sorted(ordered, key=lambda x: (math.floor(x[1] + 1e-9) - x[1], x[0])):
        use(key, 1)
    while left.any():
        counts, room = np.zeros(len(lengths), np.int64), width
        for k in np.flatnonzero(left)[::-1]:
            counts[k] = min(left[k], room // lengths[k])
            room -= counts[k] * lengths[k]
        use(counts.tobytes(), int(left.max()))
    return [(np.frombuffer(key, np.int64), times) for key, times in plan.items()]


def slots(lengths: np.ndarray, plan: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Rows (length, first, sequence, offset), ordered by length and first: where each run of pieces goes."""
    out, taken, sequence = [], np.zeros(len(lengths), np.int64), 0
    for counts, times in plan:
        offset = 0
        for k in np.flatnonzero(counts)[::-1]:
            for _ in range(counts[k]):
                out.append((lengths[k], taken[k], sequence, offset))
                taken[k] += times
                offset += lengths[k]
        sequence += times
    table = np.array(out, np.int64).reshape(-1, 4)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


def packed(cut: DataFrame, width: int = WIDTH, passes: int = PASSES, pieces_per_part: int = PIECES_PER_PART) -> DataFrame:
    """The pieces with sequence_id and offset. `cut` has doc_id, piece, start, length, ids_crc32 and must be stored rows."""
    total = cut.count()
    parts = max(1, math.ceil(total / pieces_per_part))
    order = ["doc_id", "piece", "start", "ids_crc32"]
    cut = cut.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    held = saved(cut.groupBy("length", "_part").agg(F.count("*").alias("n")), "length-counts")
    # The histogram: at most `width` rows.
    histogram = sorted((r["length"], r["n"]) for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect())
    lengths, demand = (np.array(x, np.int64) for x in (zip(*histogram) if histogram else ((), ())))
    table = slots(lengths, whole_plan(lengths, demand, width, passes)) if len(lengths) else np.zeros((0, 4), np.int64)
    shared = cut.sparkSession.sparkContext.broadcast(table)
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = held.select("length", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_part", "length").orderBy(*order)) - 1
    ranked = cut.withColumn("_inside", inside).join(bases, ["length", "_part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("_base") + F.col("_inside")).alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        keys = (plan[:, 0] << 48) | plan[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = np.searchsorted(keys, (length << 48) | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(plan[at, 2] + rank - plan[at, 1]), pa.array(plan[at, 3])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocab: str = DOCUMENT_VOCAB, width: int = WIDTH, end_id: int = END_ID, passes: int = PASSES) -> DataFrame:
    return packed(saved(pieces(docs, vocab, width, end_id), "pieces"), width, passes)
