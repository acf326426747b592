"""Quality rules learned as an ordered decision list.

Statistics of a text are compared with labels: sequential covering grows conjunctions of thresholds that pick rejected
texts out (by information gain, on part of the labelled rows), prunes each on the other part, keeps it if it is precise
there, takes the rows it covers away, and goes on until no precise rule is left. The list becomes one Spark conditional
expression, first match wins, and whatever no rule covers is kept.

Rules are learned from at most `MAX_LABELLED` labelled rows, chosen by a hash of doc_id; statistics and verdicts cover
every row and whole texts. Null and empty texts have no words and fail the base test. Labels that are null, or for
documents that are not there, teach nothing; contradicting labels of one document all count; without labels the list is
empty and only the base test decides. Repeated rows and null doc_ids are rows like others.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import carried, ready, rows_of, saved, spread_mix, texts_of, trim_memory

#: Labelled rows that rules are learned from, at most.
MAX_LABELLED = 20_000
SYMBOLS = "#*$%&|<>"
BLANK_CHARS = "\x20\x09\x0a\x0b\x0c\x0d"
WINDOW = 5
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_same_words long, n_stops long"
THRESHOLDS = 48
MAX_CONDITIONS = 4
MIN_PRECISION = 0.98
MIN_COVERED = 5
MAX_RULES = 24


def repeated_words(hashes: np.ndarray, window: int = WINDOW) -> int:
    """Words inside a window of words that occurs twice or more."""
    n = len(hashes) - window + 1
    if n < 2:
        return 0
    keys = np.zeros(n, np.uint64)
    for k in range(window):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + hashes[k:n + k]
    keys = spread_mix(keys)
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(keys, twice))
    steps = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + window, -1)
    return int((np.cumsum(steps)[:-1] > 0).sum())


def counts_of(text: str | None) -> tuple[int, ...]:
    """The numbers of COUNTS, in that order."""
    text = text or ""
    words = text.encode().split()
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if line.strip(BLANK_CHARS):
            lines += 1
            dup += line in seen
            seen.add(line)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    wide, low = (np.frombuffer(t.encode("utf-32-le"), "<u4") for t in (text, text.lower()))
    upper = int((wide != low).sum()) if len(wide) == len(low) else sum(map(str.isupper, text))
    return (len(words), len(text) - sum(map(text.count, BLANK_CHARS)), sum(map(text.count, SYMBOLS)), dup,
            repeated_words(hashes), lines, upper, int((hashes[1:] == hashes[:-1]).sum()), sum(map(text.count, ".,;:?!")))


def text_counts(text: pd.Series) -> pd.DataFrame:
    names = [part.split()[0] for part in COUNTS.split(", ")]
    rows = [counts_of(t) for t in text]
    trim_memory()
    return pd.DataFrame(rows, columns=names, dtype="int64")


#: Shares that rules test: a count over another one.
MEASURES = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_share": ("n_symbols", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "same_word_share": ("n_same_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "stop_share": ("n_stops", "n_words"),
}


def measured(docs: DataFrame) -> DataFrame:
    """The rows with a struct `_counts` and a struct `_measures`."""
    ready(docs.sparkSession)
    counted = docs.withColumn("_counts", F.pandas_udf(text_counts, COUNTS)(F.col("text").cast("string")))
    return counted.withColumn("_measures", F.struct(*[
        (F.col(f"_counts.{a}") / F.greatest(F.col(f"_counts.{b}"), F.lit(1))).alias(name) for name, (a, b) in MEASURES.items()]))


@dataclass(frozen=True)
class Condition:
    measure: str
    at_least: bool
    threshold: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return table[self.measure] >= self.threshold if self.at_least else table[self.measure] <= self.threshold

    def column(self) -> Column:
        value = F.col(f"_measures.{self.measure}")
        return value >= self.threshold if self.at_least else value <= self.threshold


@dataclass(frozen=True)
class Rule:
    """All conditions hold: rejected."""

    conditions: tuple[Condition, ...]

    def covers(self, table: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
        out = rows.copy()
        for c in self.conditions:
            out &= c.holds(table)
        return out

    def __str__(self) -> str:
        return " AND ".join(f"{c.measure} {'>=' if c.at_least else '<='} {c.threshold:g}" for c in self.conditions)


def _grown(table: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> Rule:
    conditions: list[Condition] = []
    while len(conditions) < MAX_CONDITIONS and (rows & ~bad).any():
        p0, n0 = (rows & bad).sum(), (rows & ~bad).sum()
        best, chosen = 0.0, None
        for name in sorted(table):
            x = table[name]
            cuts = np.unique(np.quantile(x[rows], np.linspace(0, 1, THRESHOLDS)))
            high, low = np.sort(x[rows & bad]), np.sort(x[rows & ~bad])
            for at_least in (True, False):
                if at_least:
                    p, n = len(high) - np.searchsorted(high, cuts), len(low) - np.searchsorted(low, cuts)
                else:
                    p, n = np.searchsorted(high, cuts, side="right"), np.searchsorted(low, cuts, side="right")
                gain = np.where(p > 0, p * (np.log2((p + 1e-9) / np.maximum(p + n, 1)) - np.log2(p0 / (p0 + n0))), 0)
                k = int(gain.argmax())
                if gain[k] > best + 1e-9:
                    best, chosen = float(gain[k]), Condition(name, at_least, float(cuts[k]))
        if chosen is None:
            break
        conditions.append(chosen)
        rows = rows & chosen.holds(table)
    return Rule(tuple(conditions))


def _worth(rule: Rule, table: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> tuple[float, int]:
    covered = rule.covers(table, rows)
    p, n = int((covered & bad).sum()), int((covered & ~bad).sum())
    return (p / (p + n) if p + n else 0.0), p


def _pruned(rule: Rule, table: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> Rule:
    """The shortest head of the rule that loses no precision on rows it was not grown on."""
    heads = [Rule(rule.conditions[:k]) for k in range(1, len(rule.conditions) + 1)]
    scores = [(round(_worth(h, table, bad, rows)[0], 4), -len(h.conditions)) for h in heads]
    return heads[max(range(len(heads)), key=scores.__getitem__)]


def learned_rules(table: dict[str, np.ndarray], bad: np.ndarray, grow: np.ndarray) -> list[Rule]:
    """Sequential covering: `grow` marks the rows that rules are grown on, the others prune and admit them."""
    left = np.ones(len(bad), bool)
    rules: list[Rule] = []
    while len(rules) < MAX_RULES and (left & grow & bad).sum() >= MIN_COVERED:
        rule = _grown(table, bad, left & grow)
        if not rule.conditions:
            break
        rule = _pruned(rule, table, bad, left & ~grow)
        precision, covered = _worth(rule, table, bad, left & ~grow)
        if precision < MIN_PRECISION or not covered or _worth(rule, table, bad, left & grow)[0] < MIN_PRECISION:
            break
        rules.append(rule)
        left &= ~rule.covers(table, left)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that rejects a row, or null: one conditional expression in the order of the list."""
    out = None
    for k, rule in enumerate(rules):
        test = rule.conditions[0].column()
        for c in rule.conditions[1:]:
            test = test & c.column()
        out = F.when(test, k) if out is None else out.when(test, k)
    return F.lit(None).cast("int") if out is None else out


def base_failed() -> Column:
    return F.expr("_counts.n_words < 10 OR 100 * _counts.n_repeat_words > 20 * _counts.n_words")


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Rules from the labels of at most `max_labelled` documents."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("_quality")).where(
        "doc_id IS NOT NULL AND _quality IS NOT NULL")
    order = F.xxhash64("doc_id")
    sample = known.orderBy(order, "doc_id", "_quality").limit(max_labelled)
    # At most max_labelled rows of two numbers. Stored before they are measured: no filter can then have all texts measured first.
    labelled = saved(texts_of(docs).join(F.broadcast(sample), "doc_id"), "labelled-texts")
    rows = measured(labelled).where(~base_failed()).select(
        "_quality", (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(3)) > 0).alias("_grow"), "doc_id", "_measures.*").toPandas()
    rows = rows.sort_values(["doc_id", "_quality", *MEASURES], kind="stable")
    table = {name: rows[name].to_numpy(float) for name in MEASURES}
    return learned_rules(table, rows["_quality"].to_numpy() == 0, rows["_grow"].to_numpy(bool))


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows with `_counts`, `_base_failed`, `_rule` (number of the rejecting rule) and `_kept`."""
    out = measured(docs).withColumn("_base_failed", base_failed()).withColumn("_rule", verdict(rules))
    return out.withColumn("_kept", ~F.col("_base_failed") & F.col("_rule").isNull())


def quality_verdicts(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, the five base counts, base_failed, kept and the number of the rejecting rule."""
    rules = fit(docs, labels, max_labelled)
    return judged(texts_of(docs), rules).select(
        "doc_id", *[f"_counts.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.col("_rule").alias("rule"))


def keep_good(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The kept rows with their own columns."""
    return rows_of(judged(carried(docs), fit(docs, labels, max_labelled)).where("_kept"))
