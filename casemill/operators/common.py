"""Shapes shared by many operators: newest per key, ordered carry-over, dense numbering."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.session import shared_dir


#: What one task of a wide shuffle holds at most, on average: rows, or characters of text.
ROWS_PER_TASK = 100_000
CHARS_PER_TASK = 16_000_000


def tasks_for(*tables: DataFrame, rows: int = ROWS_PER_TASK) -> int:
    """How many tasks the rows of some tables are dealt to, so that a task's share does not grow with them.

    Named with ``repartition``: numbers that Spark picks by itself follow the compressed size of a shuffle, and texts that
    repeat compress a hundredfold.
    """
    return 1 + sum(df.count() for df in tables) // rows


def text_tasks(pages: DataFrame, text: str = "text") -> int:
    """The same by the characters of a text column; a row counts as a hundred more."""
    size = F.sum(F.coalesce(F.length(text), F.lit(0)) + 100)
    return 1 + (pages.agg(size).first()[0] or 0) // CHARS_PER_TASK


def of_keys(rows: DataFrame, keys: DataFrame, key: str, tasks: int) -> DataFrame:
    """Rows whose key is among ``keys``. Keys grow with the input, so they are shuffled and never sent to every task.

    A semi join would be moved before the repartition, to tasks of Spark's own number; one with distinct keys stays.
    """
    mine = keys.select(key).repartition(tasks, key).distinct()
    return rows.repartition(tasks, key).join(mine.hint("merge"), key).select(*rows.columns)


def newest_per(df: DataFrame, keys: Sequence[str], order: Sequence[str], oldest: bool = False) -> DataFrame:
    """One row per key, the greatest (or least) by ``order``.

    A partial aggregate keeps one row per key and task, so a hot key never gathers its rows in one task
    the way a ranking window would.
    """
    pick = F.min_by if oldest else F.max_by
    rest = [c for c in df.columns if c not in keys]
    best = pick(F.struct(*rest), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*df.columns)


def carry_forward(
    df: DataFrame,
    keys: Sequence[str],
    segment: Column,
    order: Sequence[str],
    value: str,
    out: str,
    include_current: bool = True,
    levels: int = 2,
    tasks: int | None = None,
) -> DataFrame:
    """Last non-null ``value`` before (or at) each row in ``order`` within ``keys``.

    ``segment`` is a whole number that grows with ``order`` and cuts a key's rows into runs. Rows are windowed only
    inside a run. What a run inherits comes from one summary row per run; with ``levels`` > 1 the summaries are
    themselves cut into runs of 1024, so that one huge key is spread over many tasks. ``tasks`` says how many tasks the runs
    are dealt to.
    """
    seg, inherited, last = f"_{out}_seg{levels}", f"_{out}_inherited{levels}", f"_{out}_last{levels}"
    cut = df.withColumn(seg, segment)
    if tasks is not None:
        cut = cut.repartition(tasks, *keys, seg)
    span = Window.partitionBy(*keys, seg).orderBy(*order)
    frame = span.rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    local = cut.withColumn(out, F.last(value, ignorenulls=True).over(frame))
    runs = cut.groupBy(*keys, seg).agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias(last))
    if levels > 1:
        carried = carry_forward(runs, keys, F.floor(F.col(seg) / 1024), [seg], last, inherited, False, levels - 1)
    else:
        before = Window.partitionBy(*keys).orderBy(seg).rowsBetween(Window.unboundedPreceding, -1)
        carried = runs.withColumn(inherited, F.last(last, ignorenulls=True).over(before))
    carried = carried.select(*keys, seg, inherited)
    return (
        local.join(carried if tasks is None else carried.hint("merge"), [*keys, seg], "left")
        .withColumn(out, F.coalesce(out, inherited))
        .drop(seg, inherited)
    )


def spanned_words(*patterns: str) -> int:
    """The most words, parted by white space, that a match of one of the patterns can run over.

    Holds for patterns in which white space is only named as ``\\s`` or a blank and never repeated as part of a group.
    """
    return max(p.count(r"\s") + p.count(" ") for p in patterns) + 1


def first_words(text: Column, n: int) -> Column:
    """The first ``n`` words of a text with the white space before and between them; all of a text that has fewer."""
    return F.when(text.rlike(r"^\s*+(?:\S++\s++){%d}" % n), F.regexp_extract(text, r"^\s*+(?:\S++\s++){%d}\S++" % (n - 1), 0)).otherwise(text)


def last_words(text: Column, n: int) -> Column:
    """The last ``n`` words, likewise."""
    return F.reverse(first_words(F.reverse(text), n))


def words_before(rows: DataFrame, keys: Sequence[str], order: str, tail: str, n: int, out: str, sep: str = " ",
                 size: int = 1024, levels: int = 1) -> DataFrame:
    """``out``: the last ``n`` words of ``tail`` over all earlier rows of a key, joined by ``sep``; null for its first row.

    Every ``tail`` holds a word, so the ``n`` rows before a row are enough, and a frame never holds more. Rows are windowed
    inside runs of ``size`` values of ``order``; what a run inherits comes from the last rows of the runs before it, one
    summary for each run, so a key with any number of rows is spread over tasks.
    """
    seg, near, inherited = f"_seg{levels}", f"_near{levels}", f"_inherited{levels}"
    joined = lambda c: F.when(F.size(c) > 0, last_words(F.array_join(c, sep), n))
    if levels == 0:
        span = Window.partitionBy(*keys).orderBy(order).rowsBetween(-n, -1)
        return rows.withColumn(out, joined(F.collect_list(tail).over(span)))
    cut = rows.withColumn(seg, F.floor(F.col(order) / size))
    span = Window.partitionBy(*keys, seg).orderBy(order).rowsBetween(-n, -1)
    local = cut.withColumn(near, F.collect_list(tail).over(span))
    ends = F.slice(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(tail).alias("t"))), asc=False), 1, n)
    runs = cut.groupBy(*keys, seg).agg(ends.alias("_ends"))
    runs = runs.select(*keys, seg, joined(F.transform(F.reverse("_ends"), lambda e: e["t"])).alias("_tail"))
    carried = words_before(runs, keys, seg, "_tail", n, inherited, sep, size, levels - 1).select(*keys, seg, inherited)
    whole = F.concat(F.array_compact(F.array(inherited)), near)
    return local.join(carried, [*keys, seg], "left").withColumn(out, joined(whole)).drop(seg, near, inherited)


def page_seams(pages: DataFrame, words: int, keep: Sequence[str] = (), text: str = "text", sep: str = " ") -> DataFrame:
    """For each page with text but the first of its document: the last words before it and its own first ones.

    (doc_id, kept columns, page_num, tail, head.) ``words`` is how many words a match can run over, so ``tail`` and ``head``
    have one less each. Pages without text are passed over, and the tail of a short page grows by those before it: a
    match is seen over any number of short or empty pages.
    """
    n = max(words - 1, 1)
    held = pages.filter(F.col(text).rlike(r"\S")).select(
        "doc_id", *keep, "page_num", last_words(F.col(text), n).alias("_own"), first_words(F.col(text), n).alias("head"))
    return words_before(held, ["doc_id"], "page_num", "_own", n, "tail", sep).filter("tail IS NOT NULL").drop("_own")


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the shared folder and read from there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved_ranges(df: DataFrame, order: Sequence[str], tasks: int | None = None) -> DataFrame:
    """The rows dealt to ranges of ``order`` of about equal size and written to the shared folder, with ``_range``."""
    path = f"{shared_dir(df.sparkSession)}/ranges-{uuid.uuid4().hex}"
    (df.repartitionByRange(*order) if tasks is None else df.repartitionByRange(tasks, *order)).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def dense_index(df: DataFrame, key: str, out: str) -> DataFrame:
    """0-based position of each row by a unique ``key``, without one global sort task.

    Rows are dealt to ranges of about equal size, whatever the spread of the keys, and written to the shared folder, so
    that the ranges stay as they are; inside a range rows are ranked, and the counts of all earlier ranges, one number
    each, are added.
    """
    cut = saved_ranges(df, [key])
    sizes = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1
    return (
        cut.withColumn(out, place.cast("long"))
        .join(starts, "_range")
        .withColumn(out, F.col(out) + F.col("_start"))
        .drop("_range", "_start")
    )


def in_loads(items: DataFrame, order: Sequence[str], weight: str, limit: int, out: str, runs: int) -> DataFrame:
    """``out``: a task number such that rows of one number weigh ``limit`` together, or less, or one row more.

    Rows are dealt to ``runs`` runs by a hash of ``order``, which must name a row, and summed up inside each.
    """
    run = F.pmod(F.xxhash64(*order), F.lit(runs))
    before = Window.partitionBy("_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    load = F.floor(F.coalesce(F.sum(weight).over(before), F.lit(0)) / limit)
    return items.withColumn("_run", run).withColumn(out, F.xxhash64("_run", load)).drop("_run")


def in_order(order: str | Sequence[str], item: str | Column, sep: str) -> Column:
    """Aggregate: items of a group joined by ``sep`` in ``order`` (collected order alone is not fixed)."""
    order = [order] if isinstance(order, str) else list(order)
    item = F.col(item) if isinstance(item, str) else item
    rows = F.array_sort(F.collect_list(F.struct(*order, item.alias("_item"))))
    return F.array_join(F.transform(rows, lambda r: r["_item"]), sep)
