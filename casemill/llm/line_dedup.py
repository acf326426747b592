"""Line dedup by a log-template tree of fixed depth that learns which words of a line vary.

Runs of digits count as one field, blanks as one blank. The path of a line in the tree is its number of words and its first
`DEPTH` words, one of which, at any of the places, may be a wild card: a line hangs on `DEPTH` leaves, so a field among the
first words does not part the lines of a template. In a leaf with different lines the documents of every word are counted
at every place behind it; a place where no word has half of the leaf's documents is open, however many there are. A
template is what is left of a line: its words at the other places. It counts if at least `FIXED_SHARE` of the words, and
`MIN_FIXED`, are fixed.

A template that stands in `MIN_DOCUMENTS` documents recurs, and every line of it is dropped, in whatever document. So does a
line of any length that stands as it is in so many documents; for a line of `LONG_WORDS` words, two documents are enough.

All of it is built-in functions, joins and grouped counts. Keys are counted in tasks before they are shuffled; only leaves
that recur are looked into, and of these every different line once, with the number of its documents.

Rows with equal doc_id and text count as one document and lose the same lines. Null text has no lines and stays null; a text
that loses all lines is empty; a line without words stays; a null doc_id is kept. Empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import saved, texts_of

DEPTH = 4
MIN_FIXED = 3
FIXED_SHARE = (2, 3)
MIN_DOCUMENTS = 3
LONG_WORDS, LONG_DOCUMENTS = 50, 2
# A field of digits and what stands for it, and blanks inside a line.
DIGITS, DIGITS_MARK = "[0-9]+", "0"
LINE_BLANKS = r"[\x20\x09\x0B-\x0D]+"
MORE_THAN_A_BLANK = ("\x20\x20", "\x09", "\x0b", "\x0c", "\x0d")


def plain_lines(text: Column) -> Column:
    """The lines of a text in the form in which they are compared."""
    wide = reduce(Column.__or__, [text.contains(b) for b in MORE_THAN_A_BLANK])
    single = F.when(wide, F.regexp_replace(text, LINE_BLANKS, " ")).otherwise(text)
    return F.transform(F.split(F.regexp_replace(single, DIGITS, DIGITS_MARK), "\n"), lambda x: F.trim(x))


def _keys(first: Column, n: Column, line: Column, depth: int) -> Column:
    """The key of a line as it is, and one for each place of the path that is a wild card; none for a line without words.

    ``first`` are the first words; a line that is no longer than the path has no leaves.
    """
    words = [F.get(first, k) for k in range(depth)]
    paths = [F.xxhash64(F.lit(k), n, *[w for i, w in enumerate(words) if i != k]) for k in range(depth)]
    exact = F.xxhash64(F.lit(-1), line)
    return F.when(line == "", F.array().cast("array<bigint>")).when(n >= depth, F.array(exact, *paths)).otherwise(F.array(exact))


def _row_key() -> Column:
    return F.xxhash64("doc_id", "text").alias("row_key")


def line_keys(docs: DataFrame, depth: int = DEPTH, long_words: int = LONG_WORDS) -> DataFrame:
    """row_key, doc_id, lines: for each line whether it is long, and its keys."""
    # What a lambda names twice is worked out twice, so each step hands the next one what it has found.
    n_words = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    cut = F.transform(plain_lines(F.col("text")), lambda x: F.struct(
        x.alias("line"), F.split(F.substring_index(x, " ", depth), " ").alias("first"), n_words(x).alias("n")))
    keyed = F.transform(cut, lambda x: F.struct((x["n"] >= long_words).alias("long"), _keys(x["first"], x["n"], x["line"], depth).alias("keys")))
    return texts_of(docs).where("text IS NOT NULL").select(_row_key(), "doc_id", keyed.alias("lines"))


def _placed(lines: DataFrame, usual: int, long: int) -> DataFrame:
    """row_key, doc_id, line, exact, key, weight: each key of each line; a key recurs if its documents weigh enough."""
    rows = lines.select("row_key", "doc_id", F.posexplode("lines").alias("line", "x"))
    rows = rows.select("row_key", "doc_id", "line", "x.long", F.get("x.keys", F.lit(0)).alias("exact"), F.posexplode("x.keys").alias("place", "key"))
    return rows.select("row_key", "doc_id", "line", "exact", "key", F.when((F.col("place") == 0) & F.col("long"), long).otherwise(usual).alias("weight"))


def recurring_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, depth: int = DEPTH, long_words: int = LONG_WORDS,
                    long_documents: int = LONG_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """Lines that recur as they are (row_key, doc_id, line), and lines in recurring leaves (the same, leaf, exact). Stored."""
    enough = min_documents * long_documents
    lines = saved(line_keys(docs, depth, long_words), "line-keys")
    keyed = _placed(lines, long_documents, min_documents)
    # A first count in which every line of a document and every equal row counts: nothing that recurs is below it.
    counted = keyed.groupBy("key").agg(F.sum("weight").alias("w"))
    likely = saved(counted.where(F.col("w") >= enough).select("key"), "likely-keys")
    # What recurs grows with the corpus: merged, not broadcast, at every size.
    hits = saved(keyed.join(likely.hint("merge"), "key", "left_semi"), "likely-lines")
    often = hits.select("key", "weight", "row_key", "doc_id").distinct().groupBy("key").agg(F.sum("weight").alias("w"))
    often = often.where(F.col("w") >= enough).select("key")
    found = saved(hits.join(often.hint("merge"), "key", "left_semi"), "recurring-lines")
    return (found.where("key = exact").select("row_key", "doc_id", "line"),
            found.where("key <> exact").select("row_key", "doc_id", "line", F.col("key").alias("leaf"), "exact"))


def different_lines(in_leaves: DataFrame, docs: DataFrame) -> DataFrame:
    """leaf, exact, n, words: of leaves with more than one line, every different line once, with the number of its documents
    and its words as hashes."""
    # Equal rows count once.
    same = in_leaves.distinct().groupBy("leaf", "exact").agg(
        F.count("*").alias("n"), F.min(F.struct("row_key", "line")).alias("at"))
    several = in_leaves.groupBy("leaf").agg(F.min("exact").alias("a"), F.max("exact").alias("z")).where("a <> z").select("leaf")
    kept = saved(same.join(several.hint("merge"), "leaf", "left_semi").select("leaf", "exact", "n", "at.row_key", "at.line"), "different-lines")
    wanted = kept.groupBy("row_key").agg(F.collect_set("line").alias("_lines"))
    rows = texts_of(docs).select(_row_key(), "text").join(wanted.hint("merge"), "row_key")
    here = F.filter(F.transform(plain_lines(F.col("text")), lambda x, i: F.when(F.array_contains("_lines", i), F.struct(i.alias("line"), x.alias("plain")))),
                    lambda x: x.isNotNull())
    lines = rows.select("row_key", F.inline(here)).dropDuplicates(["row_key", "line"])
    words = lines.select("row_key", "line", F.transform(F.split("plain", " "), lambda w: F.xxhash64(w)).alias("words"))
    return saved(kept.join(words.hint("merge"), ["row_key", "line"]).select("leaf", "exact", "n", "words"), "line-words")


def learned_templates(different: DataFrame, min_fixed: int = MIN_FIXED, share: tuple[int, int] = FIXED_SHARE) -> DataFrame:
    """leaf, exact, template: the words of each line that do not vary in its leaf, where enough are left."""
    each = different.select("leaf", "n", F.posexplode("words").alias("place", "word"))
    words = each.groupBy("leaf", "place", "word").agg(F.sum("n").alias("n"))
    places = words.groupBy("leaf", "place").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    fixed = places.groupBy("leaf").agg(F.count("*").alias("n_words"), F.sort_array(F.collect_list(F.when(2 * F.col("top") >= F.col("n"), F.col("place")))).alias("fixed"))
    left = F.size("fixed")
    known = fixed.where((left < F.col("n_words")) & (left >= min_fixed) & (share[1] * left >= share[0] * F.col("n_words")))
    met = different.join(known.hint("merge"), "leaf")
    return met.select("leaf", "exact", F.xxhash64("leaf", F.transform("fixed", lambda p: F.get("words", p))).alias("template"))


def dropped_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, depth: int = DEPTH, long_words: int = LONG_WORDS,
                  long_documents: int = LONG_DOCUMENTS, min_fixed: int = MIN_FIXED, share: tuple[int, int] = FIXED_SHARE) -> DataFrame:
    """row_key, doc_id, lines: the numbers of the lines that go, for documents that lose any. Stored."""
    as_they_are, in_leaves = recurring_lines(docs, min_documents, depth, long_words, long_documents)
    templates = learned_templates(different_lines(in_leaves, docs), min_fixed, share)
    fitted = saved(in_leaves.join(templates.hint("merge"), ["leaf", "exact"]).select("row_key", "doc_id", "line", "template"), "template-lines")
    often = fitted.select("template", "row_key", "doc_id").distinct().groupBy("template").agg(F.count("*").alias("n"))
    often = often.where(F.col("n") >= min_documents).select("template")
    gone = as_they_are.unionByName(fitted.join(often.hint("merge"), "template", "left_semi").select("row_key", "doc_id", "line"))
    return saved(gone.groupBy("row_key", "doc_id").agg(F.sort_array(F.collect_set("line")).alias("lines")), "dropped-lines")


def without_lines(docs: DataFrame, **shape) -> DataFrame:
    """doc_id, text without its recurring lines, n_lines, n_dropped for every row."""
    gone = dropped_lines(docs, **shape).select("row_key", F.col("doc_id").alias("_doc_id"), "lines")
    rows = texts_of(docs).withColumn("row_key", _row_key())
    rows = rows.join(gone.hint("merge"), (rows["row_key"] == gone["row_key"]) & rows["doc_id"].eqNullSafe(gone["_doc_id"]), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("lines", i)), "\n")
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return rows.select(
        "doc_id", F.when(F.col("lines").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_dropped"))
