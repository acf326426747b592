"""Document-risk detectors over page rows (doc_id, page_num, text).

Page text is never shuffled: each detector reduces a page to a few narrow values first. Where a match may cross page
ends, the words around them are joined by themselves, as many as a match can run over.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.functions import scan as S
from casemill.operators.common import carry_forward, in_loads, in_order, page_seams, spanned_words
from casemill.session import ship_package

# ---- fixed values ----------------------------------------------------------
REJECT_AT = 7
MAX_FINDINGS = 50
REQUIRED_FIELDS = (
    ("course_title", r"(course\s+(title|name|number)|[A-Z]{2,6}\s*\d{3,4})"),
    ("credit_hours", r"\b(\d+(\.\d+)?)\s*(credit|semester|unit)s?\b"),
    ("instructor", r"(instructor|professor|faculty|taught\s+by|dr\.?|prof\.?)\s+\w+"),
    ("learning_outcomes", r"(learning\s+outcome|student\s+learning|course\s+objective|upon\s+completion)"),
    ("weekly_topics", r"(week\s*\d+|schedule|course\s+outline|topic\s+list|module\s+\d+)"),
    ("assessment_breakdown", r"(grading|assessment|exam|quiz|midterm|final|assignment)\s*[\:\-\—]?\s*\d{1,3}\s*%"),
    ("contact_hours", r"\b(\d+(\.\d+)?)\s*(contact|lecture|lab|hour)s?\s+(per\s+week|per\s+semester|weekly|total)"),
    ("institution_name", r"(university|college|institute|school)\s+of\s+\w+|\w+\s+(university|college|institute)"),
)
COMPLETE_AT = 0.75
YEAR = r"\b(19[89]\d|20[0-3]\d)\b"
KEYWORDS = (
    "equivalent", "equivalency", "prerequisite", "substitution", "learning outcome", "credit hour", "contact hour",
    "pathology", "anatomy", "physiology", "microbiology", "biochemistry", "epidemiology", "immunology",
    "cell biology", "genetics", "molecular biology", "approved", "meets requirement", "satisfies",
)
DENSITY_AT = 0.04
REPEAT_AT = 3
CREDIT = r"(?i)(\d+(?:\.\d+)?)\s*(?:semester\s+)?credit(?:\s+hour)?s?"
CONTACT = r"(?i)(\d+(?:\.\d+)?)\s*contact\s+hours?"
CREDIT_RANGE, CONTACT_RANGE = (1.0, 6.0), (1.0, 10.0)
COURSE = r"\b([A-Z]{2,6}\s*\d{3,4})\b"
# ----------------------------------------------------------------------------


def findings(pages: DataFrame, text: str = "text", window: int | None = None, max_triggers: int | None = None) -> DataFrame:
    """Pages with their findings in scan order: patterns, trigger words, misspellings, coded text, bonus.

    All trigger words of a page count unless ``max_triggers`` is given; the domain's own limit is 10.
    """
    ship_package(pages.sparkSession)
    prepared = pages.withColumn("_scan", S.scan_form(F.col(text), window)).withColumn(
        "_coded", S.scan_form_each(S.decoded_runs(F.coalesce(F.col(text), F.lit("")))))
    prepared = prepared.withColumn("_low", F.lower("_scan")).withColumns({
        "_words": S.telling_words(F.col("_low")), "_anchors": F.expr(S.anchors_in("_low"))})
    spoken = S.trigger_words(F.col("_words"))
    triggers = F.transform(spoken if max_triggers is None else F.slice(spoken, 1, max_triggers),
                           lambda w: S.finding(1, "trigger_word", "low", S.POINTS["trigger_word"], w))
    typos = F.transform(S.misspelled(F.col("_words")),
                        lambda m: S.finding(2, "typoglycemia", "low", S.POINTS["typoglycemia"], m))
    coded = F.transform(S.speaking("_coded"),
                        lambda _: S.finding(3, "base64_decode", "high", S.POINTS["base64_decode"], F.lit("base64_encoded_injection")))
    out = prepared.withColumn("_signals", F.concat(F.coalesce(S.regex_findings("_scan", "_anchors"), F.array_except(triggers, triggers)), triggers, typos, coded))
    bonus = F.when(F.size("_signals") >= 2, F.array(
        S.finding(4, "bonus", "medium", S.POINTS["bonus"], F.lit("multi_signal_bonus"))))
    out = out.withColumn("findings", F.when(F.size("_signals") >= 2, F.concat("_signals", bonus)).otherwise(F.col("_signals")))
    return out.drop("_scan", "_low", "_coded", "_words", "_anchors", "_signals")


def page_points() -> Column:
    return F.aggregate("findings", F.lit(0), lambda acc, f: acc + f["points"])


def verdicts(found: DataFrame, threshold: int = REJECT_AT) -> DataFrame:
    """Total risk of each document and whether it is let through."""
    return found.groupBy("doc_id").agg(
        F.sum(page_points()).alias("total_score"), F.sum(F.size("findings")).alias("n_findings")
    ).withColumn("verdict", F.when(F.col("total_score") >= threshold, "reject").otherwise("allow"))


def reported(found: DataFrame, limit: int | None = MAX_FINDINGS) -> DataFrame:
    """Finding rows in scan order, the first ``limit`` of each document.

    The rank filter lets Spark cut each task's rows before the shuffle.
    """
    # The outer form: a plain explode makes the optimizer test the array's size below it, which scans the text twice.
    rows = found.select("doc_id", "page_num", F.posexplode_outer("findings").alias("place", "f")).filter(
        "f IS NOT NULL").select("doc_id", "page_num", "place", "f.detector", "f.severity", "f.points", "f.match")
    if limit is None:
        return rows
    order = Window.partitionBy("doc_id").orderBy("page_num", "place")
    return rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit)


def split_by_verdict(documents: DataFrame, verdict: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(let through, quarantined) documents; quarantined rows are kept, not deleted."""
    rejected = verdict.filter("verdict = 'reject'").select("doc_id")
    return documents.join(rejected, "doc_id", "left_anti"), documents.join(rejected, "doc_id", "left_semi")


def metadata_findings(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Findings in metadata values, as page 0."""
    pages = rows.select("doc_id", F.lit(0).alias("page_num"), F.concat_ws(" ", *columns).alias("text"))
    return findings(pages).withColumn("source", F.lit("metadata"))


# ---- page ends -------------------------------------------------------------

def _joined() -> Column:
    return F.concat("tail", F.lit(" "), "head")


def _across(pattern: str) -> Column:
    """Matches that only exist across the page end."""
    n = lambda c: F.regexp_count(c, F.lit(pattern))
    return F.greatest(F.lit(0), n(_joined()) - n(F.col("tail")) - n(F.col("head")))


# ---- single-document checks ------------------------------------------------

def completeness(pages: DataFrame) -> DataFrame:
    """Which required fields a document mentions, and whether enough of them."""
    def flags(text: Column) -> list[Column]:
        low = F.lower(F.regexp_replace(text, r"(?U)\s+", " "))
        return [low.rlike(f"(?iU){p}").alias(name) for name, p in REQUIRED_FIELDS]

    inside = pages.select("doc_id", *flags(F.col("text")))
    across = page_seams(pages, spanned_words(*(p for _, p in REQUIRED_FIELDS))).select("doc_id", *flags(_joined()))
    names = [n for n, _ in REQUIRED_FIELDS]
    per_doc = inside.unionByName(across).groupBy("doc_id").agg(*[F.bool_or(n).alias(n) for n in names])
    missing = F.array_compact(F.array(*[F.when(~F.col(n), F.lit(n)) for n in names]))
    share = (F.lit(len(names)) - F.size(missing)) / len(names)
    return per_doc.select("doc_id", F.round(share, 3).alias("score"), (share >= COMPLETE_AT).alias("is_complete"),
                          missing.alias("missing_fields"))


def recency(pages: DataFrame, current_year: int, max_age: int = 10) -> DataFrame:
    """Newest year mentioned; expired when it is older than the cut-off, not when no year is found."""
    years = F.regexp_extract_all("text", F.lit(f"(?U){YEAR}"), F.lit(1))
    newest = F.array_max(F.transform(years, lambda y: y.cast("int")))
    out = pages.groupBy("doc_id").agg(F.max(newest).alias("most_recent_year"))
    return out.withColumn("is_expired", F.coalesce(F.col("most_recent_year") < current_year - max_age, F.lit(False)))


def sentences(pages: DataFrame) -> DataFrame:
    """Sentence pieces of each document (doc_id, piece), whole also where one runs over page ends.

    Pieces inside a page are complete as they stand. A page's first and last piece may belong to a longer one:
    those alone are carried to where they start and put together.
    """
    cut = pages.select("doc_id", "page_num", F.split("text", r"[.!?\n]").alias("p"))
    n = F.size("p")
    inner = cut.select("doc_id", F.explode(F.when(n > 2, F.slice("p", 2, n - 2))).alias("piece"))
    first = F.struct(F.lit(0).alias("i"), F.element_at("p", 1).alias("piece"))
    last = F.struct((n - 1).alias("i"), F.element_at("p", -1).alias("piece"))
    outer = cut.select("doc_id", "page_num", F.explode(F.when(n > 1, F.array(first, last)).otherwise(F.array(first))).alias("e"))
    outer = outer.select("doc_id", "page_num", "e.i", "e.piece").withColumn(
        "start", F.when(F.col("i") > 0, F.struct("page_num", "i")))
    keyed = carry_forward(outer, ["doc_id"], F.floor(F.col("page_num") / 64), ["page_num", "i"], "start", "began")
    whole = keyed.groupBy("doc_id", "began").agg(in_order(["page_num", "i"], "piece", " ").alias("piece"))
    return inner.unionByName(whole.select("doc_id", "piece"))


def repeated_sentences(pages: DataFrame) -> DataFrame:
    """Sentences of more than 20 characters that occur three times or more in a document."""
    text = F.lower(F.regexp_replace("piece", r"(?U)^\s+|\s+$", ""))
    kept = sentences(pages).select("doc_id", text.alias("s")).filter(F.length("s") > 20)
    counted = kept.groupBy("doc_id", F.md5("s").alias("_h")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.substring("s", 1, 60)).alias("sentence"))
    return counted.filter(F.col("n") >= REPEAT_AT).select("doc_id", "sentence", "n")


def keyword_density(pages: DataFrame) -> DataFrame:
    """Share of flagged keywords among all words, top offenders and repeated texts."""
    single = [k for k in KEYWORDS if " " not in k]
    multi = [k for k in KEYWORDS if " " in k]
    listed = F.array(*[F.lit(k) for k in single])
    low = F.lower("text")
    tokens = F.regexp_extract_all(low, F.lit(r"(?U)(\w+)"), F.lit(1))
    phrase = lambda k: F.lit("(?iu)" + k)

    def times(k: str) -> Column:
        return F.size(F.filter("_k", lambda w: w == k))

    counts = pages.withColumn("_w", tokens).withColumn("_k", F.filter("_w", lambda w: F.array_contains(listed, w)))
    per_page = counts.select(
        "doc_id", F.size("_w").alias("n_words"),
        *[times(k).alias(k) for k in single],
        *[F.regexp_count("text", phrase(k)).alias(k) for k in multi])
    per_seam = page_seams(pages, spanned_words(*multi)).select("doc_id", F.lit(0).alias("n_words"), *[F.lit(0).alias(k) for k in single],
                                   *[_across("(?iu)" + k).alias(k) for k in multi])
    doc = per_page.unionByName(per_seam).groupBy("doc_id").agg(
        F.sum("n_words").alias("n_words"), *[F.sum(k).alias(k) for k in (*single, *multi)])
    flagged = sum((F.col(k) for k in KEYWORDS), F.lit(0))
    ranked = F.array_sort(F.array_compact(F.array(*[
        F.when(F.col(k) > 0, F.struct((-F.col(k)).alias("n"), F.lit(i).alias("i"), F.lit(k).alias("k")))
        for i, k in enumerate(single)])))
    top = F.transform(F.slice(ranked, 1, 10), lambda r: F.concat(r["k"], F.lit(" x"), (-r["n"]).cast("string")))
    repeats = repeated_sentences(pages).groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    frequent = sum((F.when(F.col(k) >= REPEAT_AT, 1).otherwise(0) for k in multi), F.lit(0))
    share = flagged / F.greatest(F.col("n_words"), F.lit(1))
    out = doc.join(repeats, "doc_id", "left").withColumn("n_repeated", frequent + F.coalesce("_n", F.lit(0)))
    return out.select("doc_id", "n_words", flagged.alias("n_flagged"), F.round(share, 4).alias("density"),
                      top.alias("top_offenders"), "n_repeated",
                      ((share >= DENSITY_AT) | (F.col("n_repeated") > 0)).alias("is_suspicious"))


def _page_values(pages: DataFrame, patterns: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Every value a pattern finds, inside pages and across page ends (doc_id, kept columns, kind, value, n).

    One projection reduces a page to its values, another to its first and last words, as many as a match can run over.
    What those of two pages hold together beyond what each holds alone runs over the page end.
    """
    def named(kind: str, sign: int):
        return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), F.lit(sign).alias("n"))

    def found(text: Column, sign: int) -> Column:
        return F.concat(*[F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), named(kind, sign)) for kind, p in patterns.items()])

    inside = pages.select("doc_id", *keep, F.explode(found(F.col("text"), 1)).alias("v"))
    seams = page_seams(pages, spanned_words(*patterns.values()), keep)
    seam = F.concat(found(_joined(), 1), found(F.col("tail"), -1), found(F.col("head"), -1))
    every = inside.unionByName(seams.select("doc_id", *keep, F.explode(seam).alias("v")))
    return every.groupBy("doc_id", *keep, "v.kind", "v.value").agg(F.sum("v.n").alias("n")).filter("n > 0")


def field_consistency(pages: DataFrame) -> DataFrame:
    """Credit and contact-hour values that are out of range or disagree within a document."""
    found = _page_values(pages, {"credit": CREDIT, "contact": CONTACT + r"(?:\s+per\s+week)?"})
    every = found.withColumn("value", F.col("value").cast("double"))
    low, high = (F.when(F.col("kind") == "credit", F.lit(a)).otherwise(F.lit(b))
                 for a, b in zip(CREDIT_RANGE, CONTACT_RANGE))
    per_kind = every.groupBy("doc_id", "kind").agg(
        F.countDistinct("value").alias("n_values"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.sum(F.when(~F.col("value").between(low, high), F.col("n")).otherwise(0)).alias("n_out_of_range"))
    issues = F.col("n_out_of_range") + F.when(F.col("n_values") > 1, 1).otherwise(0)
    return per_kind.withColumn("n_issues", issues)


def document_values(pages: DataFrame, request: str = "request_id") -> DataFrame:
    """Distinct credits, hours, years and course codes of each document (request, doc_id, kind, value)."""
    found = _page_values(pages, {"credits": CREDIT, "contact_hours": CONTACT, "years": f"(?U){YEAR}", "course_codes": f"(?U){COURSE}"}, (request,))
    number = F.col("kind").isin("credits", "contact_hours")
    value = F.when(number, F.col("value").cast("double").cast("string")).otherwise(F.col("value"))
    return found.select(request, "doc_id", "kind", value.alias("value")).distinct()


#: Sets of a block, and rows that the block pairs of one task have together.
PAIR_BLOCK = 512
ROWS_PER_TASK = 16_384
LOAD_RUNS = 64


def block_pairs(sets: DataFrame, key: list[str], block: int = PAIR_BLOCK, load: int = ROWS_PER_TASK) -> DataFrame:
    """Rows of `sets` (key, sig, ...) once for each pair of blocks they belong to, with the pair (_i, _j) and its task (_task).

    The sets of a key that fill more than one block are ranked and cut into blocks of exactly ``block``; pairs of blocks are
    numbered by the running sum of their rows, so a task holds about ``load`` rows whatever the size of a key, and small
    keys share one.
    """
    counts = sets.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    zero = F.lit(0)
    small = in_loads(counts.filter(F.col("_n") <= block), key, "_n", load, "_task", LOAD_RUNS).drop("_n")
    whole = sets.join(small, key).withColumns({"_b": zero, "_i": zero, "_j": zero})
    # Ranks inside parts of a key by hash: a key of any size is ranked in many tasks.
    large = counts.filter(F.col("_n") > block)
    parts = F.ceil(F.col("_n") / (4 * block)).cast("int")
    parted = sets.join(large, key).withColumn("_part", F.pmod(F.xxhash64("sig"), parts).cast("int"))
    sized = parted.groupBy(*key, "_part").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_own"))
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*key)
    starts = sized.select(*key, "_part", F.coalesce(F.sum("_own").over(before), zero).cast("int").alias("_start"),
                          F.sum("_own").over(every).cast("int").alias("_blocks"))  # a row for each part
    place = F.row_number().over(Window.partitionBy(*key, "_part").orderBy("sig")) - 1
    ranked = parted.withColumn("_b", F.floor(place / block).cast("int")).join(starts, [*key, "_part"])
    ranked = ranked.withColumns({"_b": F.col("_b") + F.col("_start"), "_other": F.explode(F.sequence(zero, F.col("_blocks") - 1))})
    met = ranked.withColumns({"_i": F.least("_b", "_other"), "_j": F.greatest("_b", "_other")})
    first = starts.select(*key, "_blocks").distinct().select(*key, "_blocks", F.explode(F.sequence(zero, F.col("_blocks") - 1)).alias("_i"))
    pairs = first.select(*key, "_i", F.explode(F.sequence("_i", F.col("_blocks") - 1)).alias("_j"), F.lit(2 * block).alias("_rows"))
    tasks = in_loads(pairs, [*key, "_i", "_j"], "_rows", load, "_task", LOAD_RUNS).drop("_rows")
    split = met.join(tasks, [*key, "_i", "_j"]).select(*whole.columns)
    return whole.unionByName(split)


def _sharing_pairs(sets: DataFrame, key: list[str]) -> DataFrame:
    """Per key: the weight of all pairs of sets that share a value (key, met); `sets` has key, sig, w.

    A block meets a block inside a task, where a product of membership matrices counts the pairs: only counts leave it,
    and the hottest key is spread over its block pairs.
    """

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, block in frame.groupby([*key, "_i", "_j"], sort=False):
            values: dict[str, int] = {}
            rows = [[values.setdefault(v, len(values)) for v in sig.split("|")] for sig in block["sig"]]
            held = np.zeros((len(rows), len(values)), np.float32)
            for k, row in enumerate(rows):
                held[k, row] = 1
            w, left = block["w"].to_numpy(np.int64), (block["_b"] == name[-2]).to_numpy()
            if name[-2] == name[-1]:
                met = np.triu(held @ held.T > 0, 1)
                out.append((*name[:-2], int(w @ met @ w)))
            else:
                met = held[left] @ held[~left].T > 0
                out.append((*name[:-2], int(w[left] @ met @ w[~left])))
        return pd.DataFrame(out, columns=[*key, "met"])

    ship_package(sets.sparkSession)
    types = ", ".join(f"{c} {dict(sets.dtypes)[c]}" for c in key)
    dealt = block_pairs(sets, key, PAIR_BLOCK, ROWS_PER_TASK).select(*key, "sig", "w", "_b", "_i", "_j", "_task")
    return dealt.groupBy("_task").applyInPandas(count, f"{types}, met long").groupBy(*key).agg(F.sum("met").alias("met"))


def contradictions(values: DataFrame, request: str = "request_id") -> DataFrame:
    """Per case and kind: documents with values, their pairs, and the pairs that share no value.

    Documents with equal value sets are folded into one weighted set. Conflicting pairs are all pairs less those that
    share a value, which are counted block by block; no pair list is formed.
    """
    key = [request, "kind"]
    sets = values.groupBy(*key, "doc_id").agg(F.array_join(F.array_sort(F.collect_set("value")), "|").alias("sig"))
    weights = sets.groupBy(*key, "sig").agg(F.count(F.lit(1)).alias("w"))
    totals = weights.groupBy(*key).agg(F.sum("w").alias("n_docs"), F.sum(F.col("w") * (F.col("w") - 1) / 2).alias("same"))
    pairs = F.col("n_docs") * (F.col("n_docs") - 1) / 2
    out = totals.join(_sharing_pairs(weights, key), key, "left")
    return out.select(*key, "n_docs", pairs.cast("long").alias("n_pairs"),
                      (pairs - F.col("same") - F.coalesce("met", F.lit(0))).cast("long").alias("n_conflicts"))


# ---- page statistics -------------------------------------------------------

def text_coverage(pages: DataFrame, short: int = 40, empty: int = 50) -> DataFrame:
    """Image-only and needs-OCR tests from page lengths."""
    n = F.length(F.coalesce("text", F.lit("")))
    return pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_pages"), (F.avg((n < short).cast("int")) >= 0.8).alias("image_only"),
        F.bool_and(n < empty).alias("all_short"), (F.avg((n < empty).cast("int")) > 0.5).alias("mostly_short"))
