"""Required items against found items by a dictionary of distinct pairs.

The same items stand in very many cases, so each distinct pair is compared once. Pairs that can match at all are found by
two inverted indexes. For the shared-token rule a required item is looked up by so many of its rarest tokens that a found
item without any of them cannot share enough. For containment the shorter text is looked up by one of its letter runs, its
rarest, among the runs of the longer ones. Candidates are then compared by the same rule that :func:`decision.split_matches`
applies row by row, and the pairs that match are joined back to the cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.functions import text as X
from casemill.operators import decision as D
from casemill.operators.common import saved

#: Letters of a run; shorter texts are looked up whole.
RUN = 3


def _items(items: DataFrame, name: str) -> DataFrame:
    """Distinct items with lower-case form and tokens, as <name>, <name>_low and <name>_toks."""
    c = F.col("item")
    return items.select(c).distinct().select(
        c.alias(name), F.lower(X.strip(c)).alias(f"{name}_low"), X.tokens(c).alias(f"{name}_toks"))


def _ranked(rows: DataFrame, value: str, among: DataFrame, item: str) -> DataFrame:
    """Rows of (item, value) with ``_n``, the number of rows of ``among`` with that value, and their rank by it, rarest first."""
    counts = among.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    counted = rows.join(counts, value, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    return counted.withColumn("_rank", F.row_number().over(Window.partitionBy(item).orderBy("_n", value)))


def _runs(low: Column, sizes: tuple[int, ...]) -> Column:
    """Distinct letter runs of a text, of the given sizes."""
    n = F.length(low)

    def of(k: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(low, i, F.lit(k)))
        return F.when(n >= k, every).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of(k) for k in sizes]))


def sharing_tokens(required: DataFrame, found: DataFrame) -> DataFrame:
    """Candidate (r, f): enough tokens can only be shared by items that share one of the first tokens of r."""
    theirs = found.select("f", F.explode("f_toks").alias("token"))
    size = F.size("r_toks")
    own = required.select("r", F.explode("r_toks").alias("token"), (size - F.ceil(size * D.TOKEN_SHARE - 1e-9) + 1).alias("_prefix"))
    first = _ranked(own, "token", theirs, "r").filter(F.col("_rank") <= F.col("_prefix"))
    return first.select("r", "token").join(theirs, "token").select("r", "f").distinct()


def containing(short: DataFrame, long: DataFrame, s: str, t: str) -> DataFrame:
    """Candidate (s, t): t holds the rarest letter run of s."""
    theirs = long.select(t, F.explode(_runs(F.col(f"{t}_low"), tuple(range(1, RUN + 1)))).alias("run"))
    n = F.length(f"{s}_low")
    own = short.select(s, F.explode(F.when(n < RUN, F.array(f"{s}_low")).otherwise(_runs(F.col(f"{s}_low"), (RUN,)))).alias("run"))
    rarest = _ranked(own, "run", theirs, s).filter("_rank = 1")
    return rarest.select(s, "run").join(theirs, "run").select(s, t).distinct()


def dictionary(required_items: DataFrame, found_items: DataFrame) -> DataFrame:
    """All pairs (r, f) of distinct items that match; both inputs have a column ``item``."""
    required, found = _items(required_items, "r").filter(F.size("r_toks") > 0), _items(found_items, "f")
    pairs = sharing_tokens(required, found)
    pairs = pairs.unionByName(containing(required, found, "r", "f")).unionByName(containing(found, required, "f", "r").select("r", "f"))
    rows = pairs.distinct().join(required, "r").join(found, "f")
    struct = lambda n: F.struct(F.col(n).alias("item"), F.col(f"{n}_low").alias("low"), F.col(f"{n}_toks").alias("toks"))
    return rows.filter(D.same_item(struct("r"), struct("f"))).select("r", "f")


def with_hits(cases: DataFrame, kinds: dict[str, tuple[str, str]], case: str = "request_id") -> DataFrame:
    """``cases`` with a column ``_<kind>_hits`` for each kind: its required items in order with whether one found item matches.

    ``kinds`` names the array columns of required and found items. :func:`decision.decide` takes the columns as they are.
    """
    # Four lists are read from the cases, each of them twice, and the cases once more.
    cases = saved(cases, "cases-with-items")
    required = found = None
    for kind, (need, have) in kinds.items():
        name = F.lit(kind).alias("kind")
        need_rows = cases.select(case, name, F.posexplode(need).alias("place", "item"))
        have_rows = cases.select(case, name, F.explode(F.array_distinct(X.norm_list(F.col(have)))).alias("item"))
        required = need_rows if required is None else required.unionByName(need_rows)
        found = have_rows if found is None else found.unionByName(have_rows)
    known = dictionary(required.select("item"), found.select("item"))
    met = found.withColumnRenamed("item", "f").join(known, "f").select(case, "kind", F.col("r").alias("item"), F.lit(True).alias("hit")).distinct()
    flagged = required.join(met, [case, "kind", "item"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    # As many items as one case requires.
    rows = flagged.groupBy(case).agg(*[
        F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("place", "item", "hit")))).alias(f"_{kind}_rows") for kind in kinds])
    out = cases.join(rows, case, "left")
    none = F.array().cast("array<struct<item:string,hit:boolean>>")
    return out.select(*cases.columns, *[F.coalesce(F.transform(f"_{kind}_rows", lambda x: F.struct(x["item"].alias("item"), x["hit"].alias("hit"))), none)
                                        .alias(f"_{kind}_hits") for kind in kinds])
