"""URL filters: block and allow rules by host and path, carried over to aliases.

A rule such as `example.net/en/` fits its host and all subdomains where the path starts with the rule's; of several the
longest wins, an allow rule before a block rule of equal length. Addresses that redirect to one another, or name one
another as canonical, are one page: connected components of those edges pass a block on to all addresses that no rule
fits, unless an allow rule fits an address of the component. An address's own rule always comes first.

Edges are taken from `<link rel=canonical>` and `<meta http-equiv=refresh>` of the pages, and from a table of
redirects where there is one. Host names are cut at the first `://`; an address is host, path and query, without scheme
and fragment. A null url, or one without `://`, has empty host and path, fits no rule, has no aliases and is allowed.
Repeated rows are judged alike; null html has no edges; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.llm.common import saved
from casemill.llm.components import components

BLOCK, ALLOW = "block", "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Tags that name another address of a page, and the address in them.
CANONICAL_TAG = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
CANONICAL_HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH_TAG = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
REFRESH_URL = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def _rest(url: Column) -> Column:
    """What follows the first `://`, up to a fragment; empty without it."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^#]*)", 1), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"(?s)^([^/?]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"(?s)^[^/?]*([^?]*)", 1)


def address_of(url: Column) -> Column:
    """Host, path and query: addresses that differ in scheme or fragment are one."""
    return F.concat(host_of(url), F.regexp_extract(_rest(url), r"(?s)^[^/?]*(.*)$", 1))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(rule, verdict) pairs as a table of rule, host, path, verdict."""
    cut = [(rule, rule.partition("/")[0].lower(), "".join(rule.partition("/")[1:]), verdict) for rule, verdict in rules]
    return spark.createDataFrame(cut, "rule string, host string, path string, verdict string")


def _resolved(base: Column, href: Column) -> Column:
    """An href as an url: whole, without scheme, from the root of the host, or beside the page."""
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"(?s)^(.*?:)//", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^?#]*/)", 1)
    return (F.when(F.coalesce(href, F.lit("")) == "", None)
            .when(href.contains("://"), href)
            .when(href.startswith("//"), F.concat(scheme, href))
            .when(href.startswith("/"), F.concat(origin, href))
            .otherwise(F.concat(F.when(folder == "", F.concat(origin, F.lit("/"))).otherwise(folder), href)))


def page_edges(pages: DataFrame) -> DataFrame:
    """(a, b): addresses of a page and of the canonical or refreshed one that it names."""
    html = F.col("html").cast("string")
    hrefs = F.array(F.regexp_extract(F.regexp_extract(html, CANONICAL_TAG, 0), CANONICAL_HREF, 1),
                    F.regexp_extract(F.regexp_extract(html, REFRESH_TAG, 0), REFRESH_URL, 1))
    named = pages.where(html.contains("canonical") | html.rlike("(?i)canonical|refresh")).select(
        F.col("url").cast("string").alias("url"), F.explode(hrefs).alias("href"))
    return _linked(named.select("url", _resolved(F.col("url"), F.col("href")).alias("target")))


def _linked(urls: DataFrame) -> DataFrame:
    return urls.select(address_of(F.col("url")).alias("a"), address_of(F.col("target")).alias("b")).where("a <> '' AND b <> ''").distinct()


def redirect_edges(redirects: DataFrame) -> DataFrame:
    """(a, b) of a table with url and target."""
    return _linked(redirects.select(F.col("url").cast("string").alias("url"), F.col("target").cast("string").alias("target")))


def matched_rules(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """address, rule, verdict of the winning rule; only for addresses that a rule fits. Stored.

    An address has one row for each of its host's last labels, as many as the longest rule host has, and meets rules by
    equality; the longest is a maximum per address, summed up before the shuffle.
    """
    deepest = rules.agg(F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(0))).first()[0]
    url = F.concat(F.lit("://"), F.col("address"))
    labels = F.split("_host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size("_labels"), F.lit(max(1, deepest)))),
                       lambda n: F.array_join(F.slice("_labels", -n, n), "."))
    cut = addresses.select("address", host_of(url).alias("_host"), path_of(url).alias("_path"))
    cut = cut.withColumn("_labels", labels).select("address", "_path", F.explode(ends).alias("host"))
    fits = cut.join(rules, "host").where(F.col("_path").startswith(F.col("path")))
    best = F.max(F.struct(F.length("rule").alias("n"), (F.col("verdict") == ALLOW).alias("allow"), "rule", "verdict")).alias("_best")
    return saved(fits.groupBy("address").agg(best).select("address", "_best.rule", "_best.verdict"), "matched-rules")


def judged_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, reason (rule, alias or default) for every row."""
    url = F.col("url").cast("string")
    own = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), address_of(url).alias("address"))
    edges = page_edges(pages)
    edges = saved(edges.unionByName(redirect_edges(redirects)).distinct() if redirects is not None else edges, "alias-edges")
    ends = edges.select(F.explode(F.array("a", "b")).alias("address"))
    matched = matched_rules(own.select("address").where("address <> ''").unionByName(ends).distinct(), rules)
    groups = components(edges)
    members = saved(groups.unionByName(groups.select(F.col("component").alias("node"), "component")).distinct(), "alias-groups")
    judged = members.join(matched, members["node"] == matched["address"]).groupBy("component").agg(
        F.bool_or(F.col("verdict") == BLOCK).alias("block"), F.bool_or(F.col("verdict") == ALLOW).alias("allow"))
    blocked = saved(members.join(judged.where("block AND NOT allow"), "component").select(
        F.col("node").alias("address"), F.lit(True).alias("_alias")), "blocked-aliases")
    rows = own.join(matched.select("address", "rule", "verdict"), "address", "left").join(blocked, "address", "left")
    verdict = F.coalesce("verdict", F.when(F.col("_alias"), BLOCK), F.lit(ALLOW))
    reason = F.when(F.col("verdict").isNotNull(), "rule").when(F.col("_alias"), "alias").otherwise("default")
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), reason.alias("reason"))
