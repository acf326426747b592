"""Pages to lines and cited chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.functions import text as X
from casemill.operators.common import text_tasks

# ---- fixed values ----------------------------------------------------------
MAX_CHARS = 900
SNIPPET = 200
FACT_KEYWORDS = {
    "course_code": ("course", "catalog", "code"),
    "title": ("title",),
    "credits_or_units": ("credit", "credits", "hours", "units"),
    "description": ("description", "objective", "about this course", "overview"),
    "prerequisites": ("prerequisite", "prerequisites", "expected background", "enrollment policy"),
}
# ----------------------------------------------------------------------------


def page_lines(pages: DataFrame, keep_blank: bool = True) -> DataFrame:
    """One row per line (…, line_no from 1, line stripped, next_line stripped or null) of each page.

    The next line travels with its row, so looking one line ahead needs no shuffle.
    """
    lines = F.transform(X.split_lines(F.coalesce("text", F.lit(""))), X.strip)
    if not keep_blank:
        lines = F.filter(lines, lambda x: x != "")
    rest = [c for c in pages.columns if c != "text"]
    cut = pages.select(*rest, lines.alias("_lines"))
    pairs = F.transform("_lines", lambda x, i: F.struct(x.alias("line"), F.get("_lines", i + 1).alias("next_line")))
    return cut.select(*rest, F.posexplode(pairs).alias("_i", "_p")).select(
        *rest, (F.col("_i") + 1).alias("line_no"), "_p.line", "_p.next_line")


def _windows(text: Column, size: int) -> Column:
    starts = F.sequence(F.lit(0), F.length(text) - 1, F.lit(size))
    return F.transform(starts, lambda i: F.struct(
        i.alias("span_start"), F.least(i + size, F.length(text)).alias("span_end"),
        F.substring(text, i + 1, F.lit(size)).alias("full_text")))


def _packed(paras: Column, size: int) -> Column:
    """Paragraphs packed in order while they fit; spans are offsets in the packed text.

    A paragraph too long for any pack stands alone, and no empty pack comes before it.
    """
    chunk = "struct<span_start:int,span_end:int,full_text:string>"
    state = F.struct(F.array().cast(f"array<{chunk}>").alias("done"), F.lit("").alias("buf"),
                     F.lit(0).alias("begin"), F.lit(0).alias("at"))

    def closed(begin: Column, buf: Column) -> Column:
        return F.array(F.struct(begin.alias("span_start"), (begin + F.length(buf)).alias("span_end"), buf.alias("full_text")).cast(chunk))

    def step(s: Column, p: Column) -> Column:
        empty = s["buf"] == ""
        begin = F.when(empty, s["at"]).otherwise(s["begin"])
        fits = F.length(s["buf"]) + F.length(p) + 2 <= size
        done = F.when(fits | empty, s["done"]).otherwise(F.concat(s["done"], closed(begin, s["buf"])))
        buf = F.when(fits & ~empty, F.concat(s["buf"], F.lit("\n\n"), p)).otherwise(p)
        return F.struct(done.alias("done"), buf.alias("buf"), F.when(fits, begin).otherwise(s["at"]).alias("begin"),
                        (s["at"] + F.length(p) + 2).alias("at"))

    return F.aggregate(paras, state, step, lambda s: F.when(
        s["buf"] == "", s["done"]).otherwise(F.concat(s["done"], closed(s["begin"], s["buf"]))))


def chunk_pages(pages: DataFrame, size: int = MAX_CHARS) -> DataFrame:
    """Chunks of every page: packed paragraphs, or fixed windows where there are no paragraphs."""
    paras = F.filter(F.transform(F.split("text", r"\n(?U:\s)*\n"), X.strip), lambda p: p != "")
    rest = [c for c in pages.columns if c != "text"]
    cut = pages.filter(F.coalesce("text", F.lit("")) != "").withColumn("_paras", paras)
    chunks = F.when(F.size("_paras") > 1, _packed(F.col("_paras"), size)).otherwise(_windows(F.col("text"), size))
    return cut.select(*rest, F.explode(chunks).alias("_c")).select(
        *rest, "_c.span_start", "_c.span_end", F.substring("_c.full_text", 1, SNIPPET).alias("snippet_text"), "_c.full_text")


def chunk_id(run: str = "extraction_run_id") -> Column:
    """sha256 over document, run, page, span and text."""
    return F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in (
        "doc_id", run, "page_num", "span_start", "span_end", "full_text")]), 256)


def with_placeholders(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks plus one stand-in chunk for each document without text, so that its facts can be cited."""
    empty = documents.join(chunks.select("doc_id").distinct(), "doc_id", "left_anti")
    text = F.concat(F.lit("[No extractable text from "), "filename", F.lit("]"))
    added = {"page_num": F.lit(0), "span_start": F.lit(0), "span_end": F.lit(0), "snippet_text": text, "full_text": text}
    rows = empty.withColumns(added)
    return chunks.unionByName(rows.select(*[c for c in chunks.columns]))


def cite_facts(facts: DataFrame, pages: DataFrame, chunks: DataFrame, scanned_pages: int | None = None) -> DataFrame:
    """Chunks for each fact (doc_id, fact_key, fact_value): from pages that mention it, else page 1.

    All pages are looked at, or the first ``scanned_pages``; the domain's own limit is 3.
    """
    keys = F.create_map(*[x for k, ws in FACT_KEYWORDS.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in ws]))])
    wanted = F.coalesce(F.try_element_at(keys, F.col("fact_key")), F.array().cast("array<string>"))
    short = (F.length("fact_value") <= 40) & (X.strip(F.col("fact_value")) != "")
    value = F.when(short, F.array(F.lower(X.squeeze(F.col("fact_value"))))).otherwise(F.array().cast("array<string>"))
    early = (pages if scanned_pages is None else pages.filter(F.col("page_num") <= scanned_pages)).select(
        "doc_id", "page_num", F.lower(X.squeeze(F.coalesce("text", F.lit("")))).alias("_hay"))
    asked = facts.withColumn("_keys", F.concat(wanted, F.coalesce(value, F.array().cast("array<string>"))))
    # Facts, pages and chunks all grow with the documents: each join deals both sides out, by the size of the texts.
    tasks = text_tasks(pages)
    hit = asked.join(early.repartition(tasks, "doc_id").hint("merge"), "doc_id").filter(F.exists("_keys", lambda k: F.col("_hay").contains(k)))
    hit = hit.select("doc_id", "fact_key", "page_num")
    first = asked.select("doc_id", "fact_key").join(hit.select("doc_id", "fact_key").distinct().hint("merge"), ["doc_id", "fact_key"], "left_anti")
    cited = hit.unionByName(first.withColumn("page_num", F.lit(1)))
    return cited.join(chunks.repartition(tasks, "doc_id", "page_num").hint("merge"), ["doc_id", "page_num"])


def document_manifest(documents: DataFrame, pages: DataFrame, chunks: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per document: pages, chunks, evidence rows and a warning when nothing could be read."""
    count = lambda df, name: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    out = documents
    for df, name in ((pages, "page_count"), (chunks, "chunks_written"), (evidence, "evidence_written")):
        out = out.join(count(df, name), "doc_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out.withColumn("warning", F.when(F.col("chunks_written") == 0, F.concat(
        F.lit("No chunks extracted for "), "filename")))
