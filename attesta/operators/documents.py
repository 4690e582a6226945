"""Documents to lines, paragraphs, sections, claim blocks, chunks and statistics. Every function is lazy and shuffle-aware:
what needs an order within a document is a window over the document's id."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from attesta.functions import text as tx

# Headings and the sections that they open.
SECTION_HEADINGS = {
    "abstract": "abstract",
    "field of the invention": "field",
    "background": "background",
    "background of the invention": "background",
    "summary": "summary",
    "summary of the invention": "summary",
    "brief description": "brief_description",
    "brief description of drawings": "drawings",
    "detailed description": "detailed_description",
    "description": "description",
    "claims": "claims",
    "claim": "claims",
    "drawings": "drawings",
}
CLAIM_LINE = r"(?i)^\s*(?:claim\s*)?(\d{1,4})\s*[.):\-]\s*(.+)$"


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, line (from 1) and text of every line."""
    return docs.select(id_col, F.posexplode(F.split(text_col, "\n", -1)).alias("line", "text")).withColumn("line", F.col("line") + 1)


def heading_of(line: Column, headings: dict[str, str] | None = None) -> Column:
    """The section a line opens: an exact heading, with or without a number before it; else null."""
    known = F.create_map(*[F.lit(x) for pair in (headings or SECTION_HEADINGS).items() for x in pair])
    key = F.lower(tx.clean(line))
    return F.coalesce(F.try_element_at(known, key), F.try_element_at(known, F.regexp_replace(key, r"^\d+[.)]?\s*", "")))


def headings(docs: DataFrame, lexicon: dict[str, str] | None = None) -> DataFrame:
    found = lines(docs).withColumn("section", heading_of(F.col("text"), lexicon))
    return found.where(F.col("section").isNotNull())


def paragraphs(docs: DataFrame, split: str = r"\n\s*\n", gap: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, paragraph (from 1), text, start and end: offsets run on, with ``gap`` characters between paragraphs."""
    parts = F.filter(F.transform(F.split(text_col, split, -1), lambda p: tx.clean(p)), lambda p: p != "")
    rows = docs.select(id_col, F.posexplode(parts).alias("paragraph", "text")).withColumn("paragraph", F.col("paragraph") + 1)
    before = Window.partitionBy(id_col).orderBy("paragraph").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + gap).over(before), F.lit(0))
    return rows.withColumn("start", start).withColumn("end", F.col("start") + F.length("text"))


def carry_sections(rows: DataFrame, id_col: str = "doc_id", order_col: str = "line") -> DataFrame:
    """Each row's ``section``, or the last one before it in its document; '' before the first."""
    so_far = Window.partitionBy(id_col).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.coalesce(F.last("section", ignorenulls=True).over(so_far), F.lit("")))


def blocks(rows: DataFrame, opens: Column, id_col: str, order_col: str, text_col: str = "text") -> DataFrame:
    """Rows gathered in blocks, each opened by a row where ``opens`` holds; rows before the first are block 0.

    id, block, first (the order of its first row), n_rows and text, its rows' texts in order, joined by spaces.
    """
    so_far = Window.partitionBy(id_col).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("block", F.sum(opens.cast("int")).over(so_far))
    inside = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), tx.clean(F.col(text_col)).alias("t"))))
    return numbered.groupBy(id_col, "block").agg(
        F.min(order_col).alias("first"),
        F.count("*").alias("n_rows"),
        F.array_join(F.transform(inside, lambda x: x["t"]), " ").alias("text"),
    )


def claim_blocks(docs: DataFrame) -> DataFrame:
    """Numbered lines open claims; other lines carry on the claim before them; a section heading ends it."""
    rows = lines(docs).withColumn("number", F.regexp_extract("text", CLAIM_LINE, 1)).withColumn("section", heading_of(F.col("text")))
    rows = rows.withColumn("opens", (F.col("number") != "") | F.col("section").isNotNull())
    found = blocks(rows, F.col("opens"), "doc_id", "line")
    first = rows.where("opens").select("doc_id", F.col("line").alias("first"), "number")
    return found.join(first, ["doc_id", "first"]).where(F.col("number") != "").select("doc_id", F.col("number").cast("int"), "text", "n_rows")


def chunks(docs: DataFrame, size: int = 6000, overlap: int = 500, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, chunk (from 1 in each document), start, end and text of overlapping pieces of the cleaned text."""
    cleaned = docs.select(id_col, tx.clean_manual(F.col(text_col)).alias("_t"))
    rows = cleaned.select(id_col, "_t", F.posexplode(tx.chunks(F.col("_t"), size, overlap)).alias("chunk", "at"))
    start, end = F.col("at.start"), F.col("at.end")
    return rows.select(id_col, (F.col("chunk") + 1).alias("chunk"), start.alias("start"), end.alias("end"), F.substring("_t", start + 1, end - start).alias("text"))


def chunked(docs: DataFrame, of: Callable[[Column], Column], size: int = 6000, overlap: int = 500, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and passages: what ``of`` makes of the texts of ``chunks``, in order, as one array."""
    cleaned = docs.select(id_col, tx.clean_manual(F.col(text_col)).alias("_t"))
    rows = cleaned.select(id_col, "_t", tx.chunks(F.col("_t"), size, overlap).alias("_at"))
    return rows.select(id_col, F.transform("_at", lambda at: of(F.substring("_t", at["start"] + 1, at["end"] - at["start"]))).alias("passages"))


def windows(docs: DataFrame, size: int = 3, overlap: int = 1, ends: str = ".!?", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, window (from 1) and text of windows of sentences."""
    parts = docs.select(id_col, tx.sentences(F.col(text_col), ends).alias("_s"))
    return parts.select(id_col, F.posexplode(tx.sentence_windows(F.col("_s"), size, overlap)).alias("window", "text")).withColumn(
        "window", F.col("window") + 1
    )


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document; nothing is shuffled."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(tx.clean(t), " "), lambda w: w != "")
    return docs.select(
        id_col,
        F.size(F.filter(F.split(t, "\n", -1), lambda l: tx.clean(l) != "")).cast("long").alias("n_paragraphs"),
        F.size(tx.sentences(t)).cast("long").alias("n_sentences"),
        F.size(words).cast("long").alias("n_words"),
        F.length(t).cast("long").alias("n_characters"),
        F.sha2(t.cast("binary"), 256).alias("sha256"),
    )


def strip_tags(html: Column) -> Column:
    """The text of a page: without scripts, styles, comments and tags, with the common entities."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for entity, character in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(character))
    return tx.clean(t)
