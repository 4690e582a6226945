"""Answers of search providers, kept as JSON files: read, taken apart as VARIANT and brought to one set of columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from attesta.functions import text as tx

# Where an answer holds its results, and the names that providers give to a field; the first that holds
# something counts.
RESULT_KEYS = ["results", "items", "data", "documents", "records"]
FIELDS = {
    "title": ["title", "document_title", "patent_title", "name"],
    "publication_number": ["publication_number", "publicationNumber", "publication", "pub_number", "document_number"],
    "patent_number": ["patent_number", "patentNumber", "patent_no"],
    "application_number": ["application_number", "applicationNumber", "application_no"],
    "url": ["url", "link", "document_url", "patent_url"],
    "abstract": ["abstract", "summary", "description"],
    "snippet": ["snippet", "text", "highlight", "matched_text"],
    "filing_date": ["filing_date", "filingDate", "date_filed"],
    "publication_date": ["publication_date", "publicationDate", "date_published"],
    "priority_date": ["priority_date", "priorityDate", "earliest_priority_date"],
}
LISTS = {
    "applicants": ["applicants", "applicant", "owners"],
    "inventors": ["inventors", "inventor"],
    "assignees": ["assignees", "assignee", "owner"],
    "classifications": ["classifications", "classification", "ipc", "cpc"],
}
SCORES = ["relevance_score", "score", "similarity"]
SEARCHED = ["title", "abstract", "claims", "description"]


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """raw: the JSON text of each line of the files of a folder; lines that hold nothing are left out."""
    return spark.read.text(path).select(F.trim("value").alias("raw")).where("raw <> ''")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """file and raw: one answer a file, whatever its lines."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("raw"))


def items(payloads: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """The keys, place (from 0) and item (VARIANT) of every result in answers told as JSON.

    An answer is a list, or an object with a list under one of ``RESULT_KEYS``, the first that is one. Only objects in it are
    results. What can't be read as JSON has none.
    """
    answer = F.try_parse_json(raw)
    lists = [F.try_variant_get(answer, path, "array<variant>") for path in ("$", *[f"$.{k}" for k in RESULT_KEYS])]
    rows = payloads.select(*keys, F.posexplode(F.coalesce(*lists)).alias("place", "item"))
    return rows.where(F.startswith(F.schema_of_variant("item"), F.lit("OBJECT")))


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def first_of(item: Column, names: list[str]) -> Column:
    """The value (VARIANT) under the first of the names that holds something: not null, '', [] or {}."""
    values = [F.try_variant_get(item, f"$.{n}", "variant") for n in names]
    return F.coalesce(*[F.when(~_text(v).isin("", "[]", "{}"), v) for v in values])


def as_list(value: Column) -> Column:
    """The cleaned, non-empty elements of a list, or the parts of a text between ``;``, ``|`` and ``,``."""
    parts = F.split(_text(value), r"[;|,]", -1)
    elements = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda v: F.coalesce(_text(v), F.lit("")))
    none = F.array().cast("array<string>")
    return F.filter(F.transform(F.coalesce(elements, parts, none), lambda x: tx.clean(x)), lambda x: x != "")


def normalized_items(rows: DataFrame, keys: list[str], item: str = "item") -> DataFrame:
    """The keys and one set of columns of ``items``: texts ('' if there is none), lists and relevance_score (0.0).

    An empty value hides no later name that holds something.
    """
    x = F.col(item)
    texts = [tx.clean(_text(first_of(x, names))).alias(c) for c, names in FIELDS.items()]
    lists = [as_list(first_of(x, names)).alias(c) for c, names in LISTS.items()]
    score = F.coalesce(F.try_variant_get(first_of(x, SCORES), "$", "double"), F.lit(0.0))
    return rows.select(*keys, *texts, *lists, score.alias("relevance_score"))


def normalized(results: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """As ``normalized_items``, of one result a row, told as JSON; '', [] and 0.0 where the JSON can't be read."""
    return normalized_items(results.select(*keys, F.try_parse_json(raw).alias("_item")), keys, "_item")


def search_local(rows: DataFrame, keys: list[str], query: str, most: int = 20, item: str = "item") -> DataFrame:
    """The keys and score of the ``most`` results that hold most of the query's words of three or more characters.

    The score is the share of distinct words that stand anywhere in the title, abstract, claims or description; ties go to the
    smaller keys. Results that hold none are left out; a query without such words gives any, with score 0.
    """
    words = sorted({w.lower() for w in query.split() if len(w) >= 3})
    text = F.lower(F.concat_ws(" ", *[tx.clean(F.try_variant_get(item, f"$.{f}", "string")) for f in SEARCHED]))
    hits = reduce(lambda n, w: n + F.contains(F.col("_text"), F.lit(w)).cast("int"), words, F.lit(0))
    found = rows.select(*keys, text.alias("_text")).select(*keys, (hits / max(1, len(words))).alias("score"))
    return (found.where("score > 0") if words else found).orderBy(F.desc("score"), *keys).limit(most)


def write_lines(lines: DataFrame, path: str, as_html: bool = False) -> None:
    """Write a report's lines (n, line), in order of n, as text files; as HTML, each line is an escaped paragraph."""
    line = F.col("line")
    if as_html:
        for character, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            line = F.replace(line, F.lit(character), F.lit(entity))
        line = F.concat(F.lit("<p>"), line, F.lit("</p>"))
    lines.repartitionByRange("n").sortWithinPartitions("n").select(line.alias("value")).write.mode("overwrite").text(path)
