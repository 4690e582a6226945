"""Examination reports and their objections, provisions, and text reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from attesta.functions import similarity as sim, text as tx
from attesta.operators.ordering import numbered
from attesta.tables import written

# Dates in figures, day first, and month first.
_MONTHS = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
DATE_PATTERNS = [r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", rf"(?i)\b\d{{1,2}}\s+{_MONTHS}\s+\d{{4}}\b", rf"(?i)\b{_MONTHS}\s+\d{{1,2}},?\s+\d{{4}}\b"]
#: The characters that they can begin with.
DATE_BEGINS = ["[0-9]", "[0-9]", "[ADFJMNOSadfjmnos]"]
# Words that make a date near them a deadline.
DEADLINE_WORDS = ["deadline", "within", "respond", "response", "reply", "time limit", "period", "days", "months", "due", "on or before"]
#: Characters before and after a date that are read with it.
AROUND = 250
# What to do about an objection, by its category, and about any other.
ACTIONS = {
    "novelty": "Review each cited document against every identified claim limitation and verify the specific disclosure relied upon.",
    "inventive_step": "Review the cited references, technical differences, combination rationale, and supporting evidence before preparing a response.",
    "section_3": "Identify the exact Section 3 provision cited and verify the factual and statutory basis of the objection.",
    "clarity": "Review the identified claim language for ambiguity, antecedent basis, terminology, relationships, and consistency with the specification.",
    "support": "Map the affected claim limitations to explicit supporting passages in the complete specification.",
    "sufficiency": "Review whether the specification provides sufficient technical disclosure for the claimed subject matter.",
    "unity": "Review the identified inventions and their technical relationships to determine the appropriate prosecution response.",
    "amendment": "Compare proposed or requested amendments with the original disclosure and create an amendment support map.",
}
OTHER_ACTION = "Review the objection and identify the specific documentary evidence required for response."
HIGH_PRIORITY = ["novelty", "inventive_step", "section_3"]


def claim_numbers(text: Column) -> Column:
    """The distinct numbers after "claim(s)": lists, and ranges of up to 100 with a dash or "to", spread out."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"\bclaims?\s+((?:\d+\s*(?:-|–|to|,|and|&)?\s*)+)"), F.lit(1))

    def spread(r: Column) -> Column:
        a = F.regexp_extract(r, r"^(\d+)", 1).cast("int")
        b = F.regexp_extract(r, r"(\d+)$", 1).cast("int")
        return F.when((b >= a) & (b - a <= 100), F.sequence(a, F.greatest(a, b))).otherwise(F.array(a, b))

    def numbers(found: Column) -> Column:
        ranges = F.flatten(F.transform(found, lambda r: F.regexp_extract_all(r, F.lit(r"\d+\s*(?:-|–|to)\s*\d+"), F.lit(0))))
        single = F.transform(F.flatten(F.transform(found, lambda r: F.regexp_extract_all(r, F.lit(r"\d+"), F.lit(0)))), lambda n: n.cast("int"))
        return F.concat(single, F.flatten(F.transform(ranges, spread)))

    return F.array_sort(F.array_distinct(F.filter(sim.bind(runs, numbers), lambda n: n > 0)))


def statutory_sections(text: Column) -> Column:
    """Distinct references such as "Section 3(k)", upper-cased after the word."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"\bsection\s+(\d+[a-z]?(?:\s*\([0-9a-z]+\))*)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda s: F.concat(F.lit("Section "), F.upper(F.regexp_replace(s, r"\s+", "")))))


def objections(blocks: DataFrame, lexicon: dict[str, list[str]], keys: list[str], least: int = 30) -> DataFrame:
    """The keys, category and n_terms of blocks that a category's lexicon is found in; the first category in order counts."""
    low = F.lower(tx.clean(F.col("text")))

    def hits(terms: list[str]) -> Column:
        out = F.lit(0)
        for t in terms:
            out = out + F.contains(low, F.lit(t)).cast("int")
        return out

    each = F.array(*[F.struct(F.lit(i).alias("priority"), F.lit(c).alias("category"), hits(t).alias("n_terms")) for i, (c, t) in enumerate(lexicon.items())])
    found = F.filter(each, lambda x: x["n_terms"] > 0)
    rows = blocks.where(F.length("text") >= least).select(*keys, found.alias("f")).where(F.size("f") > 0)
    first = F.get("f", F.lit(0))
    return rows.select(*keys, first["category"].alias("category"), first["n_terms"].alias("n_terms"), F.size("f").alias("n_categories"))


def deadlines(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """The keys, date_text and context of every date with a deadline's word within ``AROUND`` characters.

    The keys name a text: a date and context that recur there, whatever their case, are one row, the first. Null and empty
    texts have none. Dates stand where the parts between them end, so that near dates keep their contexts. Texts that come
    dealt out by the keys are not shuffled again.
    """

    def found(k: int, begin: str, p: str) -> Column:
        text = F.coalesce(F.col(text_col), F.lit(""))
        # a look at one character passes by quickly where no date begins
        pattern = F.lit(f"(?={begin}){p}")

        def contexts(dates: Column) -> Column:
            def steps(parts: Column) -> Column:
                return F.transform(dates, lambda d, i: F.length(F.get(parts, i)) + F.coalesce(F.length(F.get(dates, i - 1)), F.lit(0)))

            def added(acc: Column, n: Column) -> Column:
                return F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + n))

            def around(at: Column, i: Column) -> Column:
                start, date = F.greatest(at - AROUND, F.lit(0)), F.get(dates, i)
                return F.struct(F.lit(k).alias("k"), i.alias("i"), date.alias("d"), F.substring(text, start + 1, at + F.length(date) + AROUND - start).alias("c"))

            starts = F.aggregate(sim.bind(F.split(text, pattern, -1), steps), F.array().cast("array<int>"), added)
            return F.when(F.size(dates) > 0, F.transform(starts, around)).otherwise(F.array().cast("array<struct<k:int,i:int,d:string,c:string>>"))

        return sim.bind(F.regexp_extract_all(text, pattern, F.lit(0)), contexts)

    each = texts.select(*keys, F.explode(F.concat(*[found(k, b, p) for k, (b, p) in enumerate(zip(DATE_BEGINS, DATE_PATTERNS))])).alias("f"))
    rows = each.select(*keys, F.struct("f.k", "f.i").alias("_at"), tx.clean(F.col("f.d")).alias("date_text"), tx.clean(F.col("f.c")).alias("context"))
    rows = rows.withColumn("_c", F.lower("context"))
    rows = rows.where(reduce(lambda x, y: x | y, [F.contains("_c", F.lit(w)) for w in DEADLINE_WORDS]))
    first = rows.groupBy(*keys, F.lower("date_text").alias("_d"), "_c").agg(F.min(F.struct("_at", "date_text", "context")).alias("f"))
    return first.select(*keys, "f.date_text", "f.context")


def response_actions(objections: DataFrame, category: str = "category") -> DataFrame:
    """Objections with the action that answers their category, and its priority. A null category is like an unknown one."""
    known = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    action = F.coalesce(F.try_element_at(known, F.coalesce(category, F.lit(""))), F.lit(OTHER_ACTION))
    priority = F.when(F.col(category).isin(HIGH_PRIORITY), "high").otherwise("review")
    return objections.withColumns({"action": action, "priority": priority})


def provision_search(queries: DataFrame, provisions: DataFrame, keys: list[str], query_col: str = "query") -> DataFrame:
    """The keys, provision_id and score: 5 if the provision's text holds the whole query, 1 for each of its tokens.

    ``provisions`` (provision_id, text) is a small table of fixed size; pairs without a token in common don't score.
    """
    low = F.lower(tx.clean(F.col("_p")))
    q = F.lower(tx.clean(F.col(query_col)))
    tokens = F.array_distinct(F.filter(F.split(q, r"[^a-z0-9]+"), lambda t: F.length(t) > 2))
    score = F.when((q != "") & F.contains(low, q), 5).otherwise(0) + F.size(F.filter(tokens, lambda t: F.contains(low, t)))
    rows = queries.crossJoin(provisions.select("provision_id", F.col("text").alias("_p")))
    return rows.select(*keys, "provision_id", score.alias("score")).where("score > 0")


def markdown_lines(rows: DataFrame, order: list[str], title: str) -> DataFrame:
    """n and line of a Markdown table of rows; the title and header come first (-3 to -1), rows from 0. Lines are rows, so that
    a report of any size is written by ``write_lines`` without passing through the driver or one task."""
    columns = rows.columns
    head = rows.sparkSession.createDataFrame(
        [(-3, f"# {title}"), (-2, "| " + " | ".join(columns) + " |"), (-1, "|" + "---|" * len(columns))], "n long, line string"
    )
    cell = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[|\n]", " ") for c in columns]
    body = rows.select(F.struct(*[F.col(c) for c in order]).alias("_o"), F.concat(F.lit("| "), F.concat_ws(" | ", *cell), F.lit(" |")).alias("line"))
    return head.unionByName(numbered(body, ["_o"]).select((F.col("n") - 1).alias("n"), "line"))


def report(title: str, sections: list[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """n (from 1) and line of a whole report in Markdown: its title, then each section's (title, rows, order) heading and table.

    A section without rows says so. Lines of a section follow its rows' order; cells hold no line breaks or bars.
    """
    spark = sections[0][1].sparkSession
    parts, fixed, at = [], [(1, f"# {title}")], 2
    for name, rows, order in sections:
        table = written(markdown_lines(rows, order, name).where("n > -3"), "report-section")
        n = table.count() - 2
        fixed += [(at, ""), (at + 1, f"## {name}"), (at + 2, "")]
        at += 3
        if n:
            parts.append(table.select((F.col("n") + (2 + at)).alias("n"), "line"))
            at += n + 2
        else:
            fixed.append((at, "_No rows._"))
            at += 1
    out = spark.createDataFrame(fixed, "n long, line string")
    for part in parts:
        out = out.unionByName(part)
    return out
