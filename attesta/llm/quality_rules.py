"""Quality rules as a short-circuit cascade. DataFrame functions only.

Every rule is measured on a bounded sample: its cost (seconds to evaluate it there) and its selectivity (the share that it
rejects of what earlier rules leave). Rules then run in order of rejection per cost, and a document is done with at the first rule that
rejects it. The order changes what is evaluated, never the verdict: a document is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, functions as F

from attesta.llm.common import SPACE, forget, saved, words

#: Documents in the sample that costs and selectivities are taken from: about as many, twice as many at most.
SAMPLE_ROWS = 800
#: Runs of each rule over the sample; the shortest counts.
RUNS = 3
WINDOW = 3


@dataclass(frozen=True)
class QualityRule:
    """``rejects`` makes a Boolean column from the columns ``text``, ``words`` and those of ``with_statistics``."""

    name: str
    rejects: Callable[[], Column]


def _count_of(characters: str) -> Column:
    """How many characters of the text are in a character class."""
    return F.length(F.regexp_replace("text", f"[^{characters}]+", "")).cast("long")


BASE_RULES = (
    QualityRule("few_words", lambda: F.col("n_words") < 50),
    QualityRule("repeated_words", lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
)
MORE_RULES = (
    QualityRule("word_length", lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))),
    QualityRule("symbols", lambda: 4 * F.col("n_symbols") > F.col("n_words")),
    QualityRule("repeated_lines", lambda: (F.col("n_dup_lines") > 2) & (10 * F.col("n_dup_lines") > 3 * F.col("n_lines"))),
    QualityRule("capitals", lambda: 2 * _count_of(r"\p{Lu}") > F.col("word_chars")),
    QualityRule("exclamations", lambda: 4 * _count_of("!") > F.col("n_words")),
    QualityRule("wordless", lambda: 10 * F.size(F.filter("words", lambda w: w.rlike(r"\p{L}"))) < 6 * F.col("n_words")),
)
RULES = BASE_RULES + MORE_RULES


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body or its lambdas name it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(text_words: Column) -> Column:
    """Words in windows of three that stand twice or more in the text, the first included.

    Each window becomes one long: a hash in the high bits, and its place in as many low bits as the number of words needs.
    Sorted, equal windows are neighbours; that they are equal is then told by their words. Where neighbours share the bits of
    the hash but not the words, the text's windows are sorted by their words instead.
    """

    def over(w: Column) -> Column:
        count = F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))
        low = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.size(w).cast("long")))) - 1
        return _bind(low, lambda mask: ordered_over(w, count, mask))

    def ordered_over(w: Column, count: Column, low: Column) -> Column:
        windows = F.transform(
            F.arrays_zip(*[F.slice(w, k + 1, count).alias(f"w{k}") for k in range(WINDOW)]),
            lambda z, i: F.xxhash64(*[z[f"w{k}"] for k in range(WINDOW)]).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")),
        )
        return _bind(F.sort_array(windows), lambda codes: covered(w, low, codes))

    def covered(w: Column, low: Column, codes: Column) -> Column:
        last = F.greatest(F.size(codes) - 1, F.lit(0))

        def place(code: Column) -> Column:
            return code.bitwiseAND(low).cast("int")

        def equal(pair: Column) -> Column:
            alike = pair["a"].bitwiseOR(low) == pair["b"].bitwiseOR(low)
            for k in range(WINDOW):
                alike = alike & (F.get(w, place(pair["a"]) + k) == F.get(w, place(pair["b"]) + k))
            return alike

        def clash(pair: Column) -> Column:
            return (pair["a"].bitwiseOR(low) == pair["b"].bitwiseOR(low)) & ~equal(pair)

        neighbours = F.arrays_zip(F.slice(codes, 1, last).alias("a"), F.slice(codes, 2, last).alias("b"))
        found = F.flatten(F.transform(F.filter(neighbours, equal), lambda p: F.array(place(p["a"]), place(p["b"]))))
        # windows that share what is left of a hash could stand between equal ones: then the words themselves are sorted
        return _bind(F.sort_array(F.when(F.exists(neighbours, clash), by_words(w)).otherwise(found)), length)

    def by_words(w: Column) -> Column:
        count = F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))
        each = F.arrays_zip(*[F.slice(w, k + 1, count).alias(f"w{k}") for k in range(WINDOW)])
        rows = F.transform(each, lambda z, i: F.struct(F.struct(*[z[f"w{k}"] for k in range(WINDOW)]).alias("w"), i.alias("i")))

        def alike(ordered: Column) -> Column:
            pairs = F.arrays_zip(F.slice(ordered, 1, F.greatest(count - 1, F.lit(0))).alias("a"), F.slice(ordered, 2, F.greatest(count - 1, F.lit(0))).alias("b"))
            return F.flatten(F.transform(F.filter(pairs, lambda p: p["a"]["w"] == p["b"]["w"]), lambda p: F.array(p["a"]["i"], p["b"]["i"])))

        return _bind(F.sort_array(rows), alike)

    def length(places: Column) -> Column:
        return F.aggregate(
            places,
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda acc, p: F.struct((p + WINDOW).alias("end"), (acc["n"] + p + WINDOW - F.greatest(acc["end"], p)).alias("n")),
        )["n"]

    return _bind(text_words, over).cast("long")


def with_statistics(docs: DataFrame) -> DataFrame:
    """Columns ``text`` (null: empty) and ``words``, and the statistics that rules read, added to ``docs``.

    n_words, word_chars (code points in words), n_symbols, n_lines (with a word), n_dup_lines (equal to an earlier line) and
    n_repeat_words (see ``repeat_words``).
    """
    lines = F.filter(F.split("text", "\n", -1), lambda l: F.length(F.btrim(l, F.lit(" \t\x0b\x0c\r"))) > 0)
    return (
        docs.withColumn("text", F.coalesce("text", F.lit("")))
        .withColumns({"words": words(F.col("text")), "_lines": lines})
        .withColumns(
            {
                "n_words": F.size("words").cast("long"),
                "word_chars": F.length(F.regexp_replace("text", SPACE + "+", "")).cast("long"),
                "n_symbols": _count_of("#*$%&|<>"),
                "n_lines": F.size("_lines").cast("long"),
                "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
                "n_repeat_words": repeat_words(F.col("words")),
            }
        )
        .drop("_lines")
    )


@dataclass(frozen=True)
class Measured:
    rule: QualityRule
    cost: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / self.cost


def measure(docs: DataFrame, rules: tuple[QualityRule, ...] = RULES, rows: int = SAMPLE_ROWS) -> list[Measured]:
    """Cost and selectivity of each rule on a sample of about ``rows`` documents, in the order to run them.

    The sample is drawn by a hash of all columns that ``docs`` has of doc_id and text, and has at most twice ``rows``. A
    rule's cost is the shortest of ``RUNS`` runs over the sample, less that of a run without a rule. The order is greedy: the
    best rejection per cost comes first, and the next is chosen by what it rejects of the documents that are left. With no
    sample, rules stay as they are.
    """
    total = docs.count()
    if not total:
        return [Measured(r, 1.0, 0.0) for r in rules]
    drawn_by = [c for c in ("doc_id", "text") if c in docs.columns]
    draw = F.pmod(F.xxhash64(*drawn_by, F.lit("rules")), F.lit(1 << 30)) / float(1 << 30)
    sample = saved(docs.where(draw < rows / total).select("text").limit(2 * rows), "rules-sample")
    stats = with_statistics(sample)

    def shortest(value: Column) -> float:
        asked = stats.agg(F.count_if(value))
        asked.collect()  # the first run compiles
        took = []
        for _ in range(RUNS):
            began = time.perf_counter()
            asked.collect()
            took.append(time.perf_counter() - began)
        return min(took)

    empty = shortest(F.length("text") < 0)
    cost = {r.name: max(shortest(r.rejects()) - empty, 1e-4) for r in rules}
    # a Boolean for each rule and document of the sample
    left = stats.select(*[F.coalesce(r.rejects(), F.lit(False)).alias(r.name) for r in rules]).toPandas()
    forget(sample)
    found, waiting = [], list(rules)
    while waiting:
        rejected = {r.name: float(left[r.name].mean()) if len(left) else 0.0 for r in waiting}
        best = min(waiting, key=lambda r: (-rejected[r.name] / cost[r.name], cost[r.name], r.name))
        found.append(Measured(best, cost[best.name], rejected[best.name]))
        left = left[~left[best.name].astype(bool)]
        waiting.remove(best)
    return found


def cascade(stats: DataFrame, rules: tuple[QualityRule, ...]) -> Column:
    """The name of the first rule, in the order given, that rejects a row of ``with_statistics``; null if none does."""
    return F.coalesce(*[F.when(r.rejects(), F.lit(r.name)) for r in rules])


def apply_rules(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), rules: tuple[QualityRule, ...] = RULES) -> DataFrame:
    """The columns ``keep``, the statistics, and ``rejected_by``: a rule that rejects the document, or null if it is kept.

    Columns that aren't in ``keep`` are left out, so theirs may have any name. A null or empty text has no words, so that
    few_words rejects it. Repeated rows each give their row; an empty table gives none.
    """
    ordered = tuple(m.rule for m in measure(docs.select(*dict.fromkeys([c for c in keep if c == "doc_id"] + ["text"])), rules))
    stats = with_statistics(docs.select(*keep, "text"))
    return stats.withColumn("rejected_by", cascade(stats, ordered)).drop("text", "words")


def op8_quality_rules(spark, sf_dir) -> DataFrame:
    """The statistics, base_failed and kept of every document; see ``apply_rules`` for nulls and empty texts."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        F.col("rejected_by").isNull().alias("kept"),
    )


OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
win AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win),
cov AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep WHERE c > 1) GROUP BY rid),
s AS (
  SELECT w.doc_id, text, ws, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 4 * n_symbols > n_words
            OR (n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines)
            OR 2 * length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) > word_chars
            OR 4 * length(regexp_replace(text, '[^!]+', '', 'g')) > n_words
            OR 10 * len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) < 6 * n_words) AS kept
FROM s
"""
