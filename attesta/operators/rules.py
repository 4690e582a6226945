"""Rules and lexicons against texts, claims against a specification, and what a revision adds."""

from __future__ import annotations

from typing import Iterable, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from attesta.functions import similarity as sim, text as tx


class Rule(NamedTuple):
    rule_id: str
    category: str
    severity: str
    keywords: list[str]


# Words that make a claim vague.
VAGUE_TERMS = ["substantially", "approximately", "about", "suitable", "appropriate", "etc.", "and the like", "similar", "optimized"]


def rule_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """Rules as a table; the caller's rules, of which there are few."""
    return spark.createDataFrame([tuple(r) for r in rules], "rule_id string, category string, severity string, keywords array<string>")


def match_rules(texts: DataFrame, rules: list[Rule], keys: list[str], text_col: str = "text") -> DataFrame:
    """The keys, rule_id, severity, matched terms and confidence of every rule with a keyword in the text, whatever the case.

    Rules are an argument, so that matching is one projection of the texts and needs no join.
    """
    low = F.col("_low")

    def found(rule: Rule) -> Column:
        terms = F.array(*[F.when(F.contains(low, F.lit(k.lower())), F.lit(k)) for k in dict.fromkeys(rule.keywords)])
        return F.struct(
            F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.severity).alias("severity"), F.filter(terms, lambda t: t.isNotNull()).alias("terms")
        )

    texts = texts.select(*keys, F.lower(tx.clean(F.col(text_col))).alias("_low"))
    rows = texts.select(*keys, F.explode(F.array(*[found(r) for r in rules])).alias("m")).where(F.size("m.terms") > 0)
    n = F.size("m.terms")
    confidence = F.round(F.least(F.lit(1.0), 0.45 + 0.10 * n), 3)
    return rows.select(*keys, "m.rule_id", "m.severity", F.array_join("m.terms", ",").alias("matched_terms"), confidence.alias("confidence"))


def clarity_issues(texts: DataFrame, keys: list[str], terms: list[str] = VAGUE_TERMS, text_col: str = "text") -> DataFrame:
    """The keys, terms (comma-joined, in the order given) and confidence of texts that hold any of the terms."""
    low = F.col("_low")
    texts = texts.select(*keys, F.lower(tx.clean(F.col(text_col))).alias("_low"))
    # concat_ws leaves nulls out; the explode of one value keeps the filter from being worked out before and after
    found = F.concat_ws(",", *[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in terms])
    rows = texts.select(*keys, F.explode(F.array(found)).alias("terms")).where("terms <> ''")
    return rows.select(*keys, "terms", F.lit(0.68).alias("confidence"))


def support(pairs: DataFrame, keys: list[str], limitation_col: str, specification_col: str, least: float = 0.35) -> DataFrame:
    """The keys, coverage (share of the limitation's words of five letters or more in the specification) and supported."""
    words = tx.letter_words(F.col(limitation_col), 5)
    coverage = sim.substring_containment(words, F.lower(F.col(specification_col)))
    rows = pairs.select(*keys, F.size(words).alias("n_terms"), F.round(coverage, 4).alias("coverage"))
    return rows.withColumn("supported", (F.col("coverage") >= least) | (F.col("n_terms") == 0))


def section_scores(claims: DataFrame, lexicons: dict[str, list[str]], keys: list[str], claim_col: str, specification_col: str) -> DataFrame:
    """The keys, section, score, status: .2 for each trigger in the claim up to .7, .05 in the specification up to .3."""
    claim, spec = tx.normalize_unicode(F.col(claim_col)), tx.normalize_unicode(F.col(specification_col))

    def hits(t: Column, terms: list[str]) -> Column:
        out = F.lit(0)
        for term in terms:
            out = out + F.contains(t, F.lit(term)).cast("int")
        return out

    base = claims.select(*keys, claim.alias("_c"), spec.alias("_s"))
    each = F.array(
        *[F.struct(F.lit(name).alias("section"), hits(F.col("_c"), terms).alias("c"), hits(F.col("_s"), terms).alias("s")) for name, terms in lexicons.items()]
    )
    rows = base.select(*keys, F.explode(each).alias("x"))
    score = F.least(F.lit(1.0), F.least(F.lit(0.7), 0.2 * F.col("x.c")) + F.least(F.lit(0.3), 0.05 * F.col("x.s")))
    rows = rows.select(*keys, "x.section", F.round(score, 4).alias("score")).where("score > 0")
    return rows.withColumn("status", sim.ladder(F.col("score"), [(0.7, "STRONG_REVIEW_SIGNAL"), (0.4, "REVIEW_SIGNAL")], "WEAK_REVIEW_SIGNAL"))


def added_terms(pairs: DataFrame, keys: list[str], old_col: str, new_col: str) -> DataFrame:
    """The keys, n_added and added: words of four letters or more that only the new text has, in order (the first 30)."""
    added = F.array_sort(F.array_except(tx.letter_words(F.col(new_col), 4), tx.letter_words(F.col(old_col), 4)))
    return pairs.select(*keys, F.size(added).alias("n_added"), F.array_join(F.slice(added, 1, 30), " ").alias("added")).where("n_added > 0")


def token_overlap(pairs: DataFrame, keys: list[str], old_col: str, new_col: str) -> DataFrame:
    """Counts of tokens of both versions, how many are new, and their ratio to the new version's."""
    rows = pairs.select(*keys, tx.revision_tokens(F.col(old_col)).alias("o"), tx.revision_tokens(F.col(new_col)).alias("n"))
    new = F.size(F.array_except("n", "o"))
    ratio = F.when(F.size("n") == 0, F.lit(0.0)).otherwise(F.round(new.cast("double") / F.size("n"), 4))
    return rows.select(*keys, F.size("o").alias("n_old"), F.size("n").alias("n_new"), new.alias("n_added"), ratio.alias("added_ratio"), (ratio > 0.20).alias("high_change"))


def changed_texts(old: DataFrame, new: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Rows of ``new`` whose normalised text no row of ``old`` has."""
    seen = old.select(tx.normalize_revision(F.col(text_col)).alias("_k")).distinct()
    rows = new.withColumn("_k", tx.normalize_revision(F.col(text_col)))
    return rows.join(seen, "_k", "left_anti").select(id_col).withColumn("status", F.lit("CHANGED_OR_NEW"))
