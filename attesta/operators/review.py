"""Signals that a reviewer reads: cited numbers, technical problems and effects, motivation, coverage, priorities and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from attesta.functions import similarity as sim, text as tx

# Numbers of patent documents, by pattern in order.
CITATION_PATTERNS = [r"(?i)\b(?:IN|Indian)?\s*\d{5,12}\b", r"(?i)\b[A-Z]{2}\d{4,}(?:[A-Z]\d?)?\b", r"(?i)\bWO\s*\d{4}/\d{4,}\b", r"(?i)\bEP\s*\d{6,}\b"]
# Words for technical problems and effects, and for a motivation to combine.
PROBLEM_TERMS = [
    "reduce", "reduces", "reduction", "improve", "improves", "improvement", "increase", "increases", "stability", "efficiency", "accuracy", "noise",
    "power consumption", "energy consumption", "temperature", "degradation", "reliability", "latency", "error", "failure", "wear", "capacity", "performance",
]
EFFECT_TERMS = [
    "improved efficiency", "improved accuracy", "reduced power", "reduced energy", "reduced temperature", "reduced noise", "improved stability",
    "increased capacity", "reduced degradation", "improved reliability", "reduced latency", "improved signal", "reduced error", "increased performance",
]
MOTIVATION_TERMS = [
    "combine", "combining", "may be combined", "can be combined", "in combination with", "alternative embodiment", "another embodiment", "optionally",
    "compatible with", "adapted for use with", "configured to work with", "improve performance", "reduce cost", "reduce power", "improve efficiency",
]
COMBINATION_TERMS = ["may be combined", "can be combined", "in combination with"]
# Kinds of technical relationship and their words.
RELATIONSHIPS = {
    "causal": ["causes", "causing", "responsive to", "in response to", "based on", "determines", "determining"],
    "feedback": ["feedback", "closed loop", "adjusts based on", "controls based on", "iteratively"],
    "physical_interaction": ["coupled", "connected", "interacts", "electrically connected", "mechanically coupled", "thermally coupled"],
    "temporal": ["before", "after", "subsequently", "simultaneously", "during", "while"],
    "optimization": ["optimize", "optimizing", "minimize", "maximize", "improve efficiency", "reduce energy", "reduce error"],
    "technical_effect": [
        "reduces noise", "reduces power", "improves accuracy", "improves efficiency", "reduces temperature", "increases capacity", "improves stability", "improves signal",
    ],
}


def citations(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """The keys, reference and kind of every document number that a text cites, each once whatever its case.

    Null and empty texts cite nothing; repeated rows give repeated rows.
    """
    found = F.flatten(F.array(*[F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(p), F.lit(0)) for p in CITATION_PATTERNS]))
    rows = texts.select(*keys, F.explode(tx.unique_ignoring_case(found)).alias("reference"))
    upper = F.upper("reference")
    kind = F.when(F.startswith(upper, F.lit("WO")), "WO").when(F.startswith(upper, F.lit("EP")), "EP").when(F.startswith(upper, F.lit("IN")), "Indian")
    return rows.withColumn("kind", kind.otherwise("patent_document"))


def terms_in(text: Column, terms: list[str]) -> Column:
    """Those of the terms that a text holds, in the order given."""
    return F.filter(F.array(*[F.when(F.contains(text, F.lit(t)), F.lit(t)) for t in terms]), lambda t: t.isNotNull())


def technical_signals(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """The keys, problems and effects (comma-joined terms), kinds of technical relationship, and whether there is any."""
    low = texts.select(*keys, tx.normalize(F.col(text_col)).alias("_low"))
    t = F.col("_low")

    def any_of(terms: list[str]) -> Column:
        return reduce(Column.__or__, [F.contains(t, F.lit(x)) for x in terms])

    def joined(terms: list[str]) -> Column:
        return F.concat_ws(",", *[F.when(F.contains(t, F.lit(x)), F.lit(x)) for x in terms])

    kinds = F.concat_ws(",", *[F.when(any_of(words), F.lit(kind)) for kind, words in RELATIONSHIPS.items()])
    # effects are looked for only where one of their first words is
    effects = F.when(any_of(sorted({x.split(" ")[0] for x in EFFECT_TERMS})), joined(EFFECT_TERMS)).otherwise("")
    rows = low.select(*keys, joined(PROBLEM_TERMS).alias("problems"), effects.alias("effects"), kinds.alias("relationships"))
    return rows.withColumn("related", F.col("relationships") != "")


def motivation(pairs: DataFrame, keys: list[str], reference_col: str, target_col: str) -> DataFrame:
    """The keys, signals (comma-joined) and score: .15 a signal up to 1, .25 more for words of combination, 1 at most.

    Texts are normalised first. Three meaningful tokens in common count as a signal of shared vocabulary.
    """
    tokens = [tx.meaningful_tokens(F.col(c), tx.COMBINATION_STOP_WORDS) for c in (reference_col, target_col)]
    rows = pairs.select(
        *keys, terms_in(tx.normalize(F.col(reference_col)), MOTIVATION_TERMS).alias("_s"), F.size(F.array_intersect(*tokens)).alias("_n")
    )
    shared = F.when(F.col("_n") >= 3, F.array(F.lit("shared_technical_vocabulary"))).otherwise(F.array().cast("array<string>"))
    rows = rows.select(*keys, F.concat("_s", shared).alias("_s"))
    more = F.when(F.arrays_overlap("_s", F.array(*[F.lit(t) for t in COMBINATION_TERMS])), 0.25).otherwise(0.0)
    return rows.select(*keys, F.array_join("_s", ",").alias("signals"), F.round(sim.clamp(F.least(F.lit(1.0), 0.15 * F.size("_s")) + more), 4).alias("score"))


def hindsight(pairs: DataFrame) -> DataFrame:
    """Pairs of references (coverage, complementarity, overlap) with the signals that call for care, and review_required."""
    signals = F.concat_ws(
        ",",
        F.when(F.col("coverage") < 1, "combination_requires_feature_mapping"),
        F.when(F.col("complementarity") > 0.6, "references_contribute_distinct_feature_sets"),
        F.when(F.col("overlap") < 0.2, "limited_overlap_between_references"),
    )
    return pairs.withColumn("signals", signals).withColumn("review_required", F.col("signals") != "")


def rescored(evidence: DataFrame, semantic: DataFrame, on: list[str]) -> DataFrame:
    """Evidence (lexical) with the semantic score of its keys, 0 if there is none: .65 semantic and .35 lexical, and its class."""
    rows = evidence.join(semantic, on, "left").na.fill(0.0, ["semantic"])
    rows = rows.withColumn("combined", F.round(0.65 * F.col("semantic") + 0.35 * F.col("lexical"), 6))
    return rows.withColumn("status", sim.evidence_class(F.col("combined")))


def coverage_of(expected: DataFrame, supported: DataFrame, keys: list[str], item: str) -> DataFrame:
    """The keys, expected, supported, unsupported and coverage: distinct items, whatever their case, that are supported.

    Null and blank items count on neither side; keys without expected items have no row.
    """

    def items(rows: DataFrame, side: int) -> DataFrame:
        return rows.select(*keys, F.lower(tx.clean(F.col(item).cast("string"))).alias("_i"), F.lit(side).alias("_side")).where("_i <> ''")

    # both sides go to where their keys are in one shuffle, and are counted there; a null key has nothing that supports it
    told = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    both = items(expected, 1).unionByName(items(supported.where(told), 2)).repartition(*keys).groupBy(*keys, "_i").agg(F.bit_or("_side").alias("_side"))
    out = both.where("_side <> 2").groupBy(*keys).agg(F.count("*").alias("expected"), F.count_if(F.col("_side") == 3).alias("supported"))
    return out.withColumns({"unsupported": F.col("expected") - F.col("supported"), "coverage": F.round(F.col("supported") / F.col("expected"), 4)})


def prioritized(signals: DataFrame, group: str, tie: str) -> DataFrame:
    """Signals with their priority in their group: by score, then confidence, then the smaller ``tie``."""
    return signals.withColumn("priority", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), F.desc("confidence"), tie)))


def gate(issues: DataFrame, strict: bool = False) -> DataFrame:
    """One row of issues (severity ERROR, WARNING or INFO, and category): counts, whether they need a review, and whether a
    report may be made: not with an error, nor, if ``strict``, with a warning. No issues: nothing stands in the way."""
    reviewed = F.col("category").isin("evidence", "provenance", "findings", "graph")
    out = issues.agg(
        *[F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in ("ERROR", "WARNING", "INFO")],
        F.count_if((F.col("severity") == "WARNING") & reviewed).alias("_w"),
    )
    blocked = F.col("n_error") + (F.col("n_warning") if strict else F.lit(0))
    return out.select("n_error", "n_warning", "n_info", ((F.col("n_error") > 0) | (F.col("_w") > 0)).alias("review_required"), (blocked == 0).alias("report_allowed"))


def integrity(artifacts: DataFrame, keys: list[str], content: str, stored: str) -> DataFrame:
    """The keys, calculated hash and valid: whether it is the stored one; without a stored hash it isn't."""
    calculated = F.sha2(F.coalesce(F.col(content), F.lit("")).cast("binary"), 256)
    return artifacts.select(*keys, calculated.alias("calculated"), F.coalesce(calculated == F.col(stored), F.lit(False)).alias("valid"))


def degrees(edges: DataFrame) -> DataFrame:
    """node_id, edge_type, n_out and n_in of every node that an edge touches."""
    ends = edges.select(F.col("source").alias("node_id"), "edge_type", F.lit(1).alias("o")).unionByName(edges.select(F.col("target").alias("node_id"), "edge_type", F.lit(0).alias("o")))
    return ends.groupBy("node_id", "edge_type").agg(F.sum("o").alias("n_out"), (F.count("*") - F.sum("o")).alias("n_in"))


def find_nodes(nodes: DataFrame, node_type: str | None = None, label: str | None = None) -> DataFrame:
    """Nodes of a type, whose label holds a text whatever the case."""
    out = nodes if node_type is None else nodes.where(F.col("node_type") == node_type)
    return out if label is None else out.where(F.contains(F.lower("label"), F.lit(label.lower())))
