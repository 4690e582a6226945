"""Similarity measures of token arrays and vectors, and the ladders that name scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body's lambdas name it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ratio(part: Column, whole: Column) -> Column:
    """part / whole as doubles; 0 where the whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole.cast("double"))


def jaccard(a: Column, b: Column) -> Column:
    """Of distinct tokens; 0 if either has none."""
    shared = F.size(F.array_intersect(a, b))
    return _ratio(shared, F.size(F.array_union(a, b)))


def dice(a: Column, b: Column) -> Column:
    """The harmonic mean of precision and recall of distinct tokens."""
    return _ratio(2 * F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)))


def containment(a: Column, b: Column) -> Column:
    """The share of a's distinct tokens that are in b."""
    return _ratio(F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)))


def bag_containment(a: Column, b: Column) -> Column:
    """The share of a's tokens, repeats counted, that are in b."""
    return bind(b, lambda tokens: _ratio(F.size(F.filter(a, lambda t: F.array_contains(tokens, t))), F.size(a)))


def substring_containment(terms: Column, text: Column) -> Column:
    """The share of terms that the text contains as substrings."""
    return bind(text, lambda whole: _ratio(F.size(F.filter(terms, lambda t: F.contains(whole, t))), F.size(terms)))


def weighted_containment(terms: Column, tokens: Column) -> Column:
    """Terms found over all terms: 1.25 for ten characters or more, else 1.2 with a hyphen, else 1; repeats counted."""

    def weigh(t: Column) -> Column:
        return F.when(F.length(t) >= 10, F.lit(1.25)).when(F.contains(t, F.lit("-")), F.lit(1.2)).otherwise(F.lit(1.0))

    total = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + weigh(t))

    def found(held: Column) -> Column:
        return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + F.when(F.array_contains(held, t), weigh(t)).otherwise(F.lit(0.0)))

    return F.when(total <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), bind(tokens, found) / total))


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths, empty ones and zero ones."""
    norms = F.sqrt(inner_product(a, a)) * F.sqrt(inner_product(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0) | (norms == 0), F.lit(0.0)).otherwise(inner_product(a, b) / norms)


def ladder(x: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """The name of the first step, from the highest, that x reaches."""
    out = F.when(x >= steps[0][0], F.lit(steps[0][1]))
    for least, name in steps[1:]:
        out = out.when(x >= least, F.lit(name))
    return out.otherwise(F.lit(otherwise))


# Thresholds and their names.
CHART_STEPS = [(0.85, "EXPLICIT"), (0.60, "PARTIAL"), (0.35, "INFERRED"), (0.15, "UNCERTAIN")]
EVIDENCE_STEPS = [(0.8, "EXPLICIT"), (0.6, "STRONG_MATCH"), (0.4, "PARTIAL"), (0.2, "WEAK_MATCH")]
LIMITATION_STEPS = [(0.8, "STRONG_EVIDENCE"), (0.6, "SUBSTANTIAL_EVIDENCE"), (0.4, "PARTIAL_EVIDENCE"), (0.2, "WEAK_EVIDENCE")]
COVERAGE_STEPS = [(0.8, "HIGH_EVIDENCE_COVERAGE"), (0.6, "MODERATE_EVIDENCE_COVERAGE"), (0.4, "PARTIAL_EVIDENCE_COVERAGE")]
DISCLOSURE_STEPS = [(0.8, "STRONG"), (0.6, "SUBSTANTIAL"), (0.4, "PARTIAL")]
RISK_STEPS = [(0.8, "HIGH"), (0.55, "MEDIUM"), (0.3, "LOW")]
SEVERITY_WEIGHTS = {"critical": 1.0, "high": 0.8, "medium": 0.55, "low": 0.3, "info": 0.1, "review": 0.45}
UNKNOWN_SEVERITY = 0.45


def chart_status(score: Column) -> Column:
    return ladder(score, CHART_STEPS, "NOT_FOUND")


def evidence_class(score: Column) -> Column:
    return ladder(score, EVIDENCE_STEPS, "UNCERTAIN")


def risk_level(score: Column) -> Column:
    return ladder(score, RISK_STEPS, "INFO")


def severity_weight(severity: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SEVERITY_WEIGHTS.items() for x in pair])
    return F.coalesce(known[F.lower(F.trim(severity))], F.lit(UNKNOWN_SEVERITY))


def retriever_class(lexical: Column, phrase: Column) -> Column:
    return (
        F.when((phrase >= 0.8) & (lexical >= 0.7), "EXPLICIT")
        .when((lexical >= 0.7) | (phrase >= 0.6), "PARTIAL")
        .when((lexical >= 0.35) | (phrase >= 0.3), "CONTEXTUAL")
        .when((lexical > 0) | (phrase > 0), "WEAK")
        .otherwise("NOT_FOUND")
    )


def support_type(combined: Column, lexical: Column) -> Column:
    return (
        F.when((combined >= 0.72) & (lexical >= 0.6), "explicit")
        .when((combined >= 0.45) & (lexical >= 0.4), "partial")
        .when(combined >= 0.25, "contextual")
        .when(lexical > 0, "weak")
        .otherwise("none")
    )


def verification_status(support: Column, contradiction: Column) -> Column:
    return (
        F.when(contradiction >= 0.5, "contradicted")
        .when(support == "explicit", "verified")
        .when(support == "partial", "partially_verified")
        .when(support.isin("contextual", "weak"), "unverified")
        .otherwise("not_found")
    )
