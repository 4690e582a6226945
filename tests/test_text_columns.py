"""Columns over odd texts: what they give by their plain definitions, and that a text is not gone over more often than needed."""

import pytest
from pyspark.sql import functions as F

from attesta.functions import text as tx
from attesta.operators import claims, reports, review, search

ODD = [
    None, "", " ", "\t", "a", " a  b ", "a\tb", "a \tb", "a\n\nb", "\x0bA\x0c B\r", "a b", "a b c", "É Ö x", "x y", "ΑΣ ΑΣ\tΣ", "İı K", "don't--stop / a.b -c",
    "claim 1", "Claims\t2,\n3 and claim  4-5", "claim ;,", "claim", "claims 7", "reclaim 3", "claim 1", "CLAIM  \t 12", "claim,3",
    "The Method; wherein a  pump configured to\tpump; and comprising a RING; or  the part", "unwherein comprisingx wherein", "configured  to report the thing", ";;; ;",
    "machine\nlearning of Lithium-Ion cells, anomaly detection", "ab-cdefgh 12abcdef abcde- a1b2c3d4 abc_defghi", "improved  efficiency, reduced\nnoise; in response to wear", "Claims 1-3, 5 to 7 and 9 lack", "claims 5 - 2, claim 400–20", "😀 a😀b",
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, text string").repartition(1).cache()


def plain_clean(t):
    return F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), r"\s+", " "))


def plain_normal(t, kept):
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(plain_clean(t)), f"[^{kept}]", " "), r"\s+", " "))


def plain_tokens(t, pattern):
    return F.regexp_extract_all(F.lower(plain_clean(t)), F.lit(pattern), F.lit(0))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


SAME = {
    "clean": lambda t: (tx.clean(t), plain_clean(t)),
    "normalize": lambda t: (tx.normalize(t), plain_normal(t, r"a-z0-9\s\-/\.")),
    "strict": lambda t: (tx.normalize_strict(t), plain_normal(t, r"a-z0-9\s\-")),
    "unicode": lambda t: (tx.normalize_unicode(t), plain_normal(t, r"\p{L}\p{N}_\s\-.%/")),
    "prior_art": lambda t: (tx.prior_art_tokens(t), tx.without(plain_tokens(t, r"[a-zA-Z][a-zA-Z0-9\-]{2,}"), tx.PRIOR_ART_STOP_WORDS)),
    "long_prior_art": lambda t: (tx.prior_art_tokens(t, 6), F.filter(tx.without(plain_tokens(t, r"[a-zA-Z][a-zA-Z0-9\-]{2,}"), tx.PRIOR_ART_STOP_WORDS), lambda w: F.length(w) >= 6)),
    "keywords": lambda t: (tx.claim_keywords(t), F.slice(F.array_distinct(tx.without(plain_tokens(t, "[A-Za-z][A-Za-z0-9_-]{2,}"), tx.CLAIM_STOP_WORDS + tx.CLAIM_GENERIC_WORDS)), 1, 12)),
    "dependent": lambda t: (claims.is_dependent(t), F.size(claims.dependencies(plain_clean(t))) > 0),
    "dependencies": lambda t: (claims.dependencies(t), claims.dependencies(plain_clean(t))),
    "parts": lambda t: (F.split(t, "(?i)" + claims.LIMITATION_SPLIT, -1), F.split(t, r"(?i);\s*|\bwherein\b|\bconfigured to\b|\bcomprising\b", -1)),
}


@pytest.mark.parametrize("name", SAME)
def test_columns_are_their_plain_definitions(odd, name):
    found, expected = SAME[name](F.col("text"))
    assert [r for r in odd.select("i", found.alias("a"), expected.alias("b")).collect() if r.a != r.b] == []


def test_a_text_is_normalised_in_one_pass_over_written_out_classes(odd):
    found = plan(odd.select(tx.normalize("text").alias("c")))
    assert found.count("regexp_replace") == 1 and "a-z" not in found


def test_words_are_found_without_cleaning_the_text(odd):
    assert "regexp_replace" not in plan(odd.select(tx.claim_keywords("text"), tx.prior_art_tokens("text")))


def test_claims_are_counted_without_listing_what_they_depend_on(odd):
    assert "regexp_extract_all" not in plan(claims.analyze(odd, "i"))


def test_limitations_are_lowered_once(odd):
    assert plan(claims.limitations(odd, ["i"])).count("lower(_part") <= 2  # for kinds, and for words


def test_phrases_are_looked_for_together_first(odd):
    assert "machine learning|deep learning|neural network|lithium ion" in plan(odd.select(search.concepts(F.col("text"))))
    found = {r.i: r.c for r in odd.select("i", search.concepts(F.col("text")).alias("c")).collect()}
    at = next(i for i, t in enumerate(ODD) if t and t.startswith("machine\n"))
    assert found[at] == ["machine learning", "lithium-ion", "anomaly detection", "machine", "learning", "lithium-ion", "anomaly", "detection"][:3] + ["machine", "learning", "anomaly", "detection"]


def test_signals_make_no_arrays(odd):
    df = review.technical_signals(odd, ["i"])
    assert "lambdafunction" not in plan(df)
    for r in df.join(odd, "i").collect():
        low = (r.text or "").lower().replace("  ", " ").replace("\n", " ")
        assert r.problems == ",".join(t for t in review.PROBLEM_TERMS if t in low) and r.effects == ("improved efficiency,reduced noise" if "efficiency" in low else "")
        assert r.related == (r.relationships != "") and (r.relationships == "causal") == ("in response to" in low)


def test_numbers_of_claims_are_found_once(odd):
    df = odd.select("i", reports.claim_numbers(F.col("text")).alias("n"))
    assert plan(df).count("claims?") == 1
    found = {ODD[r.i]: r.n for r in df.collect()}
    assert found["Claims 1-3, 5 to 7 and 9 lack"] == [1, 2, 3, 5, 6, 7, 9] and found["claims 5 - 2, claim 400–20"] == [2, 5, 20, 400]
