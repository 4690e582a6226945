"""Evidence for limitations in documents: passages, scores, roll-ups, charts, retrieval and verification.

A limitation is a row with item_id and text; a document one with doc_id and text. Limitations and passages meet where the
documents are (``overlaps``), so that pairs with nothing in common are never made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from attesta.functions import similarity as sim, text as tx
from attesta.operators import overlaps
from attesta.operators.search import top_k

# Patterns that speak against a limitation.
CONTRADICTION_PATTERNS = [
    r"\bnot\b",
    r"\bwithout\b",
    r"\babsence of\b",
    r"\babsent\b",
    r"\bdoes not\b",
    r"\bdo not\b",
    r"\bnever\b",
    r"\binstead of\b",
    r"\bopposite\b",
    r"\bexclusive of\b",
]
PHRASE_STEP, PHRASE_MOST, WHOLE_BONUS = 0.05, 0.2, 0.4


def sentence_passages(docs: DataFrame, least: int = 8) -> DataFrame:
    """doc_id, passage (from 0) and text: sentences of at least ``least`` characters."""
    return docs.select("doc_id", F.posexplode(tx.sentences(F.col("text"), least=least)).alias("passage", "text"))


def packed_passages(docs: DataFrame, most: int = 700) -> DataFrame:
    """doc_id, passage (from 0) and text: sentences, their ends kept, packed in order into passages of at most ``most``
    characters; a longer sentence is a passage of its own, and a text without any has none."""
    sentences = tx.sentences_with_ends(F.col("text"), ".!?")
    return docs.select("doc_id", F.posexplode(tx.packed(sentences, most)).alias("passage", "text"))


def window_passages(docs: DataFrame, size: int = 3, overlap: int = 1) -> DataFrame:
    """doc_id, passage (from 0) and text: windows of sentences, their ends kept, that overlap."""
    parts = docs.select("doc_id", tx.sentences_with_ends(F.col("text")).alias("s"))
    return parts.select("doc_id", F.posexplode(tx.sentence_windows(F.col("s"), size, overlap)).alias("passage", "text"))


def packed_documents(docs: DataFrame, most: int = 700) -> DataFrame:
    """doc_id and passages: what ``packed_passages`` gives, in order, normalised, as one array."""
    parts = tx.packed(tx.sentences_with_ends(F.col("text"), ".!?"), most)
    return docs.select("doc_id", F.transform(parts, lambda t: tx.normalize(t)).alias("passages"))


def _wanted(limitations: DataFrame, *keys: str) -> DataFrame:
    """item_id, keys, meaningful tokens and the phrases that two neighbours of them make."""
    tokens = limitations.select("item_id", *keys, tx.meaningful_tokens(F.col("text")).alias("tokens"))
    return tokens.withColumn("phrases", tx.ngrams(F.col("tokens"), 2))


def _scored(pairs: DataFrame) -> DataFrame:
    jaccard = F.col("shared").cast("double") / (F.col("n_left") + F.col("n_right") - F.col("shared"))
    rows = pairs.select("item_id", "doc_id", "passage", jaccard.alias("j"), F.least(F.lit(PHRASE_MOST), PHRASE_STEP * F.col("hits")).alias("p"))
    return rows.select(
        "item_id", "doc_id", "passage", F.round("j", 6).alias("lexical"), F.round("p", 6).alias("phrase"), F.round(F.least(F.lit(1.0), F.col("j") + F.col("p")), 6).alias("score")
    )


def passage_scores(limitations: DataFrame, passages: DataFrame) -> DataFrame:
    """item_id, doc_id, passage, lexical, phrase and score of pairs that share a meaningful token; rounded to six places.

    Lexical: Jaccard of meaningful tokens. Phrase: .05 for each pair of neighbours among the limitation's tokens that the
    normalised passage holds, .2 at most. Score: their sum, 1 at most. Null and empty texts have no tokens and no rows.
    There are about as many pairs as limitations times passages: see ``limitation_evidence`` and ``document_scores``.
    """
    one = passages.select(F.struct("doc_id", "passage").alias("doc_id"), F.array(tx.normalize(F.col("text"))).alias("passages"))
    pairs = overlaps.pairs(one.where("doc_id.doc_id IS NOT NULL"), _wanted(limitations), 3, tx.STOP_WORDS)
    return _scored(pairs.select("item_id", "doc_id.doc_id", "doc_id.passage", "shared", "n_left", "n_right", "hits"))


def limitation_evidence(limitations: DataFrame, docs: DataFrame, per_document: int = 3, per_limitation: int = 10) -> DataFrame:
    """``ranked_evidence`` of the ``passage_scores`` of packed passages; each task keeps no more rows of a limitation than the
    result has. doc_id and item_id are keys."""
    best = overlaps.best_pairs(packed_documents(docs), _wanted(limitations), 3, tx.STOP_WORDS, PHRASE_STEP, PHRASE_MOST, per_document, per_limitation)
    return ranked_evidence(_scored(best), per_document=per_document, per_limitation=per_limitation)


def document_scores(limitations: DataFrame, docs: DataFrame, claim: Column) -> DataFrame:
    """claim, doc_id and limitations (structs of item_id and score): the best ``passage_scores`` that each limitation of the
    claim has among the document's packed passages. One row for each claim and document with any; doc_id and item_id are keys."""
    items = _wanted(limitations.withColumn("group", claim), "group")
    best = overlaps.best_of_documents(packed_documents(docs), items, 3, tx.STOP_WORDS, PHRASE_STEP, PHRASE_MOST)
    scores = F.transform(F.arrays_zip("items", "scores"), lambda x: F.struct(x["items"].alias("item_id"), F.round(x["scores"], 6).alias("score")))
    return best.select(F.col("group").alias("claim"), "doc_id", scores.alias("limitations"))


def ranked_evidence(scores: DataFrame, score: str = "score", per_document: int = 3, per_limitation: int = 10) -> DataFrame:
    """The best passages of each document for a limitation, then the best of those: with status and rank."""
    order = [F.desc(score), F.asc("doc_id"), F.asc("passage")]
    within = top_k(scores, ["item_id", "doc_id"], [F.desc(score), F.asc("passage")], per_document, "doc_rank")
    best = top_k(within, ["item_id"], order, per_limitation).drop("doc_rank")
    return best.withColumn("status", sim.evidence_class(F.col(score)))


def limitation_rollup(evidence: DataFrame, score: str = "score") -> DataFrame:
    """item_id, best, n_evidence, status and coverage: 1 from a best score of .6, else the best score."""
    rows = evidence.groupBy("item_id").agg(F.max(score).alias("best"), F.count("*").alias("n_evidence"))
    return rows.withColumns(
        {
            "status": sim.ladder(F.col("best"), sim.LIMITATION_STEPS, "NO_STRONG_EVIDENCE"),
            "coverage": F.when(F.col("best") >= 0.6, F.lit(1.0)).otherwise(F.col("best")),
        }
    )


def claim_rollup(limitations: DataFrame, claim: Column) -> DataFrame:
    """Of ``limitation_rollup``: coverage of each claim, the mean of its limitations', and its status."""
    rows = limitations.groupBy(claim.alias("claim")).agg(
        F.round(F.avg("coverage"), 6).alias("coverage"), F.count("*").alias("n_limitations"), F.sum("n_evidence").alias("n_evidence")
    )
    return rows.withColumn("status", sim.ladder(F.col("coverage"), sim.COVERAGE_STEPS, "LOW_EVIDENCE_COVERAGE"))


# claim charts -------------------------------------------------------------------------------------------------------


def chart(limitations: DataFrame, documents: DataFrame) -> DataFrame:
    """item_id, doc_id, score and status of limitations and documents with anything found: the best passage's score.

    ``documents`` has passages' rows doc_id, passage, text. Scores: Jaccard of tokens, plus .4 if the passage holds the whole
    normalised limitation, 1 at most; rounded to four places. Pairs that aren't here are NOT_FOUND: there are as many as
    limitations times documents, so that they are counted (see ``chart_statistics``) and not laid out. An empty limitation
    is held by nothing.
    """

    whole = tx.normalize_unicode(F.col("text"))
    items = limitations.select("item_id", whole.alias("whole"), F.filter(tx.words_in(whole), lambda w: F.length(w) >= 2).alias("tokens"))
    found = overlaps.similar_or_held(documents.select("doc_id", F.array(whole).alias("passages")), items, 2, sim.CHART_STEPS[-1][0] - 1e-4, WHOLE_BONUS)
    best = found.groupBy("item_id", "doc_id").agg(F.round(F.max("score"), 4).alias("score"))
    return best.withColumn("status", sim.chart_status(F.col("score"))).where("status <> 'NOT_FOUND'")


def chart_statistics(rows: DataFrame, by: list[str], totals: DataFrame) -> DataFrame:
    """Counts by status and coverage, (EXPLICIT + PARTIAL) / all, and weighted coverage, (EXPLICIT + PARTIAL / 2) / all.

    ``totals`` has the keys ``by`` and n_rows, the limitations times documents of each; what isn't found is counted from it.
    """

    def n(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    found = ["n_explicit", "n_partial", "n_inferred", "n_uncertain"]
    counts = rows.groupBy(*by).agg(*[n(c[2:].upper()).alias(c) for c in found])
    out = totals.join(counts, by, "left").na.fill(0, found)
    out = out.withColumn("n_not_found", F.col("n_rows") - sum((F.col(c) for c in found), F.lit(0)))
    return out.withColumns(
        {
            "coverage_ratio": F.round((F.col("n_explicit") + F.col("n_partial")) / F.col("n_rows"), 4),
            "weighted_coverage": F.round((F.col("n_explicit") + 0.5 * F.col("n_partial")) / F.col("n_rows"), 4),
        }
    )


def rank_documents(rows: DataFrame, sizes: DataFrame, claim: str = "claim") -> DataFrame:
    """claim, doc_id, counts by status, coverage (EXPLICIT + PARTIAL / 2 over the claim's limitations) and rank of documents
    that have anything of a claim; ties go to the smaller doc_id. ``rows`` is a chart with claim, ``sizes`` claim and n_limitations."""
    counts = rows.groupBy(claim, "doc_id").agg(*[F.count_if(F.col("status") == s).alias("n_" + s.lower()) for s in ("EXPLICIT", "PARTIAL", "INFERRED", "UNCERTAIN")])
    coverage = F.round((F.col("n_explicit") + 0.5 * F.col("n_partial")) / F.col("n_limitations"), 4)
    ranked = counts.join(sizes, claim).withColumn("coverage", coverage)
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy(claim).orderBy(F.desc("coverage"), "doc_id"))).drop("n_limitations")


# retrieval ----------------------------------------------------------------------------------------------------------


def retriever_scores(limitations: DataFrame, passages: DataFrame, provenance: float = 0.3, least: float = 0.15) -> DataFrame:
    """item_id, doc_id, passage, lexical, phrase, context, combined and status of pairs that reach ``least``: .4 lexical,
    .3 phrase, .2 context, .1 provenance.

    Phrase: the longest run of 4, 3 or 2 words of the limitation, over ten characters, in the passage; its words over five.
    Limitations go to where the passages are, so that only pairs that reach ``least`` are rows; every row counts for itself.
    """
    strict = tx.normalize_strict(F.col("text"))
    items = limitations.select("item_id", tx.technical_terms(F.col("text")).alias("tokens"), tx.words_in(strict).alias("words"))
    texts = passages.select(F.struct("doc_id", "passage").alias("doc_id"), F.array(strict).alias("passages"))
    rows = overlaps.retrieved(texts, items, 0.4, 0.3, 0.2, least - 0.1 * provenance)
    rows = rows.select(
        "item_id",
        "doc_id.*",
        F.when(F.col("n_left") > 0, F.col("shared").cast("double") / F.col("n_left")).otherwise(0.0).alias("lexical"),
        (F.col("run") / F.lit(5.0)).alias("phrase"),
        # weights are twentieths
        F.when(F.col("total") > 0, (F.col("weight") / F.lit(20.0)) / (F.col("total") / F.lit(20.0))).otherwise(0.0).alias("context"),
    )
    total = 0.4 * F.col("lexical") + 0.3 * F.col("phrase") + 0.2 * F.col("context") + 0.1 * provenance
    rows = rows.withColumn("combined", F.round(total, 6)).where(F.col("combined") >= least)
    rows = rows.withColumn("status", sim.retriever_class(F.col("lexical"), F.col("phrase")))
    return rows.withColumns({c: F.round(c, 6) for c in ("lexical", "phrase", "context")})


def filter_evidence(evidence: DataFrame, minimum: float = 0.0, statuses: list[str] | None = None, doc_id=None, item_id=None) -> DataFrame:
    out = evidence.where(F.col("combined") >= minimum)
    if statuses:
        out = out.where(F.col("status").isin(*statuses))
    if doc_id is not None:
        out = out.where(F.col("doc_id") == doc_id)
    return out if item_id is None else out.where(F.col("item_id") == item_id)


def best_evidence(evidence: DataFrame, k: int = 3) -> DataFrame:
    """The k best passages of each limitation, with rank; ties go to the smaller document and passage."""
    return top_k(evidence, ["item_id"], [F.desc("combined"), F.asc_nulls_last("doc_id"), F.asc("passage")], max(1, k))


def limitation_coverage(limitations: DataFrame, evidence: DataFrame) -> DataFrame:
    """item_id and coverage of every limitation that has an id: its best combined score, 0 without evidence."""
    best = evidence.groupBy("item_id").agg(F.max("combined").alias("coverage"))
    return limitations.where("item_id IS NOT NULL").select("item_id").distinct().join(best, "item_id", "left").na.fill(0.0, ["coverage"])


def retriever_statistics(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("status").agg(
        F.count("*").alias("n"),
        F.countDistinct("doc_id").alias("n_documents"),
        F.countDistinct("item_id").alias("n_limitations"),
        F.round(F.avg("combined"), 6).alias("average"),
        F.max("combined").alias("best"),
    )


# verification -------------------------------------------------------------------------------------------------------


def verify(pairs: DataFrame, keys: list[str], limitation_col: str, passage_col: str, provenance: Column) -> DataFrame:
    """The keys, lexical, phrase, context, contradiction, combined, support and status of each pair of texts."""
    l, p = tx.normalize(F.col(limitation_col)), tx.normalize(F.col(passage_col))
    lt = tx.without(tx.verifier_tokens(F.col(limitation_col)), tx.STOP_WORDS)
    pt = tx.verifier_tokens(F.col(passage_col))
    long_tokens = F.filter(F.array_distinct(tx.verifier_tokens(F.col(limitation_col))), lambda t: F.length(t) >= 5)
    hits = F.lit(0)
    for pattern in CONTRADICTION_PATTERNS:
        hits = hits + p.rlike(pattern).cast("int")
    rows = pairs.select(*keys, l.alias("_l"), lt.alias("_lt"), pt.alias("_pt"), long_tokens.alias("_long"), hits.alias("_hits"), provenance.alias("_prov"))
    rows = rows.select(
        *keys,
        sim.bag_containment(F.col("_lt"), F.col("_pt")).alias("lexical"),
        sim.containment(tx.ngrams(F.col("_lt"), 2), tx.ngrams(F.col("_pt"), 2)).alias("phrase"),
        sim.containment(F.col("_long"), F.col("_pt")).alias("context"),
        F.least(F.lit(1.0), 0.25 * F.col("_hits")).alias("contradiction"),
        "_prov",
    )
    total = 0.5 * F.col("lexical") + 0.2 * F.col("phrase") + 0.15 * F.col("context") + 0.15 * F.col("_prov")
    rows = rows.withColumn("combined", sim.clamp(total * (1.0 - 0.5 * F.col("contradiction"))))
    rows = rows.withColumn("support", sim.support_type(F.col("combined"), F.col("lexical")))
    rows = rows.withColumn("status", sim.verification_status(F.col("support"), F.col("contradiction")))
    return rows.drop("_prov").withColumns({c: F.round(c, 6) for c in ("lexical", "phrase", "context", "combined")})


def verification_rollup(results: DataFrame, by: str, limitations: DataFrame | None = None) -> DataFrame:
    """The strongest status of each limitation, its best score, and counts; contradicted only if nothing supports it.

    Limitations (a frame with ``by``) without evidence are not_found, with coverage 0.
    """

    def n(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    counts = ["coverage", "n_verified", "n_partial", "n_contradicted", "n_evidence"]
    rows = results.groupBy(by).agg(
        F.max("combined").alias("coverage"),
        n("verified").alias("n_verified"),
        n("partially_verified").alias("n_partial"),
        n("contradicted").alias("n_contradicted"),
        F.count("*").alias("n_evidence"),
    )
    status = (
        F.when(F.col("n_verified") > 0, "verified")
        .when(F.col("n_partial") > 0, "partially_verified")
        .when(F.col("n_contradicted") > 0, "contradicted")
        .when(F.col("n_evidence") == 0, "not_found")
        .otherwise("unverified")
    )
    if limitations is not None:
        rows = limitations.select(by).distinct().join(rows, by, "left").na.fill(0, counts)
    return rows.withColumn("status", status)
