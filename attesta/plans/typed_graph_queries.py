"""Queries over typed graphs: the graph of an analysis (four benchmark items are a claim's limitations, passages of documents its
evidence), and paths of any length between the rows of the sales tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import evidence as ev, typed_graph as ops
from attesta.plans import sql
from attesta.plans.evidence_queries import _SCORES, CLAIM
from attesta.plans.graph_queries import _GRAPH, _graph
from attesta.plans.registry import query
from attesta.session import table
from attesta.tables import written


def _id(prefix: str, *columns: str):
    return F.concat(F.lit(prefix), F.concat_ws("-", *[F.col(c).cast("string") for c in columns]))


def _analysis(spark, sf_dir) -> ops.Graph:
    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    passages = ev.packed_passages(docs)
    found = written(ev.limitation_evidence(items, docs), "evidence")  # a few rows for each limitation
    texts = passages.select("doc_id", "passage", "text").join(F.broadcast(found.select("item_id", "doc_id", "passage", "score")), ["doc_id", "passage"])
    claim = items.select(F.expr(CLAIM).alias("number")).distinct()
    none = F.lit(None).cast("string")
    claims = ops.claims(claim.select(F.lit("P").alias("patent_id"), _id("C", "number").alias("claim_id"), "number", _id("claim ", "number").alias("text"), none.alias("type"), none.alias("category")))
    limits = items.withColumn("number", F.expr(CLAIM)).select(
        _id("C", "number").alias("claim_id"), _id("L", "item_id").alias("limitation_id"), (F.col("item_id") % 4 + 1).alias("index"), "text", none.alias("type")
    )
    evidence = texts.select(
        _id("E", "item_id", "doc_id", "passage").alias("evidence_id"), _id("D", "doc_id").alias("document_id"), _id("L", "item_id").alias("limitation_id"), "text", "score"
    )
    evidence = written(evidence, "passages")  # as few rows; passages are packed once
    best = found.withColumn("number", F.expr(CLAIM)).groupBy("number").agg(F.min_by("doc_id", F.struct(-F.col("score"), F.col("doc_id"), F.col("passage"))).alias("doc_id"), F.max("score").alias("score"))
    status = F.when(F.col("score") >= 0.6, "STRONG").otherwise("WEAK")
    novelty = best.select(_id("NOV-", "number").alias("finding_id"), F.col("number").alias("claim_number"), status.alias("status"), _id("D", "doc_id").alias("document_id"))
    numbers = claim.select(_id("C", "number").alias("node_id"), F.col("number").cast("int").alias("claim_number"))
    patent = spark.createDataFrame([("P",)], "id string")
    return ops.graph(
        ops.part(patent, F.col("id"), ops.PATENT, F.lit("Application"), ops.properties()),
        claims,
        ops.limitations(limits),
        ops.documents(docs.select(_id("D", "doc_id").alias("document_id"), F.col("source").alias("title"), "source", "text")),
        ops.evidence(evidence),
        ops.findings(novelty, ops.NOVELTY, numbers),
    )


_EVIDENCE = f"""{_SCORES},
found AS (SELECT ev.*, {CLAIM} AS number, p.text AS passage_text FROM ev JOIN passages p ON p.doc_id = ev.doc_id AND p.passage = ev.passage),
e AS (SELECT 'E' || item_id || '-' || doc_id || '-' || passage AS evidence_id, 'D' || doc_id AS document_id, 'L' || item_id AS limitation_id, 'C' || number AS claim_id, {sql.clean('passage_text')} AS evidence, score, number, doc_id, passage FROM found),
l AS (SELECT 'L' || item_id AS limitation_id, {sql.clean('text')} AS limitation FROM benchmark)"""


@query(f"WITH {_EVIDENCE} SELECT claim_id, e.limitation_id, limitation, evidence_id, evidence, score, document_id FROM e JOIN l ON l.limitation_id = e.limitation_id")
def graph_claim_evidence(spark, sf_dir):
    return ops.claim_evidence(_analysis(spark, sf_dir))


@query(f"WITH {_EVIDENCE} SELECT document_id, evidence_id, e.limitation_id, limitation, evidence, score FROM e JOIN l ON l.limitation_id = e.limitation_id")
def graph_document_disclosures(spark, sf_dir):
    return ops.document_disclosures(_analysis(spark, sf_dir))


_NOVELTY = """
f AS (SELECT CAST(number AS INTEGER) AS claim_number, 'NOV-' || number AS finding_id, CASE WHEN max(score) >= 0.6 THEN 'STRONG' ELSE 'WEAK' END AS status,
  'D' || (list(doc_id ORDER BY score DESC, doc_id, passage))[1] AS document_id, (list(doc_id ORDER BY score DESC, doc_id, passage))[1] AS doc_id FROM e GROUP BY number)"""


@query(f"WITH {_EVIDENCE}, {_NOVELTY} SELECT claim_number, 'novelty' AS kind, finding_id, status, document_id FROM f")
def graph_claim_findings(spark, sf_dir):
    return ops.claim_findings(_analysis(spark, sf_dir))


@query(f"WITH {_EVIDENCE}, {_NOVELTY} SELECT claim_number, document_id, coalesce(nullif({sql.clean('source')}, ''), 'Prior-art document') AS label FROM f JOIN documents USING (doc_id)")
def graph_prior_art_of_claims(spark, sf_dir):
    return ops.prior_art_of_claims(_analysis(spark, sf_dir))


@query(f"WITH {_EVIDENCE} SELECT evidence_id, evidence_id || ' > ' || limitation_id || ' > ' || claim_id || ' > ' || document_id AS path, 'EVIDENCE > LIMITATION > CLAIM > PRIOR_ART_DOCUMENT' AS kinds FROM e")
def graph_evidence_paths(spark, sf_dir):
    rows = ops.evidence_paths(_analysis(spark, sf_dir))
    return rows.select("evidence_id", F.array_join("path.node_id", " > ").alias("path"), F.array_join("path.node_type", " > ").alias("kinds"))


@query(f"""
WITH RECURSIVE {_GRAPH.strip()},
walks(start, node, depth, path) AS (
  SELECT node_id, node_id, 0, [node_id] FROM nodes WHERE node_type = 'CUSTOMER'
  UNION ALL
  SELECT start, target, depth + 1, min(list_append(path, target)) FROM walks JOIN edges ON node = source WHERE depth < 4 GROUP BY start, target, depth),
ends AS (SELECT start, node, min(depth) AS depth, arg_min(path, depth) AS path FROM walks GROUP BY start, node)
SELECT start, node, CAST(depth AS INTEGER) AS depth, array_to_string(path, ' > ') AS path FROM ends WHERE node LIKE 'N%'""")
def graph_shortest_paths(spark, sf_dir):
    """From each customer to all nations: its own, and those of the suppliers of what it ordered."""
    nodes, edges = _graph(spark, sf_dir)
    nations = edges.where("target LIKE 'N%'").select(F.col("target").alias("node_id"))
    found = ops.shortest_paths_to(edges, nodes.where("node_type = 'CUSTOMER'").select("node_id"), nations, 4)
    return found.select("start", "node", "depth", F.array_join("path", " > ").alias("path"))


_PARENTS = """
o AS (SELECT o_orderkey, o_custkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders),
parents AS (
  SELECT 'O' || o_orderkey AS artifact, 'C' || o_custkey AS parent FROM o UNION SELECT 'O' || o_orderkey, 'O' || before FROM o WHERE before IS NOT NULL
  UNION SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer UNION SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation)"""


@query(f"""
WITH RECURSIVE {_PARENTS.strip()},
up(artifact, ancestor, depth) AS (
  SELECT artifact, parent, 1 FROM parents UNION SELECT up.artifact, p.parent, depth + 1 FROM up JOIN parents p ON p.artifact = up.ancestor)
SELECT artifact, ancestor, CAST(min(depth) AS INTEGER) AS depth FROM up GROUP BY 1, 2""")
def lineage_closure(spark, sf_dir):
    """An order comes from its customer and from the customer's order before it, a customer from a nation, a nation from a region."""
    from pyspark.sql import Window

    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    orders = orders.withColumn("before", before)
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    pairs = [
        orders.select(_id("O", "o_orderkey").alias("artifact"), _id("C", "o_custkey").alias("parent")),
        orders.where("before IS NOT NULL").select(_id("O", "o_orderkey").alias("artifact"), _id("O", "before").alias("parent")),
        customers.select(_id("C", "c_custkey").alias("artifact"), _id("N", "c_nationkey").alias("parent")),
        nations.select(_id("N", "n_nationkey").alias("artifact"), _id("R", "n_regionkey").alias("parent")),
    ]
    return ops.ancestors(pairs[0].unionByName(pairs[1]).unionByName(pairs[2]).unionByName(pairs[3]))
