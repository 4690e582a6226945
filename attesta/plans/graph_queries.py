"""Queries over graphs, checks and ledgers: customers, orders, parts, suppliers and nations are typed nodes; keys that refer
to each other are edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import graph as ops, manifests
from attesta.plans import sql
from attesta.plans.registry import query
from attesta.session import table


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _graph(spark, sf_dir):
    t = {n: table(spark, sf_dir, n) for n in ("nation", "customer", "orders", "lineitem", "part", "supplier")}

    def node(name, prefix, key, label):
        return t[name].select(_id(prefix, key).alias("node_id"), F.lit(name.upper()).alias("node_type"), F.col(label).cast("string").alias("label"))

    nodes = ops.nodes(
        node("nation", "N", "n_nationkey", "n_name"), node("customer", "C", "c_custkey", "c_name"), node("orders", "O", "o_orderkey", "o_orderstatus"),
        node("part", "P", "p_partkey", "p_name"), node("supplier", "S", "s_suppkey", "s_name"),
    )

    def edge(name, a, x, b, y, kind):
        return t[name].select(_id(a, x).alias("source"), _id(b, y).alias("target"), F.lit(kind).alias("edge_type"))

    edges = ops.edges(
        edge("customer", "C", "c_custkey", "N", "c_nationkey", "LIVES_IN"), edge("supplier", "S", "s_suppkey", "N", "s_nationkey", "BASED_IN"),
        edge("orders", "C", "o_custkey", "O", "o_orderkey", "PLACED"), edge("lineitem", "O", "l_orderkey", "P", "l_partkey", "CONTAINS"),
        edge("lineitem", "P", "l_partkey", "S", "l_suppkey", "SUPPLIED_BY"),
    )
    return nodes, edges


_EDGE_ID = sql.stable_id_of("EDGE", "source", "target", "edge_type")
_GRAPH = f"""
nodes AS (
  SELECT 'N' || n_nationkey AS node_id, 'NATION' AS node_type, n_name AS label FROM nation UNION SELECT 'C' || c_custkey, 'CUSTOMER', c_name FROM customer
  UNION SELECT 'O' || o_orderkey, 'ORDERS', o_orderstatus FROM orders UNION SELECT 'P' || p_partkey, 'PART', p_name FROM part UNION SELECT 'S' || s_suppkey, 'SUPPLIER', s_name FROM supplier),
e0 AS (
  SELECT 'C' || c_custkey AS source, 'N' || c_nationkey AS target, 'LIVES_IN' AS edge_type FROM customer UNION SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'BASED_IN' FROM supplier
  UNION SELECT 'C' || o_custkey, 'O' || o_orderkey, 'PLACED' FROM orders UNION SELECT 'O' || l_orderkey, 'P' || l_partkey, 'CONTAINS' FROM lineitem UNION SELECT 'P' || l_partkey, 'S' || l_suppkey, 'SUPPLIED_BY' FROM lineitem),
edges AS (SELECT *, {_EDGE_ID} AS edge_id FROM e0)"""


@query(f"WITH {_GRAPH} SELECT edge_id, source, target, edge_type FROM edges")
def graph_nodes_edges(spark, sf_dir):
    return _graph(spark, sf_dir)[1].select("edge_id", "source", "target", "edge_type")


@query(f"WITH {_GRAPH} SELECT 'node' AS part, node_type AS kind, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', edge_type, count(*) FROM edges GROUP BY 2")
def graph_type_stats(spark, sf_dir):
    return ops.type_statistics(*_graph(spark, sf_dir))


@query(f"""
WITH {_GRAPH} SELECT a.source AS start, count(*) AS n_paths, count(DISTINCT b.target) AS n_ends FROM edges a JOIN edges b ON a.target = b.source WHERE a.edge_type = 'PLACED' AND b.edge_type = 'CONTAINS' GROUP BY 1""")
def graph_two_hop_evidence(spark, sf_dir):
    hops = ops.two_hops(_graph(spark, sf_dir)[1], "PLACED", "CONTAINS")
    return hops.groupBy("start").agg(F.count("*").alias("n_paths"), F.countDistinct("end").alias("n_ends"))


@query(f"""
WITH {_GRAPH}, k AS (SELECT node_id FROM nodes WHERE node_type <> 'PART')
SELECT edge_id, 'source' AS "end", source AS missing FROM edges WHERE source NOT IN (SELECT node_id FROM k)
UNION ALL SELECT edge_id, 'target', target FROM edges WHERE target NOT IN (SELECT node_id FROM k)""")
def graph_dangling(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    kept, _ = ops.remove_nodes(nodes, edges, nodes.where("node_type = 'PART'").select("node_id"))
    return ops.dangling(edges, kept)


@query("""
SELECT 'DUPLICATE_LINE' AS code, l_orderkey || '/' || l_linenumber AS value, count(*) AS n FROM lineitem GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'DUPLICATE_TEXT', sha256(text), count(*) FROM documents GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'DUPLICATE_NAME', p_name, count(*) FROM part GROUP BY 2 HAVING count(*) > 1""")
def validation_duplicates(spark, sf_dir):
    lines = ops.duplicates(table(spark, sf_dir, "lineitem"), F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")), "DUPLICATE_LINE")
    texts = ops.duplicates(table(spark, sf_dir, "documents"), F.sha2(F.col("text").cast("binary"), 256), "DUPLICATE_TEXT")
    return lines.unionByName(texts).unionByName(ops.duplicates(table(spark, sf_dir, "part"), F.col("p_name"), "DUPLICATE_NAME"))


@query("""
SELECT 'MISSING_ORDER' AS code, CAST(l_orderkey AS VARCHAR) AS value, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY 2
UNION ALL SELECT 'CUSTOMER_WITHOUT_ORDER', CAST(c_custkey AS VARCHAR), count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) GROUP BY 2
UNION ALL SELECT 'MISSING_DOCUMENT', CAST(doc_id AS VARCHAR), count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) GROUP BY 2""")
def validation_refs(spark, sf_dir):
    t = {n: table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "labels", "documents")}
    a = ops.missing_references(t["lineitem"], F.col("l_orderkey"), t["orders"], F.col("o_orderkey"), "MISSING_ORDER")
    b = ops.missing_references(t["customer"], F.col("c_custkey"), t["orders"], F.col("o_custkey"), "CUSTOMER_WITHOUT_ORDER")
    c = ops.missing_references(t["labels"], F.col("doc_id"), t["documents"], F.col("doc_id"), "MISSING_DOCUMENT")
    return a.unionByName(b).unionByName(c)


@query("""
SELECT l_orderkey, l_linenumber, f.field, f.value FROM (SELECT l_orderkey, l_linenumber, unnest([{'field': 'l_discount', 'value': CAST(l_discount * 12 AS DOUBLE)}, {'field': 'l_tax', 'value': CAST(l_tax AS DOUBLE)}]) AS f FROM lineitem)
WHERE f.value IS NULL OR f.value < 0 OR f.value > 1""")
def validation_ranges(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 12).alias("l_discount"), "l_tax")
    return ops.out_of_range(rows, ["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"])


@query(f"""
WITH e AS (SELECT event_type, ts, {sql.stable_id_of('EVT', 'event_type', 'user_id', 'props', digits=20)} AS entry_id FROM events)
SELECT entry_id, min(ts) AS first, count(*) AS n, arg_min(event_type, ts) AS event_type FROM e GROUP BY 1""")
def ledger_events_dedupe(spark, sf_dir):
    return ops.ledger_entries(table(spark, sf_dir, "events"), "event_type", "user_id", "props", "ts")


@query("""
WITH a AS (SELECT 'O' || o_orderkey AS id, ['C' || o_custkey, 'O' || (o_orderkey - 1)] AS parents FROM orders), p AS (SELECT id AS artifact, unnest(parents) AS parent FROM a)
SELECT artifact, parent, parent IN (SELECT id FROM a) AS known FROM p""")
def lineage_one_hop(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        _id("O", "o_orderkey").alias("id"), F.array(_id("C", "o_custkey"), F.concat(F.lit("O"), (F.col("o_orderkey") - 1).cast("string"))).alias("parents")
    )
    return ops.lineage(rows, "id", "parents")


@query()
def provenance_manifest(spark, sf_dir):
    return ops.manifest_hash(table(spark, sf_dir, "documents"), ["doc_id", "text", "source", "lang"])


_FIELDS = ["doc_id", "text", "source", "lang"]


def _framed_sql(columns: list[str]) -> str:
    return " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns)


def _digests_sql(name: str, rows: str) -> str:
    return f"""
{name}_each AS (SELECT CAST(CAST('0x' || substr(sha256({_framed_sql(['doc_id'])}), 1, 3) AS INTEGER) % 4096 AS INTEGER) AS chunk, doc_id, sha256({_framed_sql(_FIELDS)}) AS digest FROM {rows}),
{name} AS (SELECT chunk, doc_id, digest, count(*) AS n FROM {name}_each GROUP BY 1, 2, 3)"""


@query(f"""
WITH {_digests_sql('d', 'documents')},
l0 AS (SELECT chunk, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(p, '' ORDER BY p)) AS digest FROM (SELECT chunk, n, {_framed_sql(['doc_id', 'digest', 'n'])} AS p FROM d) GROUP BY chunk),
l1 AS (SELECT chunk // 16 AS chunk, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(p, '' ORDER BY p)) AS digest FROM (SELECT chunk, n, lpad(CAST(chunk AS VARCHAR), 10, '0') || ':' || digest AS p FROM l0) GROUP BY 1),
l2 AS (SELECT chunk // 16 AS chunk, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(p, '' ORDER BY p)) AS digest FROM (SELECT chunk, n, lpad(CAST(chunk AS VARCHAR), 10, '0') || ':' || digest AS p FROM l1) GROUP BY 1),
l3 AS (SELECT chunk // 16 AS chunk, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(p, '' ORDER BY p)) AS digest FROM (SELECT chunk, n, lpad(CAST(chunk AS VARCHAR), 10, '0') || ':' || digest AS p FROM l2) GROUP BY 1)
SELECT 0 AS level, * FROM l0 UNION ALL SELECT 1, * FROM l1 UNION ALL SELECT 2, * FROM l2 UNION ALL SELECT 3, * FROM l3""")
def manifest_chunks(spark, sf_dir):
    return manifests.manifest(table(spark, sf_dir, "documents"), ["doc_id"], _FIELDS)


#: Documents as they were, and as they are: some missing, new, altered, and some with each other's texts.
_OLD, _NOW = "doc_id % 97 <> 5", "doc_id % 89 <> 7"
_ALTERED = "CASE WHEN doc_id % 101 = 3 THEN text || ' ' WHEN doc_id % 103 < 2 THEN 'swapped' || (doc_id % 103) ELSE text END"


@query(f"""
WITH o AS (SELECT doc_id, {_framed_sql(_FIELDS)} AS x FROM documents WHERE {_OLD}),
n AS (SELECT doc_id, {_framed_sql(_FIELDS)} AS x FROM (SELECT doc_id, {_ALTERED} AS text, source, lang FROM documents WHERE {_NOW}))
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN n.x IS NULL THEN 'missing' WHEN o.x IS NULL THEN 'new' ELSE 'altered' END AS change
FROM o FULL JOIN n ON o.doc_id = n.doc_id WHERE o.x IS DISTINCT FROM n.x""")
def manifest_changed_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(*_FIELDS)
    now = docs.where(_NOW).withColumn("text", F.expr(_ALTERED))
    return manifests.changed_rows(manifests.row_digests(docs.where(_OLD), ["doc_id"], _FIELDS), manifests.row_digests(now, ["doc_id"], _FIELDS), ["doc_id"])
