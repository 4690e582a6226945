"""A property graph of an analysis: claims, limitations, documents, evidence, findings and amendments as typed nodes, and what
connects them as typed edges; then what is asked of it, for all claims, documents or evidence at once.

Nodes have node_id, node_type, label and properties (a map of strings); edges have source, target and edge_type. A hop is a
join. Searches of any depth go frontier by frontier, all starts together, and carry what led to each node.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from attesta.functions import text as tx
from attesta.operators.ordering import numbered
from attesta.tables import dropped, written

# Types of nodes and edges.
PATENT, CLAIM, LIMITATION, DOCUMENT, EVIDENCE = "PATENT", "CLAIM", "LIMITATION", "PRIOR_ART_DOCUMENT", "EVIDENCE"
NOVELTY, INVENTIVE_STEP, SECTION, OBJECTION, AMENDMENT = "NOVELTY_FINDING", "INVENTIVE_STEP_FINDING", "SECTION3_FINDING", "FER_OBJECTION", "AMENDMENT"
HAS_CLAIM, HAS_LIMITATION, EVIDENCE_FOR, SUPPORTED_BY = "HAS_CLAIM", "HAS_LIMITATION", "EVIDENCE_FOR", "SUPPORTED_BY"
HAS_FINDING, APPLIES_TO, REFERENCES, STARTING_REFERENCE, AMENDS = "HAS_FINDING", "APPLIES_TO", "REFERENCES", "STARTING_REFERENCE", "AMENDS"
#: What findings of each type are called, how they touch their claim and their document, and where they name the document.
FINDINGS = {
    NOVELTY: ("novelty", HAS_FINDING, REFERENCES, "best_document_id"),
    INVENTIVE_STEP: ("inventive_step", HAS_FINDING, STARTING_REFERENCE, "starting_reference_id"),
    SECTION: ("section3", APPLIES_TO, None, None),
    OBJECTION: ("fer", APPLIES_TO, None, None),
    AMENDMENT: ("amendments", AMENDS, None, None),
}


class Graph(NamedTuple):
    nodes: DataFrame
    edges: DataFrame


def properties(**values: Column) -> Column:
    """A map of cleaned strings; what is null is empty."""
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), tx.clean(v.cast("string")))])


def part(rows: DataFrame, node_id: Column, kind: str, label: Column, values: Column, *links: tuple[Column, Column, str]) -> Graph:
    """Nodes of one type, and edges (source, target, edge_type) that each row has; an edge without one of its ends is none."""
    nodes = rows.select(node_id.alias("node_id"), F.lit(kind).alias("node_type"), label.alias("label"), values.alias("properties"))
    edges = [rows.select(a.alias("source"), b.alias("target"), F.lit(k).alias("edge_type")) for a, b, k in links]
    empty = nodes.limit(0).select(F.col("node_id").alias("source"), F.col("node_id").alias("target"), F.col("node_type").alias("edge_type"))
    return Graph(nodes.where("node_id IS NOT NULL"), reduce(DataFrame.unionByName, edges, empty).where("source IS NOT NULL AND target IS NOT NULL"))


def claims(rows: DataFrame) -> Graph:
    """Of patent_id, claim_id (null: made from the rest), number, text, type and category."""
    number = F.coalesce(F.col("number").cast("int"), F.lit(1))
    text = tx.clean("text")
    made = tx.stable_id("CLAIM", F.concat_ws("|", F.coalesce("patent_id", F.lit("")), number.cast("string"), text))
    claim_id = F.coalesce(F.nullif(tx.clean("claim_id"), F.lit("")), made)
    values = properties(claim_number=number, text=text, claim_type=F.col("type"), category=F.col("category"))
    return part(rows, claim_id, CLAIM, F.concat(F.lit("Claim "), number.cast("string")), values, (F.col("patent_id"), claim_id, HAS_CLAIM))


def limitations(rows: DataFrame) -> Graph:
    """Of claim_id, limitation_id (null: made from the rest), index, text and type."""
    index = F.col("index").cast("string")
    made = tx.stable_id("LIM", F.concat_ws("|", F.coalesce("claim_id", F.lit("")), index, tx.clean("text")))
    limitation_id = F.coalesce(F.nullif(tx.clean("limitation_id"), F.lit("")), made)
    values = properties(text=F.col("text"), index=index, type=F.col("type"))
    return part(rows, limitation_id, LIMITATION, F.concat(F.lit("Limitation "), index), values, (F.col("claim_id"), limitation_id, HAS_LIMITATION))


def documents(rows: DataFrame) -> Graph:
    """Of document_id, title (null: a general one), source and text."""
    title = F.coalesce(F.nullif(tx.clean("title"), F.lit("")), F.lit("Prior-art document"))
    return part(rows, F.col("document_id"), DOCUMENT, title, properties(source=F.col("source"), text=F.col("text")))


def evidence(rows: DataFrame) -> Graph:
    """Of evidence_id (null: made from the rest), document_id, limitation_id, text and score."""
    ids = [tx.clean(c) for c in ("document_id", "limitation_id")]
    made = tx.stable_id("EVID", F.concat_ws("|", *ids, tx.clean("text")))
    evidence_id = F.coalesce(F.nullif(tx.clean("evidence_id"), F.lit("")), made)
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0))
    values = properties(text=F.col("text"), document_id=ids[0], limitation_id=ids[1], score=score)
    links = [(evidence_id, F.nullif(i, F.lit("")), k) for i, k in zip(ids, (EVIDENCE_FOR, SUPPORTED_BY))]
    return part(rows, evidence_id, EVIDENCE, F.lit("Evidence"), values, *links)


def findings(rows: DataFrame, kind: str, known_claims: DataFrame) -> Graph:
    """Of finding_id, claim_number, status and document_id (null or empty: none): nodes of a type of ``FINDINGS``, linked to
    all claims (node_id, claim_number) of that number."""
    name, to_claim, to_document, field = FINDINGS[kind]
    number = F.coalesce(F.col("claim_number").cast("int"), F.lit(0))
    values = {"claim_number": number, "status": F.col("status")} | ({field: F.col("document_id")} if field else {})
    label = F.concat(F.lit(name.replace("_", " ") + ": claim "), number.cast("string"))
    links = [(F.col("finding_id"), F.nullif(tx.clean("document_id"), F.lit("")), to_document)] if to_document else []
    own = part(rows, F.col("finding_id"), kind, label, properties(**values), *links)
    met = rows.select("finding_id", number.alias("claim_number")).join(known_claims.withColumnRenamed("node_id", "target"), "claim_number")
    return Graph(own.nodes, own.edges.unionByName(met.select(F.col("finding_id").alias("source"), "target", F.lit(to_claim).alias("edge_type"))))


def graph(*parts: Graph) -> Graph:
    """All parts as one graph: a node once, with the properties of all that add to it, and edges between nodes that are there.

    Of one id with several types or labels, the smallest stay; of one property with several values, the largest, so that the
    result doesn't depend on order, and an empty value doesn't hide one that is not.
    """
    rows = reduce(DataFrame.unionByName, [p.nodes for p in parts])
    ids = reduce(DataFrame.unionByName, [p.nodes.select("node_id") for p in parts])
    # Only ids are shuffled to find those that several rows add to; properties, texts among them, are only of these.
    shared = written(ids.groupBy("node_id").agg(F.count("*").alias("n")).where("n > 1").select("node_id"), "shared")
    several = rows.join(shared, "node_id", "left_semi")
    named = several.groupBy("node_id").agg(F.min(F.struct("node_type", "label")).alias("x"))
    values = several.select("node_id", F.explode("properties")).groupBy("node_id", "key").agg(F.max("value").alias("value"))
    merged = values.groupBy("node_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("properties"))
    columns = ["node_id", "node_type", "label", F.coalesce("properties", F.create_map().cast("map<string,string>")).alias("properties")]
    met = named.join(merged, "node_id", "left").select("node_id", "x.node_type", "x.label", "properties")
    nodes = rows.join(shared, "node_id", "left_anti").select(*columns).unionByName(met.select(*columns))
    edges = reduce(DataFrame.unionByName, [p.edges for p in parts]).distinct()
    for end in ("source", "target"):
        edges = edges.join(ids.select(F.col("node_id").alias(end)), end, "left_semi")
    return Graph(nodes, edges)


# what is asked of a graph -------------------------------------------------------------------------------------------


def _of(g: Graph, kind: str, name: str, **fields: str) -> DataFrame:
    """Nodes of a type: their id as ``name``, and properties under other names."""
    rows = g.nodes.where(F.col("node_type") == kind)
    return rows.select(F.col("node_id").alias(name), *[F.coalesce(F.element_at("properties", v), F.lit("")).alias(k) for k, v in fields.items()])


def _links(g: Graph, kind: str, source: str, target: str) -> DataFrame:
    return g.edges.where(F.col("edge_type") == kind).select(F.col("source").alias(source), F.col("target").alias(target))


def claim_evidence(g: Graph) -> DataFrame:
    """claim_id, limitation_id, limitation, evidence_id, evidence, score and document_id of all that supports each claim."""
    found = _of(g, EVIDENCE, "evidence_id", evidence="text", score="score", document_id="document_id")
    named = _of(g, LIMITATION, "limitation_id", limitation="text")
    rows = _links(g, HAS_LIMITATION, "claim_id", "limitation_id").join(named, "limitation_id")
    rows = rows.join(_links(g, SUPPORTED_BY, "evidence_id", "limitation_id"), "limitation_id").join(found, "evidence_id")
    return rows.withColumn("score", F.col("score").cast("double"))


def document_disclosures(g: Graph) -> DataFrame:
    """document_id, evidence_id, limitation_id, limitation (empty if it isn't there), evidence and score."""
    found = _of(g, EVIDENCE, "evidence_id", evidence="text", score="score", limitation_id="limitation_id")
    rows = _links(g, EVIDENCE_FOR, "evidence_id", "document_id").join(found, "evidence_id")
    rows = rows.join(_of(g, LIMITATION, "limitation_id", limitation="text"), "limitation_id", "left")
    return rows.withColumns({"limitation": F.coalesce("limitation", F.lit("")), "score": F.col("score").cast("double")})


def claim_findings(g: Graph) -> DataFrame:
    """claim_number, kind (as ``FINDINGS`` calls it), finding_id, status and document_id of all findings of each claim."""
    kind, document = F.lit(None).cast("string"), F.lit("")
    for node_type, (name, _, _, field) in FINDINGS.items():
        kind = F.when(F.col("node_type") == node_type, name).otherwise(kind)
        if field:
            document = F.when(F.col("node_type") == node_type, F.coalesce(F.element_at("properties", field), F.lit(""))).otherwise(document)
    rows = g.nodes.where(F.col("node_type").isin(*FINDINGS)).select(
        F.col("node_id").alias("source"), kind.alias("kind"), F.element_at("properties", "status").alias("status"), document.alias("document_id")
    )
    numbered = _of(g, CLAIM, "target", claim_number="claim_number")
    met = g.edges.select("source", "target").distinct().join(numbered, "target").join(rows, "source")
    return met.select(F.col("claim_number").cast("int").alias("claim_number"), "kind", F.col("source").alias("finding_id"), "status", "document_id").distinct()


def prior_art_of_claims(g: Graph) -> DataFrame:
    """claim_number, document_id and label of the documents that a claim's findings on novelty or inventive step name."""
    named = claim_findings(g).where(F.col("kind").isin("novelty", "inventive_step")).select("claim_number", "document_id").distinct()
    known = g.nodes.where(F.col("node_type") == DOCUMENT).select(F.col("node_id").alias("document_id"), "label")
    return named.join(known, "document_id").select("claim_number", "document_id", "label")


def evidence_paths(g: Graph) -> DataFrame:
    """evidence_id and path (structs of node_id, node_type and label) of each evidence: to its limitation, the smallest id of
    the claims that have it, and its document; of these, the ones that are there."""
    node = F.struct("node_id", "node_type", "label")
    known = g.nodes.select("node_id", node.alias("node"))
    rows = _of(g, EVIDENCE, "evidence_id", limitation_id="limitation_id", document_id="document_id")
    owner = _links(g, HAS_LIMITATION, "claim_id", "limitation_id").groupBy("limitation_id").agg(F.min("claim_id").alias("claim_id"))
    rows = rows.join(owner, "limitation_id", "left")
    for c in ("evidence_id", "limitation_id", "claim_id", "document_id"):
        rows = rows.join(known.withColumnsRenamed({"node_id": c, "node": f"{c}_node"}), c, "left")
    steps = F.array_compact(F.array(*[F.col(f"{c}_node") for c in ("evidence_id", "limitation_id", "claim_id", "document_id")]))
    return rows.select("evidence_id", steps.alias("path"))


def shortest_paths(edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """start, node, depth and path of every node that the edges (source, target) lead to from each of starts (node_id), in at
    most ``most`` hops: one shortest path each, the smallest of them by its nodes in order. depth 0 is the start itself.

    A node is never entered twice from one start, so cycles end. Each round extends the last frontier of all starts by a hop.
    """
    hops = edges.select("source", "target").distinct()
    first = starts.select(F.col("node_id").alias("start"), F.col("node_id").alias("node"), F.lit(0).alias("depth"), F.array("node_id").alias("path"))
    frontier = written(first.distinct(), "paths")
    parts = [frontier]
    while most is None or len(parts) <= most:
        step = frontier.join(hops, frontier["node"] == hops["source"]).select(
            "start", F.col("target").alias("node"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("target")).alias("path")
        )
        step = step.groupBy("start", "node").agg(F.min("depth").alias("depth"), F.min("path").alias("path"))
        seen = reduce(DataFrame.unionByName, [p.select("start", "node") for p in parts])
        frontier = written(step.join(seen, ["start", "node"], "left_anti"), "paths")
        if frontier.isEmpty():
            dropped(frontier)
            break
        parts.append(frontier)
    return reduce(DataFrame.unionByName, parts)


def shortest_paths_to(edges: DataFrame, starts: DataFrame, targets: DataFrame, most: int | None = None) -> DataFrame:
    """As ``shortest_paths``, but only of nodes that are in ``targets`` (node_id).

    What each node leads to is first found backward from the targets, as flags of 64 of them in a number: a row for each node
    and 64 targets, however many paths there are. Then the smallest next node is chosen for each node that a start needs, and
    only the paths of the result are put together.
    """
    hops = written(edges.where("source IS NOT NULL AND target IS NOT NULL").select("source", "target").distinct(), "hops")
    named = written(targets.where("node_id IS NOT NULL").select(F.col("node_id").alias("node")).distinct(), "named")
    ends = written(numbered(named, ["node"]).select("node", F.floor(F.col("n") / 64).alias("group"), (F.col("n") % 64).cast("int").alias("flag")), "targets")
    dropped(named)
    own = starts.select(F.col("node_id").alias("node")).distinct().withColumn("start", F.lit(True))

    # reach[d]: flags of the targets that a node is d hops from, and not fewer
    reach = [written(ends.select("node", "group", F.expr("shiftleft(1L, flag)").alias("flags")), "reach")]
    while most is None or len(reach) <= most:
        step = hops.join(reach[-1], F.col("target") == F.col("node")).select(F.col("source").alias("node"), "group", "flags", F.lit(0).cast("long").alias("seen"))
        seen = reduce(DataFrame.unionByName, reach).select("node", "group", F.lit(0).cast("long").alias("flags"), F.col("flags").alias("seen"))
        met = step.unionByName(seen).groupBy("node", "group").agg(F.bit_or("flags").alias("flags"), F.bit_or("seen").alias("seen"))
        found = written(met.select("node", "group", F.col("flags").bitwiseAND(F.bitwise_not("seen")).alias("flags")).where("flags <> 0"), "reach")
        if found.isEmpty():
            dropped(found)
            break
        reach.append(found)

    # choices[d]: where a node goes first to reach targets in d hops; each flag is at one next node, the smallest
    choices, passed = {}, None
    before = Window.partitionBy("node", "group").orderBy("next").rowsBetween(Window.unboundedPreceding, -1)
    for left in range(len(reach) - 1, 0, -1):
        wanted = reach[left].join(own, "node")
        if passed is not None:
            wanted = wanted.unionByName(passed).groupBy("node", "group").agg(F.bit_or("flags").alias("flags"), F.max("start").alias("start"))
        ahead = reach[left - 1].select(F.col("node").alias("next"), "group", F.col("flags").alias("ahead"))
        rows = hops.withColumnsRenamed({"source": "node", "target": "next"}).join(wanted, "node").join(ahead, ["next", "group"])
        rows = rows.withColumn("flags", F.col("flags").bitwiseAND(F.col("ahead"))).where("flags <> 0").select("node", "group", "next", "flags", "start")
        fresh = F.col("flags").bitwiseAND(F.bitwise_not(F.coalesce(F.bit_or("flags").over(before), F.lit(0).cast("long"))))
        choices[left] = written(rows.withColumn("flags", fresh).where("flags <> 0"), "choices")
        passed = choices[left].groupBy(F.col("next").alias("node"), "group").agg(F.bit_or("flags").alias("flags")).withColumn("start", F.lit(False))
    dropped(hops, *reach)

    paths = ends.select("node", "group", "flag", F.array("node").alias("path"))
    parts = [paths.join(own, "node", "left_semi").select("path")]
    for left in range(1, len(reach)):
        rest = paths.select(F.col("node").alias("next"), "group", "flag", "path")
        on = choices[left].join(rest, ["next", "group"]).where(F.expr("getbit(flags, flag) = 1"))
        paths = on.select("node", "group", "flag", F.concat(F.array("node"), "path").alias("path"), "start")
        paths = written(paths, "paths") if left < len(reach) - 1 else paths
        parts.append(paths.where("start").select("path"))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.select(F.get("path", F.lit(0)).alias("start"), F.element_at("path", -1).alias("node"), (F.size("path") - 1).alias("depth"), "path")


def ancestors(parents: DataFrame) -> DataFrame:
    """artifact, ancestor and depth (hops, the fewest) of all that each artifact comes from, of parents (artifact, parent).

    A parent that is no artifact itself is an ancestor without any of its own. An artifact that is its own ancestor by a cycle
    is not told.
    """
    hops = parents.where("artifact IS NOT NULL AND parent IS NOT NULL AND artifact <> parent").select(F.col("artifact").alias("source"), F.col("parent").alias("target")).distinct()
    parts, reach = [written(hops.withColumn("depth", F.lit(1)), "ancestors")], 1
    while True:
        # what is exactly as deep as was looked goes on by all that its end comes from, so that each round looks twice as deep
        seen = reduce(DataFrame.unionByName, parts)
        ends = parts[-1].where(F.col("depth") == reach)
        step = ends.join(seen.select(F.col("source").alias("target"), F.col("target").alias("next"), F.col("depth").alias("more")), "target")
        step = step.select("source", F.col("next").alias("target"), (F.col("depth") + F.col("more")).alias("depth")).where("source <> target")
        step = step.groupBy("source", "target").agg(F.min("depth").alias("depth"))
        found = written(step.join(seen.select("source", "target"), ["source", "target"], "left_anti"), "ancestors")
        if found.isEmpty():
            dropped(found)
            break
        parts.append(found)
        reach *= 2
    return reduce(DataFrame.unionByName, parts).select(F.col("source").alias("artifact"), F.col("target").alias("ancestor"), "depth")
