"""Graphs by hand: chains, cycles, ties, nodes that aren't there, nulls and empty tables."""

import pytest
from pyspark.sql import functions as F

from attesta.operators import typed_graph as ops


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "source string, target string")


def starts(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node_id string")


def brute_ancestors(pairs):
    up = {}
    for a, b in pairs:
        up.setdefault(a, set()).add(b)
    out = {}
    for a in up:
        frontier, depth, seen = {a}, 0, set()
        while frontier:
            frontier = {n for x in frontier for n in up.get(x, ())} - seen
            depth += 1
            for n in frontier - {a}:
                out[a, n] = depth
            seen |= frontier
    return out


CHAIN = [(f"a{i}", f"a{i + 1}") for i in range(20)]
CYCLE = [("x", "y"), ("y", "z"), ("z", "x"), ("z", "w"), ("q", "x"), ("s", "s"), ("s", "w")]


@pytest.mark.parametrize("pairs", [CHAIN, CYCLE, CHAIN + CYCLE + [("a3", "x"), ("a5", "a9"), ("a3", "x")]])
def test_ancestors_of_chains_and_cycles(spark, pairs):
    found = ops.ancestors(spark.createDataFrame(pairs, "artifact string, parent string")).collect()
    assert {(r.artifact, r.ancestor): r.depth for r in found} == brute_ancestors(pairs)
    assert len(found) == len(brute_ancestors(pairs))


def test_ancestors_of_nulls_and_of_nothing(spark):
    kind = "artifact string, parent string, depth int"
    rows = spark.createDataFrame([(None, "a", 1), ("a", None, 2), ("b", "a", 3), ("b", "a", 4)], kind)
    assert [tuple(r) for r in ops.ancestors(rows).collect()] == [("b", "a", 1)]
    assert ops.ancestors(spark.createDataFrame([], kind)).collect() == []


def test_paths_are_the_smallest_of_the_shortest(spark):
    pairs = [("s", "b"), ("s", "a"), ("a", "t"), ("b", "t"), ("t", "u"), ("s", "u2"), ("u", "s"), ("u", "v"), ("v", "w")]
    found = {(r.start, r.node): r.path for r in ops.shortest_paths(edges(spark, pairs + pairs), starts(spark, "s", "t"), 4).collect()}
    assert found["s", "t"] == ["s", "a", "t"] and found["s", "v"] == ["s", "a", "t", "u", "v"]
    assert ("s", "w") not in found and found["t", "a"] == ["t", "u", "s", "a"] and found["s", "s"] == ["s"]
    assert {r.node for r in ops.shortest_paths(edges(spark, pairs), starts(spark, "v")).collect()} == {"v", "w"}
    assert [r.path for r in ops.shortest_paths(edges(spark, []), starts(spark, "lone")).collect()] == [["lone"]]


@pytest.fixture(scope="module")
def graph(spark):
    none = None
    patent = spark.createDataFrame([("P",)], "id string")
    claims = spark.createDataFrame([("P", "C1", 1, "A  pump", "independent", "other"), ("P", none, 2, "B", none, none), ("P2", "C9", 1, "far", "", "")], "patent_id string, claim_id string, number int, text string, type string, category string")
    limits = spark.createDataFrame([("C1", "L1", 1, "a valve", "x"), ("C1", "L2", 2, "a ring", none), ("gone", "L3", 1, none, none)], "claim_id string, limitation_id string, index int, text string, type string")
    docs = spark.createDataFrame([("D1", "first", "s", "t"), ("D2", none, none, none), ("D1", "first", "s", "")], "document_id string, title string, source string, text string")
    found = [("E1", "D1", "L1", "valve", 0.9), ("E2", "D1", "L2", "ring", 0.5), ("E3", "gone", "L1", "seal", None), ("E4", "D2", "gone", "bolt", 0.1), (none, "D2", "L3", "none", 0.2)]
    evidence = spark.createDataFrame(found, "evidence_id string, document_id string, limitation_id string, text string, score double")
    findings = spark.createDataFrame([("N1", 1, "OPEN", "D1"), ("N2", 7, "OPEN", "D2"), ("N3", 1, None, None)], "finding_id string, claim_number int, status string, document_id string")
    numbers = spark.createDataFrame([("C1", 1), ("C9", 1)], "node_id string, claim_number int")
    return ops.graph(
        ops.part(patent, F.col("id"), ops.PATENT, F.lit("Application"), ops.properties()), ops.claims(claims), ops.limitations(limits), ops.documents(docs),
        ops.evidence(evidence), ops.findings(findings, ops.NOVELTY, numbers), ops.findings(findings.withColumn("finding_id", F.concat(F.lit("A"), "finding_id")), ops.AMENDMENT, numbers),
    )


def test_nodes_and_edges_of_an_analysis(graph):
    nodes = {r.node_id: r for r in graph.nodes.collect()}
    assert nodes["C1"].label == "Claim 1" and nodes["C1"].properties["text"] == "A pump" and nodes["D2"].label == "Prior-art document"
    assert nodes["D1"].properties == {"source": "s", "text": "t"}
    assert sum(r.node_type == ops.CLAIM for r in nodes.values()) == 3 and sum(r.node_type == ops.EVIDENCE for r in nodes.values()) == 5
    found = {(r.source, r.target, r.edge_type) for r in graph.edges.collect()}
    assert ("P", "C1", "HAS_CLAIM") in found and ("E1", "D1", "EVIDENCE_FOR") in found and ("N1", "C9", "HAS_FINDING") in found
    assert not {e for e in found if "gone" in e or "P2" in e}


def test_what_supports_a_claim(graph):
    rows = {(r.claim_id, r.limitation, r.evidence_id, r.score, r.document_id) for r in ops.claim_evidence(graph).collect()}
    assert rows == {("C1", "a valve", "E1", 0.9, "D1"), ("C1", "a ring", "E2", 0.5, "D1"), ("C1", "a valve", "E3", 0.0, "gone")}
    seen = {(r.document_id, r.evidence_id, r.limitation) for r in ops.document_disclosures(graph).collect() if r.evidence_id.startswith("E") and len(r.evidence_id) == 2}
    assert seen == {("D1", "E1", "a valve"), ("D1", "E2", "a ring"), ("D2", "E4", "")}


def test_paths_of_evidence(graph):
    paths = {r.evidence_id: [n.node_id for n in r.path] for r in ops.evidence_paths(graph).collect()}
    assert paths["E1"] == ["E1", "L1", "C1", "D1"] and paths["E3"] == ["E3", "L1", "C1"] and paths["E4"] == ["E4", "D2"]
    assert [p for i, p in paths.items() if i not in ("E1", "E2", "E3", "E4")][0][1:] == ["L3", "D2"]


def test_findings_of_claims(graph):
    rows = {(r.claim_number, r.kind, r.finding_id, r.document_id) for r in ops.claim_findings(graph).collect()}
    assert rows == {(1, "novelty", "N1", "D1"), (1, "novelty", "N3", ""), (1, "amendments", "AN1", ""), (1, "amendments", "AN3", "")}
    assert [tuple(r) for r in ops.prior_art_of_claims(graph).collect()] == [(1, "D1", "first")]


def test_texts_of_nodes_told_once_are_not_shuffled(spark):
    docs = ops.documents(spark.createDataFrame([("D1", "a", "s", "t"), ("D2", "b", "s", "u"), ("D2", "b", "s", "v")], "document_id string, title string, source string, text string"))
    nodes = ops.graph(docs).nodes
    assert {r.node_id: r.properties for r in nodes.collect()} == {"D1": {"source": "s", "text": "t"}, "D2": {"source": "s", "text": "v"}}
    once = nodes.where("node_id = 'D1' AND node_type = 'PRIOR_ART_DOCUMENT'")
    plan = nodes._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and len(once.collect()) == 1


def test_ancestors_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(ops, "written", lambda df, name, write=ops.written: rounds.append(name) or write(df, name))
    found = ops.ancestors(spark.createDataFrame([(f"a{i:02}", f"a{i + 1:02}") for i in range(40)], "artifact string, parent string"))
    assert found.count() == 40 * 41 // 2 and len(rounds) <= 8


def test_paths_to_targets_are_those_of_a_search_from_all_starts(spark):
    pairs = [(f"n{i}", f"n{(i * k + 3) % 150}") for i in range(150) for k in (2, 5, 11)] + [("n1", None), (None, "n2"), ("s", "s"), ("s", "t")]
    first, wanted = starts(spark, "n0", "n7", "n7", "n64", "s", "gone"), starts(spark, *[f"n{i}" for i in range(0, 150, 2)], "n7", "n7", "t", "s", "far", None)
    e, wished = edges(spark, pairs + pairs), {r.node_id for r in wanted.collect() if r.node_id}
    for most in (0, 3, None):
        expected = sorted(tuple(r) for r in ops.shortest_paths(e, first, most).collect() if r.node in wished)
        assert sorted(tuple(r) for r in ops.shortest_paths_to(e, first, wanted, most).collect()) == expected
    assert ops.shortest_paths_to(e, first, starts(spark), 4).collect() == []


def test_paths_to_nations_hold_no_rows_for_what_lies_between(spark, monkeypatch):
    from attesta.plans import typed_graph_queries as queries

    layers = [[f"C{i}" for i in range(15)], [f"O{i}" for i in range(15)], [f"P{i}" for i in range(15)], [f"S{i}" for i in range(15)], ["N1", "N2"]]
    pairs = [(a, b) for one, two in zip(layers, layers[1:]) for a in one for b in two]
    nodes = spark.createDataFrame([(c, "CUSTOMER") for c in layers[0]], "node_id string, node_type string")
    monkeypatch.setattr(queries, "_graph", lambda *_: (nodes, edges(spark, pairs)))
    most = []
    monkeypatch.setattr(ops, "written", lambda df, name, write=ops.written: (out := write(df, name), most.append(out.count()))[0])
    found = {(r.start, r.node): r.path for r in queries.graph_shortest_paths(spark, "").collect()}
    assert len(found) == 30 and found["C4", "N2"] == "C4 > O0 > P0 > S0 > N2"
    assert sum(most) < 2 * len(pairs)  # the pairs once, and a few rows for each node
