"""Rows that go to where their keys are once: edges by their source, expected and supported items by their keys."""

from attesta.operators import graph, review


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_meet_their_sources_without_another_shuffle(spark, monkeypatch):
    rows = spark.createDataFrame([("a", "b", "k"), ("a", "b", "k"), ("a", "gone", "k"), ("lost", "b", "k"), ("x", "y", "j"), (None, "b", "k")], "source string, target string, edge_type string")
    known = spark.createDataFrame([("a",), ("b",), ("b",)], "node_id string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = graph.dangling(graph.edges(rows.repartition(3), rows), known)
        found = executed(df)
        assert found.count("Exchange hashpartitioning(source") == 2 and "hashpartitioning(missing" not in found  # one for each end, the same one
        ends = sorted((r.end, r.missing or "") for r in df.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert ends == [("source", ""), ("source", "lost"), ("source", "x"), ("target", "gone"), ("target", "y")]


def test_coverage_takes_one_shuffle(spark):
    kind = "k int, item string"
    expected = spark.createDataFrame([(1, "A"), (1, "a "), (1, "b"), (2, None), (2, " "), (3, "c"), (None, "d")], kind)
    supported = spark.createDataFrame([(1, " a"), (1, "z"), (4, "c"), (None, "d"), (3, None)], kind)
    df = review.coverage_of(expected, supported, ["k"], "item")
    assert executed(df).count("Exchange") == 1 and "Join" not in executed(df)
    assert {r.k: (r.expected, r.supported, r.unsupported, r.coverage) for r in df.collect()} == {1: (2, 1, 1, 0.5), 3: (1, 0, 1, 0.0), None: (1, 0, 1, 0.0)}
