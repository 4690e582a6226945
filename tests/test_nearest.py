"""The nearest vectors in blocks are those of all pairs: ties, copies, nulls, zeros, NaN and lengths that differ."""

import random

import pytest
from pyspark.sql import functions as F

from attesta.functions import similarity as sim
from attesta.operators import nearest as ops, search
from attesta.operators.search import top_k


@pytest.mark.parametrize("vectors, queries", [(2048, 1024), (30, 4)])
def test_blocks_find_what_all_pairs_find(spark, monkeypatch, vectors, queries):
    monkeypatch.setattr(ops, "VECTORS", vectors)
    monkeypatch.setattr(ops, "QUERIES", queries)
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(120)] + [(i, [1.0] * 8) for i in range(120, 150)]
    rows += [(150, None), (151, [0.0] * 8), (152, [1.0] * 7), (153, []), (154, [None] + [1.0] * 7), (155, [float("nan")] * 8), (156, [-1.0] * 8), (None, [1.0] * 8)]
    v = spark.createDataFrame(rows, "doc_id long, embedding array<float>").repartition(3)
    q = v.where("doc_id % 10 = 0 OR doc_id > 149").select(F.col("doc_id").alias("item_id"), F.col("embedding").alias("q"))
    order = [F.desc("score"), F.asc("doc_id")]
    pairs = v.join(q, F.col("doc_id") != F.col("item_id")).select("item_id", "doc_id", F.round(sim.cosine(F.col("q"), F.col("embedding")), 5).alias("score"))
    found, expected = (sorted(map(str, top_k(p.select("item_id", "doc_id", "score"), ["item_id"], order, 5).collect())) for p in (ops.nearest(v, q, 5), pairs))
    assert found == expected and len(found) == 22 * 5


def test_no_nested_loop(spark):
    v = spark.range(200).select(F.col("id").alias("doc_id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    plan = ops.nearest(v, v.select(F.col("doc_id").alias("item_id"), F.col("embedding").alias("q")), 3)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_fusion_is_a_full_outer_one_without_a_shuffle_of_all_pairs(spark):
    rng = random.Random(1)
    pairs = [(g, d) for g in range(4) for d in range(40)]
    a, b = ({p: rng.randint(0, 9) / 9 for p in rng.sample(pairs, n)} for n in (110, 12))
    lists = [spark.createDataFrame([(*p, s) for p, s in x.items()], "g long, d long, score double") for x in (a, b)]
    df = search.fuse(*lists, "g", "d", 7)
    score = lambda p: int((0.7 * b.get(p, 0.0) + 0.3 * a.get(p, 0.0)) * 1e6 + 0.5) / 1e6
    for g in range(4):
        best = sorted((p for p in {**a, **b} if p[0] == g), key=lambda p: (-score(p), p[1]))[:7]
        assert [(r.d, r.lexical, r.dense) for r in sorted(df.where(F.col("g") == g).collect(), key=lambda r: r["rank"])] == [(p[1], a.get(p, 0.0), b.get(p, 0.0)) for p in best]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "FullOuter" not in plan and "SortMergeJoin" not in plan
