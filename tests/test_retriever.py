"""Retrieval gives its SQL's rows, odd texts and ids included, and its pairs are neither joined nor shuffled."""

import random

import duckdb
import pytest

from attesta.operators import evidence as ev, overlaps
from attesta.plans.catalog import ORACLE_SQL, QUERIES

STOCK = "a of ring bolts Bolts rings spring -ring bolt- x--y co-ax coax 3d. 12; thermodynamic thermodynamics havings using naïve ab-c e.g. temperature-dependent".split()


def tables(spark, path, items, docs):
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    for name in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet/*.parquet'")
    return con


def texts(rng, n, words):
    return [" ".join(rng.choices(STOCK, k=rng.randint(0, words))) for _ in range(n)] + ["", None, "ring"]


def plain(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("size, cells", [(1000, 400_000), (7, 60)])
def test_rows_are_those_of_sql(spark, tmp_path, monkeypatch, size, cells):
    monkeypatch.setattr(overlaps.blocks, "__defaults__", (size,))
    monkeypatch.setattr(overlaps, "CELLS", cells)
    rng = random.Random(5)
    # the SQL's context of a limitation without terms is 1, the operator's 0 (see test_evidence): each has one here
    items = [(i, f"{t or ''} spring") for i, t in enumerate(texts(rng, 30, 8))] + [(None, "ring bolts thermodynamic"), (3, "spring coax ring"), (3, "ring bolts")]
    docs = list(enumerate(texts(rng, 60, 40))) + [(None, "ring bolts thermodynamics. rings"), (7, "spring coax rings; ring bolts"), (7, "spring coax ring")]
    con = tables(spark, tmp_path, items, docs)
    for name in ("retriever_scores", "filter_evidence", "retriever_statistics"):
        assert plain(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) == plain(con.execute(ORACLE_SQL[name]).fetchall()) != []


def test_runs_do_not_reach_into_other_passages(spark):
    limits = spark.createDataFrame([(1, "using providing having"), (2, "thermal"), (3, None)], "item_id long, text string")
    passages = spark.createDataFrame([(1, 0, "by using"), (1, 1, "providing it"), (2, 0, "causing providing havings")], "doc_id long, passage int, text string")
    assert [(r.item_id, r.doc_id, r.phrase) for r in ev.retriever_scores(limits, passages).collect()] == [(1, 2, 0.6)]


def test_pairs_are_not_shuffled(spark, tmp_path):
    tables(spark, tmp_path, [(i, "ring bolts spring") for i in range(20)], [(i, "ring bolts") for i in range(200)])
    df = QUERIES["retriever_scores"](spark, str(tmp_path))
    assert df.count() == 20 * 200
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "Exchange" not in plan
