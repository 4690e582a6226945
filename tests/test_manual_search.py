"""The search in chunks gives its SQL's rows, ties and odd ids included, and shuffles no pairs."""

import random

import duckdb
import pytest

from attesta.operators import overlaps
from attesta.plans.catalog import ORACLE_SQL, QUERIES

NAME = "manual_search_topk"
STOCK = "a of ring bolts Bolts rings  naïve bolts_x x-ray ray 12 123 e.g.\r\n \n\n\n\n été ǅungla ring's 3d-x STRASSE straße".split(" ")


def tables(spark, path, items, docs):
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    for name in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet/*.parquet'")
    return sorted(con.execute(ORACLE_SQL[NAME]).fetchall(), key=str)


def found(spark, path):
    return sorted(map(tuple, QUERIES[NAME](spark, str(path)).collect()), key=str)


def texts(rng, n, words):
    return [" ".join(rng.choices(STOCK, k=rng.randint(0, words))) for _ in range(n)] + ["", None]


@pytest.mark.parametrize("size, cells", [(1000, 400_000), (5, 40)])
def test_rows_are_those_of_sql(spark, tmp_path, monkeypatch, size, cells):
    monkeypatch.setattr(overlaps.blocks, "__defaults__", (size,))
    monkeypatch.setattr(overlaps, "CELLS", cells)
    rng = random.Random(8)
    items = list(enumerate(texts(rng, 20, 6))) + [(None, "ring bolts"), (None, "bolts 123"), (3, "ring ray"), (3, "ring")]
    docs = list(enumerate(texts(rng, 60, 30))) + [(100, "ring bolts " * 1500), (None, "rings ring ray bolts 123")]
    docs += [(7, "ring 123"), (100, "ray 123 " + "bolts " * 1100)]
    expected = tables(spark, tmp_path, items, docs)
    assert any(r[0] is None for r in expected) and any(r[2] == 100 for r in expected)
    assert found(spark, tmp_path) == expected


def test_null_ids_come_last_and_add_up(spark, tmp_path):
    expected = tables(spark, tmp_path, [(None, "ring")], [(None, "ring"), (1, "ring")])
    assert expected == [(None, 1, 1, 1, 1), (None, 2, None, 1, 1)]
    assert found(spark, tmp_path) == expected
    expected = tables(spark, tmp_path / "both", [(None, "ring")], [(None, "ring"), (1, "ring"), (None, "ring")])
    assert found(spark, tmp_path / "both") == expected == [(None, 1, None, 1, 2), (None, 2, 1, 1, 1)]


@pytest.mark.parametrize("items, docs", [([], [(1, "ring")]), ([(1, "a")], [(1, "ring")]), ([(1, "ring")], [])])
def test_nothing_shared_gives_no_rows(spark, tmp_path, items, docs):
    assert tables(spark, tmp_path, items, docs) == found(spark, tmp_path) == []


def test_pairs_are_not_shuffled(spark, tmp_path):
    tables(spark, tmp_path, [(i, "ring ray bolts") for i in range(20)], [(i, "ring bolts") for i in range(400)])
    df = QUERIES[NAME](spark, str(tmp_path))
    assert df.count() == 100
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "MapInArrow" in final and "Join" not in final
    pairs = overlaps.most_shared(
        spark.sql("SELECT id AS doc_id, array('ring bolts') AS passages FROM range(0, 400, 1, 3)"), spark.sql("SELECT id AS item_id, map('ring', 1) AS tokens FROM range(20)"), 5
    )
    assert pairs.count() == 3 * 20 * 5


def test_counts_of_many_rows_do_not_overflow(spark):
    items = spark.sql("SELECT 1L AS item_id, map('ring', 70000L, 'ray', 2L) AS tokens")
    docs = spark.sql("SELECT 5L AS doc_id, array('ring ray', 'ray') AS passages")
    assert [(r.passage, r.shared) for r in overlaps.most_shared(docs, items, 5).orderBy("passage").collect()] == [(0, 70002), (1, 2)]
