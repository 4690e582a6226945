"""The ranking by relevance gives its SQL's rows, odd ids included, and shuffles no pairs."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from attesta.functions import text as tx
from attesta.operators import overlaps
from attesta.plans.catalog import ORACLE_SQL, QUERIES

NAME = "search_relevance_rank"
STOCK = "a ring rings bolts --bolts coaxial co-axial- -co-axial coaxials ab- --- a--b ring--bolts x_coaxial/ring précis springs axials e.g.\n thermal".split(" ")


def tables(spark, path, items, docs):
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    rows = [(i, t, None if n % 3 == 0 else "web", "" if n % 4 == 0 else "en") for n, (i, t) in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3).write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    for name in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet/*.parquet'")
    found = con.execute(ORACLE_SQL[NAME])
    return [c[0] for c in found.description], sorted((plain(r) for r in found.fetchall()), key=str)


def plain(row):
    return tuple(round(float(x), 9) if x is not None else None for x in row)


def texts(rng, n, words):
    return [" ".join(rng.choices(STOCK, k=rng.randint(0, words))) for _ in range(n)] + ["", None]


@pytest.mark.parametrize("size, cells", [(1000, 400_000), (5, 40)])
def test_rows_are_those_of_sql(spark, tmp_path, monkeypatch, size, cells):
    monkeypatch.setattr(overlaps.blocks, "__defaults__", (size,))
    monkeypatch.setattr(overlaps, "CELLS", cells)
    rng = random.Random(4)
    items = list(enumerate(texts(rng, 20, 6))) + [(None, "ring bolts"), (30, "ring")]
    docs = list(enumerate(texts(rng, 90, 12))) + [(None, "rings ring coaxial"), (7, "ring bolts coaxial")]
    columns, expected = tables(spark, tmp_path, items, docs)
    found = QUERIES[NAME](spark, str(tmp_path)).select(*columns).collect()
    assert len(expected) > 200 and sorted(map(plain, found), key=str) == expected


def test_pairs_are_not_shuffled(spark, tmp_path):
    tables(spark, tmp_path, [(i, "ring coaxial bolts") for i in range(20)], [(i, "ring bolts") for i in range(400)])
    df = QUERIES[NAME](spark, str(tmp_path))
    assert len(df.collect()) == 400
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "MapInArrow" in final and "Join" not in final


def test_words_are_the_tokens(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([("".join(rng.choices("ab1-- -_.É\n", k=rng.randint(0, 40))),) for _ in range(500)], "t string")
    words = F.filter(F.split(tx.retriever_words(F.col("t")), " "), lambda w: F.length(w) >= 3)
    assert df.where(words != tx.retriever_tokens(F.col("t"))).count() == 0
