"""Evidence and charts counted in batches: blocks of items, parts of documents and tasks cut differently give the same rows as
all pairs compared by plain Python, and no pair is shuffled."""

import random
import re

import pytest
from pyspark.sql import functions as F

from attesta.functions import text as tx
from attesta.operators import evidence as ev, overlaps

STOCK = "a of ring bolts spring rings the it-is co-ax coax using havings sing 12 ready 3d-x x/y. red. end".split()


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(STOCK, k=rng.randint(0, 60))) for _ in range(80)] + ["", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "ring bolts")], "doc_id long, text string").repartition(3)
    items = [" ".join(rng.choices(STOCK, k=rng.randint(1, 9))) for _ in range(23)] + ["", None, "ring", "a"]
    return spark.createDataFrame(list(enumerate(items)) + [(None, "ring")], "item_id long, text string"), docs


def tokens(normal):
    return [w for w in normal.split() if len(w) > 2 and w not in tx.STOP_WORDS]


def brute(items, docs):
    """(item, doc, passage): unrounded score of pairs that share a token."""
    normal = lambda t: re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s\-/\.]", " ", (t or "").lower())).strip()
    passages = {(r.doc_id, r.passage): normal(r.text) for r in ev.packed_passages(docs, 700).where("doc_id IS NOT NULL").collect()}
    out = {}
    for item, text in ((r.item_id, r.text) for r in items.where("item_id IS NOT NULL").collect()):
        own = tokens(normal(text))
        for key, held in passages.items():
            n = len(set(own) & set(tokens(held)))
            if n:
                hits = sum(f"{a} {b}" in held for a, b in zip(own, own[1:]))
                out[item, *key] = min(1.0, n / (len(set(own) | set(tokens(held)))) + min(0.2, 0.05 * hits))
    return out


@pytest.mark.parametrize("size, cells", [(1000, 400_000), (5, 40)])
def test_evidence_is_that_of_all_pairs(spark, tables, monkeypatch, size, cells):
    monkeypatch.setattr(overlaps.blocks, "__defaults__", (size,))
    monkeypatch.setattr(overlaps, "CELLS", cells)
    items, docs = tables
    expected = brute(items, docs)
    pairs = ev.passage_scores(items, ev.packed_passages(docs))
    assert {(r.item_id, r.doc_id, r.passage): r.score for r in pairs.collect()} == pytest.approx(expected, abs=1e-6)
    columns = ["item_id", "doc_id", "passage", "lexical", "phrase", "score", "rank", "status"]
    best = ev.limitation_evidence(items, docs)
    assert sorted(best.select(columns).collect()) == sorted(ev.ranked_evidence(pairs).select(columns).collect())
    claimed = ev.document_scores(items, docs, F.expr("item_id div 4")).collect()
    assert len({(r.claim, r.doc_id) for r in claimed}) == len(claimed)
    most = {}
    for (i, d, _), s in expected.items():
        most[i, d] = max(s, most.get((i, d), 0))
    assert {(x.item_id, r.doc_id): x.score for r in claimed for x in r.limitations} == pytest.approx(most, abs=1e-6)
    assert all(x.item_id // 4 == r.claim for r in claimed for x in r.limitations)


def test_charts_are_those_of_all_pairs(spark, tables, monkeypatch):
    monkeypatch.setattr(overlaps.blocks, "__defaults__", (5,))
    items, docs = tables
    passages = docs.select("doc_id", F.lit(0).alias("passage"), F.substring("text", 1, 40).alias("text"))
    words = lambda t: {w for w in t.split() if len(w) > 1}
    expected = {}
    for d in passages.where("doc_id IS NOT NULL").collect():
        for i in items.where("item_id IS NOT NULL").collect():
            a, b = i.text or "", (d.text or "").strip()
            score = min(1.0, len(words(a) & words(b)) / max(1, len(words(a) | words(b))) + (0.4 if a and a in b else 0))
            if round(score, 4) >= 0.15:
                expected[i.item_id, d.doc_id] = score
    assert {(r.item_id, r.doc_id): r.score for r in ev.chart(items, passages).collect()} == pytest.approx(expected, abs=1e-4)


def test_pairs_are_not_shuffled(spark, tables):
    items, docs = tables
    for df in (ev.passage_scores(items, ev.packed_passages(docs)), ev.document_scores(items, docs, F.expr("item_id div 4"))):
        assert "hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()
    plan = ev.limitation_evidence(items, docs)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan


def test_rounding_is_sparks(spark):
    import numpy as np

    values = [0.0000005, 0.1234565, 0.3000015, 1.0, 0.2999995, 1 / 3, 0.4375005, 0.1 + 0.2]
    found = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", F.round("v", 6).alias("r")).collect()
    assert overlaps.rounded(np.array(values), 6).tolist() == [r.r for r in sorted(found)]
