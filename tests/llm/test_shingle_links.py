"""Near duplicates by five-word shingles, against all pairs in plain Python."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from attesta.llm import shingle_links


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """doc_id, smallest doc_id of its component, for all pairs with five-word Jaccard of 0.8 or more; and those pairs."""
    ids = defaultdict(list)
    for r in rows:
        ids[shingles(r.text)].append(r.doc_id)
    sets = list(ids)
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    shared = Counter(p for h in holders.values() for p in combinations(h, 2))
    pairs = [(i, j) for (i, j), n in shared.items() if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n)]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        root[find(i)] = find(j)
    least = defaultdict(list)
    for i, s in enumerate(sets):
        least[find(i)] += ids[s]
    return {(d, min(least[find(i)])) for i, s in enumerate(sets) for d in ids[s]}, pairs


@pytest.fixture(scope="module")
def edited(spark):
    """A large group of near copies, chains whose ends are unlike, and texts that are just too unlike."""
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(5000)]

    def changed(text, n):
        text = list(text)
        for i in range(n):
            text[5 + i * 10] = rnd.choice(words)
        return text

    texts = []
    base = [rnd.choice(words) for _ in range(120)]
    texts += [changed(base, rnd.choice([0, 1, 1, 2, 2, 3])) for _ in range(200)]
    for _ in range(60):
        doc = [rnd.choice(words) for _ in range(rnd.choice([30, 100, 400]))]
        texts += [doc, changed(doc, len(doc) // 50), changed(doc, len(doc) // 45 + 1)]
        for _ in range(2):
            doc = doc[len(doc) // 11 :] + [rnd.choice(words) for _ in range(len(doc) // 11)]
            texts.append(doc)
    rnd.shuffle(texts)
    return spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")


def test_groups_are_those_of_all_pairs(edited):
    expected, pairs = brute(edited.collect())
    assert len(pairs) > 1000
    assert {tuple(r) for r in shingle_links.near_duplicates(edited).collect()} == expected


def test_stage_keeps_one_of_each_group(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    expected, _ = brute(docs.collect())
    kept = p.near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted({least for _, least in expected})


def test_stage_loses_no_text_of_repeated_or_null_ids(spark):
    import corpus_pipeline as p

    def text(i):
        return " ".join(f"t{i}w{j}" for j in range(40))

    rows = [(3, text(1), "a"), (5, text(1), "a"), (5, text(2), "b"), (None, text(3), "c"), (None, text(4), "d"), (7, text(3), "e")]
    rows += [(5, text(2), "b"), (8, None, "f"), (9, "", "g"), (None, text(4), "d")]
    docs = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(((r.doc_id, r.text, r.source) for r in p.near_duplicates(spark, docs, "").collect()), key=str)
    assert kept == sorted([(3, text(1), "a"), (5, text(2), "b"), (7, text(3), "e"), (None, text(4), "d"), (8, None, "f")], key=str)


def test_near_duplicates_of_odd_rows(odd_docs):
    rows = shingle_links.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r.component_id for r in rows if r.doc_id in (1, 2)} == {1}
    assert {r.component_id for r in rows if r.doc_id in (3, 4, 5)} == {3}
    assert shingle_links.near_duplicates(odd_docs.limit(0)).count() == 0


def test_parities_rule_out_no_similar_pair(spark):
    """Sets of 1 to 3,000 members, by parities alone: similar pairs all pass, and short sets with little in common don't."""
    import numpy as np
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    rows = []
    for size in [1, 2, 9, 10, 40, 150, 700, 3000]:
        for unshared in [0, 1, size // 12, size // 10, size // 9, size // 2]:
            a = np.unique(rng.integers(0, 1 << 63, size, np.uint64))
            b = np.unique(np.concatenate([a[unshared:], rng.integers(0, 1 << 63, unshared, np.uint64)]))
            sets = [(len(x), [0] * 10, shingle_links.parities_of(x).view(np.int64).tolist()) for x in (a, b)]
            rows.append((shingle_links.similar(a, b), 2 * unshared >= size > 30 and size < 1000, *sets))
    told = "struct<size:long,sketch:array<long>,parities:array<long>>"
    pairs = spark.createDataFrame(rows, f"similar boolean, unlike boolean, a {told}, b {told}")
    got = pairs.select("similar", "unlike", shingle_links.may_be_similar(F.col("a"), F.col("b")).alias("passes")).collect()
    assert sum(r.similar for r in got) > 20
    assert all(r.passes for r in got if r.similar)
    assert not any(r.passes for r in got if r.unlike)
