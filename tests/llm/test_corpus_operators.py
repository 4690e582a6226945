"""Mixing, near duplicates, substrings, neighbours and the pipeline against plain Python, and on odd rows."""

import hashlib
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from attesta.llm import ann, mixing, simhash, substring_dedup
from attesta.llm.word_arrays import hashed_words

SPACE = r"[^\x20\x09-\x0D]+"

# mixing ------------------------------------------------------------------------------------------------------------


def test_targets_stop_at_three_times_and_share_the_rest():
    assert mixing.targets([10, 90], [1, 1]) == [Fraction(30), Fraction(70)]
    assert mixing.targets([0, 0], [1, 2]) == [0, 0]
    sizes, weights = [5, 100, 3, 400, 0, 7], [1, 2, 3, 1, 2, 3]
    t = mixing.targets(sizes, weights)
    assert sum(t) == sum(sizes) and all(x <= 3 * s for x, s in zip(t, sizes))
    free = [x / w for x, s, w in zip(t, sizes, weights) if x < 3 * s]
    assert len(set(free)) == 1


def test_permutations_are_permutations():
    for n in (1, 2, 3, 10, 97, 1000):
        for key in (1, 2):
            assert sorted(mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key))) == list(range(n))
    assert mixing.permuted(np.arange(100), np.full(100, 100), np.full(100, 1)).tolist() != mixing.permuted(np.arange(100), np.full(100, 100), np.full(100, 2)).tolist()


def test_dealing_uses_every_slot():
    d = mixing.deal([100, 7, 0, 993], 16, 1)
    assert d.sum(axis=0).tolist() == [100, 7, 0, 993] and d.sum(axis=1).max() - d.sum(axis=1).min() <= 1


def test_mix_of_small_table(spark, small_docs):
    rows = mixing.taken(mixing.mix(small_docs, keep=("doc_id", "source"))).collect()
    assert len(rows) == small_docs.count()
    texts = {r.doc_id: r.text for r in small_docs.collect()}
    assert all(r.size == len(re.findall(SPACE, texts[r.doc_id] or "")) for r in rows)
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(t - n) <= max(0.1 * t, 64) for t, n in by.values())
    again = mixing.taken(mixing.mix(small_docs, keep=("doc_id", "source"))).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def brute_taken(mixed, sources):
    """Words taken of each row, by its stream and place, laid out and drawn in plain Python; rows of ``mixed`` tell the order."""
    rows = sorted(mixed.rows.select("source_ix", "stream", "place", "size").collect())
    held, last = {}, None  # the words that each row gives to each block of its source
    for r in rows:
        if last is None or last[0] != r.source_ix:
            block, word = 0, 0
        elif last[1] != r.stream and word:
            block, word = block + 1, 0
        last = (r.source_ix, r.stream)
        for _ in range(r.size):
            held.setdefault((r.source_ix, block), Counter())[tuple(r)[:3]] += 1
            word += 1
            if word == mixing.BLOCK_WORDS:
                block, word = block + 1, 0
    taken = Counter({tuple(r)[:3]: 0 for r in rows})
    for s in sources.itertuples():
        for slot in range(s.slots):
            block = int(mixing.block_of(np.array([s.source_ix]), np.array([slot]), np.array([s.blocks]))[0])
            taken.update(held[(s.source_ix, block)])
    return taken


@pytest.mark.parametrize("streams, shards", [(None, None), (3, 7)])
def test_words_taken_match_brute_force(spark, small_docs, odd_docs, streams, shards):
    docs = small_docs.where("doc_id < 60").select("doc_id", "text", "source").union(odd_docs.select("doc_id", "text", "source"))
    mixed = mixing.mix(docs, streams=streams, shards=shards)
    names = sorted({r.source for r in docs.collect() if r.source is not None}, key=lambda s: s.encode()) + [None]
    sizes = [sum(len(re.findall(SPACE, r.text or "")) for r in docs.collect() if r.source == s) for s in names]
    assert mixed.sources.source_size.tolist() == sizes
    assert mixed.sources.target.tolist() == [float(t) for t in mixing.targets(sizes, [i % 3 + 1 for i in range(len(names))])]
    expected = brute_taken(mixed, mixed.sources)
    found = {(r.source_ix, r.stream, r.place): r.taken for r in mixing.pieces(mixed).groupBy("source_ix", "stream", "place").agg(
        F.sum(F.when(F.col("block").isNotNull(), (F.col("to") - F.col("at")) * F.col("times")).otherwise(0)).alias("taken")).collect()}
    assert found == dict(expected)
    assert sorted(found.values()) == sorted(r.taken for r in mixing.taken(mixed).collect())


def test_mix_of_odd_rows(odd_docs):
    rows = mixing.taken(mixing.mix(odd_docs)).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.taken <= 3 * r.size for r in rows)
    assert mixing.taken(mixing.mix(odd_docs.limit(0))).count() == 0


def test_remixed_documents_hold_what_is_taken(small_docs):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    taken = {r.doc_id: r.taken for r in mixing.taken(mixing.mix(small_docs)).collect()}
    found = Counter()
    for r in mixing.remixed(small_docs, columns).collect():
        found[r.doc_id] += len(re.findall(SPACE, r.text or ""))
        assert r.n_chars == len(r.text)
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in found.items() if v}


# near duplicates ---------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = re.findall(SPACE, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_match_brute_force(odd_docs):
    for t in [None, "", " ", "One", "one two", "É A b C", "a b c d e f g " * 30] + [r.text for r in odd_docs.collect()]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_tree_finds_all_within_radius():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    values = np.unique(np.concatenate([base, *[base ^ np.uint64(1 << b) for b in (0, 5, 63)], base ^ np.uint64(3), base ^ np.uint64(7 << 40)]))
    found = {(int(a), int(b)) for q, n in simhash.BKTree(values).within(values, 2) for a, b in zip(q, n)}
    d = np.bitwise_count(values[:, None] ^ values[None, :])
    assert found == {(int(a), int(b)) for a, b in np.argwhere(d <= 2)}


@pytest.mark.parametrize("seed", [1, 2])
def test_links_join_what_brute_force_joins(spark, seed):
    rng = np.random.default_rng(seed)
    values = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
    for _ in range(160):
        v = values[rng.integers(len(values))]
        for b in rng.integers(0, 64, rng.integers(1, 4)):
            v ^= np.uint64(1) << np.uint64(b)
        values = np.append(values, v)
    values = np.unique(values)
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in np.argwhere(np.bitwise_count(values[:, None] ^ values[None, :]) <= 2):
        parent[find(i)] = find(j)
    signed = values.view(np.int64).tolist()
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(frame)).collect()}
    mine = [roots.get(v, v) for v in signed]
    assert all((find(i) == find(j)) == (mine[i] == mine[j]) for i in range(len(values)) for j in range(len(values)))


def test_near_duplicates_of_odd_rows(odd_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r.component_id for r in rows if r.doc_id in (1, 2)} == {1}
    assert {r.component_id for r in rows if r.fingerprint == "0" * 16} == {3}
    assert simhash.near_duplicates(odd_docs.limit(0)).count() == 0


def test_components_of_a_table_match_brute_force(small_docs, odd_docs):
    docs = small_docs.select("doc_id", "text").union(odd_docs.select(F.col("doc_id") + 100000, "text"))
    rows = docs.collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    least = {x: min((r.doc_id for r, y in zip(rows, root) if x == y and r.doc_id is not None), default=None) for x in set(root)}
    expected = sorted((r.doc_id or -1, f"{f:016x}", least[x] or -1) for r, f, x in zip(rows, fps, root))
    assert sorted((r.doc_id or -1, r.fingerprint, r.component_id or -1) for r in simhash.near_duplicates(docs).collect()) == expected


# substrings --------------------------------------------------------------------------------------------------------


def brute_removed(texts, window=35):
    words = [re.findall(SPACE, t or "") for t in texts]
    n = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if n[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


def made_texts():
    rng = np.random.default_rng(6)

    def words(n, k=10**9):
        return [f"w{i}" for i in rng.integers(0, k, n)]

    passage, other = words(60), words(40)
    texts = [" ".join(words(rng.integers(0, 80)) + passage + words(rng.integers(0, 80))) for _ in range(12)]
    texts += [" ".join(words(50) + passage[5:50] + words(50)), " ".join(passage[:34]), " ".join(passage[:35]), " ".join(passage)]
    texts += [" ".join(["same"] * 90), " ".join(["same"] * 34), " ".join(["a", "b"] * 40), " ".join(other + words(10) + other), " ".join(words(400, 2))]
    texts += [texts[0], texts[0], "", None, " ", "one two", " ".join(words(300)), "Word  \t spaced\n" * 40]
    return texts


@pytest.mark.parametrize("group", [2000, 3, 0])
def test_removal_matches_brute_force(spark, group):
    texts = made_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.repeated_substrings(docs, group=group).collect()}
    assert [rows[i] for i in range(len(texts))] == brute_removed(texts)


def test_long_words_that_differ_in_order_of_their_parts_are_unlike(spark):
    long = ["a" * 65536 + "b" * 65536, "b" * 65536 + "a" * 65536]
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join([*words[:20], x, *words[20:]]) for x in long]
    assert len(set(hashed_words(long).hashes.tolist())) == 2
    rows = substring_dedup.repeated_substrings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.n_removed for r in rows] == [0, 0]


def test_keys_with_most_rows_stay_where_they_are(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 3000, 1).otherwise(F.col("id")).alias("k"), "id")
    table = rows.where("id % 2 = 0 OR id < 3000").groupBy("k").agg(F.count("*").alias("n"))
    found = substring_dedup._in(rows, ["k"], table, ["id"])
    assert sorted(r.id for r in found.collect()) == [i for i in range(5000) if i < 3000 or i % 2 == 0]


def test_every_window_has_an_anchor():
    w = hashed_words(["x y z " * 30, " ".join(f"t{i}" for i in range(200))])
    at, _ = substring_dedup.anchors(w)
    for s in range(len(w.hashes)):
        if s + substring_dedup.WINDOW <= w.end_of_word[s]:
            assert ((at >= s) & (at + substring_dedup.GRAM <= s + substring_dedup.WINDOW)).any()


def test_substrings_of_odd_rows(odd_docs):
    rows = substring_dedup.repeated_substrings(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert substring_dedup.repeated_substrings(odd_docs.limit(0)).count() == 0


# neighbours --------------------------------------------------------------------------------------------------------


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(7).normal(size=(5, 16))
    np.testing.assert_allclose(np.linalg.norm(ann.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    np.testing.assert_allclose(ann.hadamard(ann.hadamard(x)), x)


def brute_nearest(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    good = list({(i, tuple(v)): (i, v) for i, v in good}.values())
    out = {}
    for q, v in good:
        if q % 20 == 0:
            scored = sorted((-float(ann.inner(v[None], w[None])[0, 0]), j) for j, w in good if j != q)
            out[q] = [(j, -s) for s, j in scored[:k]]
    return out


def test_neighbours_of_test_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    expected = brute_nearest([(r.vec_id, r.embedding) for r in table.collect()], 20)
    found = {}
    for r in ann.op10_ann_cross_polytope(spark, "/root/testdata/sf0.01").orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found.keys() == expected.keys()
    hits = sum(len({j for j, _ in found[q]} & {j for j, _ in expected[q]}) for q in expected)
    assert hits / sum(map(len, expected.values())) >= 0.9
    exact = {q: dict(v) for q, v in brute_nearest([(r.vec_id, r.embedding) for r in table.collect()], 10**6).items()}
    assert all(exact[q][j] == s for q in found for j, s in found[q])


def share_and_recall(x, n_queries=60, k=20):
    """The share of all vectors that share a probed bucket with a query, and how many of the k nearest are among them."""
    use = ann.layout(len(x), 64)
    met = np.zeros((n_queries, len(x)), bool)
    for t in range(ann.TABLES):
        code = ann.buckets(x, t, use.dims, 1)[:, 0]
        for q, probed in enumerate(ann.buckets(x[:n_queries], t, use.dims, use.probes)):
            met[q] |= np.isin(code, probed)
    true = np.argsort(-(x[:n_queries] @ x.T), axis=1)[:, 1 : k + 1]
    return met.mean(), np.take_along_axis(met, true, 1).mean()


def test_share_of_entries_met_falls_as_they_grow():
    x = np.random.default_rng(4).normal(size=(32_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    small, large = share_and_recall(x[:2000]), share_and_recall(x)
    assert small[1] >= 0.9 and large[1] >= 0.9
    assert large[0] < 0.4 * small[0] and large[0] < 0.2


def test_probed_buckets_are_the_nearest_of_all():
    x = np.random.default_rng(5).normal(size=(20, 8))
    dims, probes = (8, 4, 2), 30
    far = np.zeros((20, 1))
    for i, d in enumerate(dims):
        turned = ann.rotated(x, 64 * 3 + i)[:, :d]
        both = np.stack([turned, -turned], axis=2).reshape(20, -1)
        far = (far[:, :, None] + ((both.max(axis=1, keepdims=True) - both) ** 2)[:, None, :]).reshape(20, -1)
    found = ann.buckets(x, 3, dims, probes)
    np.testing.assert_allclose(np.take_along_axis(far, found, 1), np.sort(far, axis=1)[:, :probes])
    assert all(len(set(r)) == probes for r in found.tolist())
    assert (ann.buckets(x, 3, dims, 1)[:, 0] == far.argmin(axis=1)).all()


@pytest.mark.parametrize("lengths", ["lognormal", "one long"])
def test_neighbours_of_vectors_of_unequal_length(spark, lengths):
    rng = np.random.default_rng(9)
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()]
    scale = rng.lognormal(0, 1, len(rows)) if lengths == "lognormal" else np.where(np.arange(len(rows)) == 7, 20.0, 1.0)
    rows = [(i, (v * s).tolist()) for (i, v), s in zip(rows, scale)]
    vectors = np.array([v for _, v in rows])
    ids = np.array([i for i, _ in rows])
    found = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for at in np.flatnonzero(ids % 20 == 0):
        scores = vectors @ vectors[at]
        scores[at] = -np.inf
        hits.append(len(found[int(ids[at])] & set(ids[np.argsort(-scores, kind="stable")[:20]].tolist())) / 20)
    assert len(hits) == len(found) and np.mean(hits) >= 0.9, np.mean(hits)


def test_neighbours_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(8)
    same = [1.0, 2.0, 0.5, -1.0]
    rows = [(i, same) for i in range(60)] + [(100 + i, rng.normal(size=4).tolist()) for i in range(30)]
    rows += [(200, None), (201, []), (202, [0.0] * 4), (203, [1.0, None, 0.0, 0.0]), (204, [float("nan"), 0.0, 0.0, 1.0]), (205, [float("inf"), 0.0, 0.0, 1.0]), (None, same), (220, [1.0] * 3), (0, same)]
    table = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<double>, id string, score double")
    found = {}
    for r in ann.nearest(table, F.col("id") % 20 == 0, k=20, tables=20, probes=8).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    expected = brute_nearest([r for r in rows if r[1] is None or len(r[1]) == 4], 20)
    assert found.keys() == expected.keys() and all(found[q] == expected[q] for q in expected)
    assert ann.nearest(table.limit(0), F.col("id") % 20 == 0).count() == 0
    few = ann.nearest(table.where("vec_id in (0, 100)"), F.col("id") % 20 == 0, tables=20, probes=8).collect()
    assert {(r.query_id, r.vec_id) for r in few} == {(0, 100), (100, 0)}


# pipeline ----------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, odd_docs, small_docs, tmp_path):
    import corpus_pipeline as p

    docs = small_docs.select(p.COLUMNS).union(odd_docs.selectExpr("doc_id + 100000 AS doc_id", "text", "lang", "source", "CAST(n_chars AS BIGINT)"))
    kept = {}
    for name, stage in p.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        if name != p.STAGES[-1][0]:
            assert out.columns == p.COLUMNS
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
    languages = {r.doc_id for r in kept["language_id"]}
    assert set(range(200)) <= languages | {r.doc_id for r in small_docs.collect() if not re.search(r"[^\W\d_]", r.text or "")}
    assert len({simhash.fingerprint(r.text) for r in kept["near_duplicates"]}) == len(kept["near_duplicates"])
    assert not any(re.search("AKIA[A-Z0-9]{14}|[0-9a-f]{16}", r.text or "") for r in kept["secret_scan"])
    assert {r.doc_id for r in kept["byte_bpe"]} <= {r.doc_id for r in kept["secret_scan"]}
    texts = sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in kept["mixing"])
    assert sorted(r.decoded_sha256 for r in kept["byte_bpe"]) == texts


def test_stages_of_an_empty_table(spark, odd_docs):
    import corpus_pipeline as p

    docs = odd_docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")).limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, docs, "").count() == 0
