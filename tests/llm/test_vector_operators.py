"""Whitening and near duplicates of vectors against numpy that holds them all."""

import numpy as np
import pytest

from attesta.llm import pivot_index, whitening

KIND = "vec_id long, embedding array<float>, label int, x string, v int, id long"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0, "x", 1, 2) for i, v in rows], KIND)


ODD = [(900, None), (901, []), (902, [0.0] * 8), (903, [None] + [1.0] * 7), (904, [float("nan")] + [1.0] * 7), (905, [float("inf")] + [1.0] * 7), (906, [1.0, 2.0]), (None, [0.5] * 8)]


# whitening ----------------------------------------------------------------------------------------------------------


def test_whitening_matches_numpy(spark):
    rng = np.random.default_rng(1)
    data = (rng.normal(size=(300, 8)) @ rng.normal(size=(8, 8))).astype(np.float32)
    data[50:80] = data[10]
    rows = list(enumerate(data.tolist())) + ODD
    found = whitening.whitened(frame(spark, rows), 5).toPandas()
    x = np.floor(64 * data.astype(float)).astype(np.int64) + 1_000_000
    x = np.concatenate([x, np.full((1, 8), 32 + 1_000_000), np.full((1, 8), 1_000_000)])  # the zero vector takes part
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = (n * fit - s) / n
    v = c.T @ c / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:5], q[:, ::-1][:, :5]
    expected = ((n * x - s) / n) @ q / np.sqrt(e)
    assert len(found) == 302 * 5 and set(found.n) == {n}
    null = found[found.id.isna()]
    got = np.stack([found[found.id == i].sort_values("component").whitened.to_numpy() for i in [*range(300), 902]])
    expected = np.concatenate([expected[:300], expected[301:]])
    signs = np.sign((got * expected).sum(axis=0))
    assert len(null) == 5 and np.abs(got * signs - expected).max() < 1e-9
    for i in (0, 60, 299):
        assert set(found[found.id == i].deviation) == {int(((n * x[i] - s) ** 2).sum())}
    assert np.allclose(found.groupby("component").explained.first(), e / np.trace(v), rtol=1e-9) and found.identity_error.max() < 1e-9


def test_deviations_are_exact_or_null(spark):
    d = whitening.centred(np.array([[2**40 + 1, 5]], np.int64), 2**30, [3, 4])
    assert d.dtype == object and d[0, 0] == (2**40 + 1) * 2**30 - 3
    assert whitening.deviations(d) == [None]
    assert whitening.deviations(np.array([[3037000499, 0]], np.int64)) == [3037000499**2]


@pytest.mark.parametrize("rows", [[], ODD[:2], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, [1e30, 2.0])]])
def test_nothing_to_whiten(spark, rows):
    assert whitening.whitened(frame(spark, rows)).collect() == []


def test_components_end_with_the_rank(spark):
    rng = np.random.default_rng(2)
    line = np.outer(rng.integers(-50, 50, 40), [1.0, 2.0, 0.0])
    found = whitening.whitened(frame(spark, enumerate(line.tolist()))).toPandas()
    assert set(found.component) == {1} and found.explained.iloc[0] == pytest.approx(1.0)


# near duplicates ----------------------------------------------------------------------------------------------------


def brute(rows, cosine=0.95):
    """(id, links, smallest id) of every row, all pairs compared."""
    good = [i for i, (_, v) in enumerate(rows) if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links, root = {i: set() for i in range(len(rows))}, list(range(len(rows)))
    for d in {len(rows[i][1]) for i in good}:
        own = [i for i in good if len(rows[i][1]) == d]
        x = np.array([rows[i][1] for i in own], np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        for a, b in zip(*np.nonzero(x @ x.T >= cosine)):
            if a != b:
                links[own[a]].add(own[b])
    changed = True
    while changed:
        changed = False
        for i in links:
            least = min([root[i], *(root[j] for j in links[i])])
            changed |= least != root[i]
            root[i] = least
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[root[i]] = min(least.get(root[i], name), name)
    return sorted(str((rows[i][0], len(links[i]), least.get(root[i]))) for i in range(len(rows)))


def found(df, **kw):
    rows = pivot_index.near_duplicates(df, **kw).collect()
    assert all(r.kept == (r.id == r.component_id) for r in rows)
    return sorted(str((r.id, r.n_links, r.component_id)) for r in rows)


def clustered(seed, n, d, groups, spread):
    """Vectors of which many are near copies at cosines about the threshold, and a third are of one group."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d))
    of = np.where(rng.random(n) < 0.33, 0, rng.integers(0, groups, n))
    x = centres[of] + rng.normal(size=(n, d)) * rng.uniform(0, spread, (n, 1))
    lone = rng.random(n) < 0.4
    x[lone] = rng.normal(size=(lone.sum(), d))
    return [(i, (v * 3.0).astype(np.float32).tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("seed, spread", [(1, 0.15), (2, 0.3)])
def test_links_and_components_are_those_of_all_pairs(spark, seed, spread, monkeypatch):
    monkeypatch.setattr(pivot_index, "LIST_BLOCK", 64)
    monkeypatch.setattr(pivot_index, "LOOK_BLOCK", 128)
    rows = clustered(seed, 1500, 64, 60, spread) + ODD
    assert found(frame(spark, rows).repartition(4)) == brute(rows)


def test_recall_of_pairs_just_above_the_threshold():
    rng = np.random.default_rng(3)
    n, d = 20_000, 64
    x = pivot_index.units(rng.normal(size=(n, d)))
    side = rng.normal(size=(2000, d))
    side -= (side * x[:2000]).sum(axis=1)[:, None] * x[:2000]
    near = 0.951 * x[:2000] + np.sqrt(1 - 0.951**2) * pivot_index.units(side)
    pivots = pivot_index.apart(x[rng.permutation(n)[: 4 * pivot_index.n_pivots(n, d)]], pivot_index.n_pivots(n, d))
    a, b = (pivot_index.prefixes(v, pivots, pivot_index.PREFIX) for v in (x[:2000], near))
    met = (a == b[:, :1]).any(axis=1) | (b == a[:, :1]).any(axis=1)
    shared = np.array([len(np.intersect1d(p, q)) for p, q in zip(a, b)])
    assert (met & (shared >= pivot_index.SHARED)).mean() >= 0.99


def test_equal_and_repeated_vectors(spark):
    a, b = [1.0, 2.0, 3.0], [-1.0, 2.0, 0.5]
    rows = [(5, a), (3, a), (3, a), (None, a), (8, [2.0, 4.0, 6.0]), (7, b), (7, b), (9, None), (None, None), (4, [1e-30, 2e-30, 3e-30])]
    assert found(frame(spark, rows)) == brute(rows)


def test_no_vectors(spark):
    assert found(frame(spark, [])) == []
    assert found(frame(spark, [(1, None), (2, [0.0])])) == [str((1, 0, 1)), str((2, 0, 2))]


def test_forest_joins_what_links_join():
    a, b = np.array([5, 3, 1, 8, 7]), np.array([3, 1, 2, 7, 9])
    assert pivot_index.forest(a, b, 10).tolist() == [0, 1, 1, 1, 4, 1, 6, 7, 7, 7]
