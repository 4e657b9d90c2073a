"""Clusters and whitening against plain numpy, with odd rows."""

import hashlib

import numpy as np
import pytest

from veracity.llm import clusters, whitening

NAMES = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def plain(rows, k, rounds, width):
    """Every vector against every centroid."""
    points = [(i, [int(np.floor(np.float64(np.float32(c)) * 64)) for c in v]) for i, v in rows if v is not None and len(v) == width and all(c is not None and np.isfinite(c) for c in v)]
    digest = lambda i: "~" if i is None else hashlib.sha256(f"1:{i}".encode()).hexdigest()
    c = [x for _, x in sorted(((digest(i), x) for i, x in points))[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        at = [near(x)[1] for _, x in points]
        c = [[sum(col) // at.count(j) for col in zip(*[x for (_, x), a in zip(points, at, strict=True) if a == j], strict=True)] if j in at else m for j, m in enumerate(c)]
    got = [(i, *near(x)[::-1]) for i, x in points]
    per = {j: sum(d for _, a, d in got if a == j) for j in range(len(c))}
    return sorted(((i, a, d, per[a], sum(per.values()), hashlib.sha256(",".join(map(str, c[a])).encode()).hexdigest()) for i, a, d in got), key=repr)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, cluster int, n int").repartition(3)


def clustered(spark, rows, k, rounds, width):
    points = clusters.quantised(vectors(spark, rows), width)
    out = clusters.cluster(points, clusters.first_centroids(points, k), rounds)
    return sorted((tuple(r) for r in out.select("vec_id", *NAMES).collect()), key=repr)


@pytest.mark.parametrize("k,width,spread", [(16, 64, 0.3), (5, 3, 0.05), (1, 4, 0.2), (30, 2, 0.04)])
def test_clusters(spark, k, width, spread):
    rnd = np.random.default_rng(k)
    rows = [(i, (rnd.normal(size=width) * spread + rnd.integers(0, 3)).tolist()) for i in range(160)]
    rows += [(200, rows[0][1]), (7, rows[1][1]), (None, rows[2][1]), (None, None), (300, []), (301, [1.0] * (width + 1)), (302, [float("nan")] * width), (303, [None] + [0.0] * (width - 1)), (304, [float("inf")] * width)]
    assert clustered(spark, rows, k, 3, width) == plain(rows, k, 3, width)


def test_ties_and_few(spark):
    """Integer points in a square lattice have many ties; equal centroids leave all but the first empty; fewer vectors than centroids."""
    rows = [(i, [i % 4 / 64, i // 4 % 4 / 64]) for i in range(64)]
    assert clustered(spark, rows, 9, 3, 2) == plain(rows, 9, 3, 2)
    few = clustered(spark, [(1, [0.5]), (1, [0.5]), (2, [1e30])], 5, 3, 1)
    assert few[0] == few[1] and few[0][:3] == (1, 1, 0) and few[2][:3] == (2, 0, 0)  # centroids: 2, 1, 1
    assert clustered(spark, [(1, None)], 3, 3, 1) == []


def test_bounds_spare_distances():
    rnd = np.random.default_rng(4)
    middles = rnd.integers(-400, 400, (16, 64))
    x = (middles[rnd.integers(0, 16, 20_000)] + rnd.integers(-40, 40, (20_000, 64))).astype(np.int64)
    search = clusters.Search(middles + rnd.integers(-9, 9, (16, 64)))
    at, squared, upper, lower = search.assign(x, np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.zeros(len(x)))
    full = ((x[:, None, :] - search.c[None]) ** 2).sum(2)
    assert (at == full.argmin(1)).all() and (squared[squared >= 0] == full.min(1)[squared >= 0]).all()
    assert (upper >= np.sqrt(full.min(1))).all() and (lower <= np.sqrt(np.sort(full, 1)[:, 1])).all()
    first, search.measured = search.measured, 0
    again = search.assign(x, at, upper, lower)[0]
    assert (again == at).all() and search.measured < 0.02 * first


def whitened(spark, rows, k):
    return sorted(((tuple(r) for r in whitening.whiten(vectors(spark, rows), k).collect())), key=repr)


@pytest.mark.parametrize("width,k", [(64, 32), (5, 32), (40, 3)])
def test_whitening(spark, width, k):
    rnd = np.random.default_rng(width)
    full = [(i, (rnd.normal(size=width) * (0.9 ** np.arange(width))).tolist()) for i in range(300)]
    odd = [(900, None), (901, []), (902, [float("nan")] * width), (903, [1.0] * (width + 1)), (904, [None] * width), (905, [float("-inf")] * width)]
    rows = [*full, (None, full[0][1]), (3, full[0][1])]
    got = whitening.whiten(vectors(spark, rows + odd), k).collect()
    x = np.floor(64 * np.array([v for _, v in rows], np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, s, k = len(x), x.sum(0), min(k, width)
    y = n * x - s
    c = y / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    want = c @ u / np.sqrt(e)
    assert len(got) == n * k and {r["n"] for r in got} == {n}
    made = {}
    for r in got:
        made.setdefault((r["vec_id"], r["deviation"]), []).append((r["component"], r["whitened"]))
    sign = None
    for i, (name, _) in enumerate(rows):
        mine = sorted(made[name, int((y[i] ** 2).sum())])
        values = np.array([w for _, w in mine[:: len(mine) // k]])
        if sign is None:
            sign = np.sign(values * want[i])
        assert np.allclose(values * sign, want[i], atol=1e-9)
    explained = {r["component"]: r["explained"] for r in got}
    assert np.allclose([explained[j + 1] for j in range(k)], e / np.trace(c.T @ c / n), rtol=1e-9)
    assert {r["identity_error"] < 1e-9 for r in got} == {True}


def test_blocks_narrower_than_the_vectors(spark):
    """Passes over a narrow block until the residuals certify; a flat spectrum widens it."""
    rnd = np.random.default_rng(8)
    turn = np.linalg.qr(rnd.normal(size=(120, 120)))[0]
    for scale, narrow in ((0.5 ** np.arange(120) * 30, True), (np.ones(120), False)):
        rows = [(i, v.tolist()) for i, v in enumerate(rnd.normal(size=(400, 120)) * scale @ turn)]
        used, width = whitening.fit_list(vectors(spark, rows))
        at = whitening.centre(used, width)
        found = whitening.components(used, at, 4)
        x = np.floor(64 * np.array([v for _, v in rows], np.float32).astype(float)).astype(np.int64) + 1_000_000
        c = x - x.mean(0)
        e, u = np.linalg.eigh(c.T @ c / len(x))
        assert np.allclose(found.values, e[::-1][:4], rtol=1e-10)
        assert np.allclose(np.abs((found.vectors * u[:, ::-1][:, :4]).sum(0)), 1, atol=1e-10)
        assert (found.block == 8 and found.passes > 2) if narrow else found.block > 8


def test_degenerate(spark):
    assert whitened(spark, [], 4) == [] and whitened(spark, [(1, None)], 4) == []
    assert whitened(spark, [(1, [0.5, 0.25])] * 3, 4) == []  # no variance
    got = whitened(spark, [(i, [i / 64, 1.0, 2 * i / 64]) for i in range(5)], 3)  # rank 1
    assert {r[1] for r in got} == {1} and sorted(abs(round(r[4], 9)) for r in got) == [0, 0.707106781, 0.707106781, 1.414213562, 1.414213562]
    huge = whitened(spark, [(1, [1e38]), (2, [-1e38]), (3, [0.0])], 1)
    assert len(huge) == 3 and all(r[3] is None or r[3] >= 0 for r in huge)
