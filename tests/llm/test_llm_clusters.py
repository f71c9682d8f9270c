"""Centroid clustering over cells."""

import hashlib
import random

import numpy as np
import pytest

from memlake.llm import va_clusters as va


def plain(rows, k, rounds, dims, scale):
    good = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows
            if v and len(v) == dims and all(x is not None and np.isfinite(x) and abs(x) * scale < 2 ** 27 for x in v)]
    seeds = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in good if i is not None)[:k]
    centroids = [v for _, v in seeds]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    if not centroids:
        return [], []
    for n in range(rounds + 1):
        now = [min(range(len(centroids)), key=lambda c: (apart(v, centroids[c]), c)) for _, v in good]
        if n < rounds:
            for c in range(len(centroids)):
                mine = [v for (_, v), a in zip(good, now) if a == c]
                if mine:
                    centroids[c] = [sum(col) // len(mine) for col in zip(*mine)]
    return [(i, c, apart(v, centroids[c])) for (i, v), c in zip(good, now)], centroids


def made(r, n, dims):
    """Groups of points, wide tails, ties, repeated rows and rows that take no part."""
    rows = []
    for i in range(n):
        base = [(i % 7) * 0.3 - 1] * dims
        rows.append((i, [b + r.gauss(0, 0.2) for b in base]))
    rows += [(n + i, [r.choice([-0.5, 0.5]) for _ in range(dims)]) for i in range(40)]
    rows += [(n + 50, [1e4] * dims), (n + 51, [-3e3] * (dims - 1) + [2.0]), rows[0], rows[0], (rows[1][0], rows[2][1])]
    rows += [(None, [0.25] * dims), (n + 60, None), (n + 61, []), (n + 62, [1.0] * (dims + 1)), (n + 63, [None] * dims),
             (n + 64, [float("nan")] * dims), (n + 65, [float("-inf")] * dims), (n + 66, [1e300] * dims)]
    return rows


SCHEMA = "vec_id long, embedding array<double>, cluster string, key string, now string"


@pytest.mark.parametrize("bits", [2, 4, 6])
def test_same_as_plain_rounds(spark, bits):
    rows = made(random.Random(bits), 200, 6)
    df = spark.createDataFrame([(*x, "own", "own", "own") for x in rows], SCHEMA).repartition(3)
    want, centroids = plain(rows, 9, 3, 6, 64)
    fetched = []
    found, got = va.clusters(df, k=9, dims=6, bits=bits, report=fetched)
    key = lambda x: (x[0] is None, x)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)
    assert got == centroids
    assert len(fetched) == 2 and (bits < 6 or max(fetched) < len(want))


def test_totals_and_odd_tables(spark):
    rows = made(random.Random(9), 60, 64)
    df = spark.createDataFrame([(*x, "own", "own", "own") for x in rows], SCHEMA)
    want, centroids = plain(rows, 16, 3, 64, 64)
    got = va.with_totals(df).collect()
    key = lambda x: (x[0] is None, x)
    assert sorted(((x.vec_id, x.cluster, x.distance) for x in got), key=key) == sorted(want, key=key)
    for x in got:
        assert x.cluster_inertia == sum(d for _, c, d in want if c == x.cluster)
        assert x.inertia == sum(d for *_, d in want)
        assert x.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[x.cluster])).encode()).hexdigest()
    assert va.with_totals(df.limit(0)).count() == 0
    assert va.with_totals(df.where("vec_id is null")).count() == 0
    few = df.where("vec_id in (3, 4)")
    assert sorted((x.cluster, x.distance) for x in va.with_totals(few).collect()) == [(0, 0), (1, 0)]


def test_cells_hold_their_values():
    r = np.random.default_rng(1)
    v = np.concatenate([r.normal(0, 30, (500, 5)), [[-9000] * 5, [7000, 0, 0, 0, 1]]]).astype(np.int64)
    for bits in (1, 3, 5, 8):
        cells = va.Cells(v.min(0), v.max(0), v.mean(0), v.std(0), bits)
        at = cells.of(v)
        assert (cells.unpack(cells.pack(at)) == at).all()
        d = np.arange(5)
        assert (cells.low[d, at] <= v).all() and (v <= cells.high[d, at]).all()
        near = va.Nearest(v[:7], cells)
        low, high = near.intervals(at)
        mean = v[:7].sum(0) // 7
        apart = ((v[:, None] - v[:7]) ** 2).sum(2) - ((v - mean) ** 2).sum(1)[:, None]
        assert (low <= apart).all() and (apart <= high).all()
