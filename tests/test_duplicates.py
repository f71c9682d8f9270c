import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.operators.duplicates import admit, resembling

SCHEMA = "id string, position bigint, embedding array<float>"


def greedy(vectors, threshold=0.98):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    kept = []
    for i in range(len(unit)):
        if not kept or (np.round(unit[kept] @ unit[i], 12) <= threshold).all():
            kept.append(i)
    return kept


def near_copies(rng, n=300, groups=40, dim=8):
    centres = rng.standard_normal((groups, dim))
    vectors = centres[rng.integers(groups, size=n)] + rng.standard_normal((n, dim)) * 0.14
    vectors[2 * n // 3 :] = centres[0] + rng.standard_normal((n - 2 * n // 3, dim)) * 0.02
    vectors[n // 2] = vectors[3]
    return vectors.astype(np.float32)


def frame(spark, vectors, positions=None):
    positions = positions or range(len(vectors))
    return spark.createDataFrame(
        [(f"k{i:05d}", int(p), [float(x) for x in v]) for i, (p, v) in enumerate(zip(positions, vectors))],
        SCHEMA,
    )


@pytest.mark.parametrize(
    "options",
    [
        {},
        {"tile_rows": 16, "cells": 1},
        {"tile_rows": 16, "cells": 6},
        {"tile_rows": 32, "cells": 4, "broadcast_bytes": 64},
        {"tile_rows": 32, "bands": (60, 4)},
    ],
)
def test_admission_equals_one_by_one(spark, options):
    vectors = near_copies(np.random.default_rng(1))
    want = {f"k{i:05d}" for i in greedy(vectors.astype(float))}
    got = admit(frame(spark, vectors), **options)
    assert got.count() == len(vectors)
    assert {r.id for r in got.where("admitted").collect()} == want


def test_equal_positions_fall_back_to_the_id(spark):
    vectors = near_copies(np.random.default_rng(2), n=90)
    want = {f"k{i:05d}" for i in greedy(vectors.astype(float))}
    rows = frame(spark, vectors, [i // 9 for i in range(90)])
    for options in ({}, {"tile_rows": 8, "cells": 3}):
        assert {r.id for r in admit(rows, **options).where("admitted").collect()} == want


def test_chain_keeps_both_ends(spark):
    angle = np.deg2rad(8)
    chain = np.array([[np.cos(i * angle), np.sin(i * angle)] for i in range(9)], dtype=np.float32)
    for options in ({}, {"tile_rows": 2, "cells": 1}):
        got = admit(frame(spark, chain), **options).where("admitted").collect()
        assert sorted(r.id for r in got) == [f"k{i:05d}" for i in range(0, 9, 2)]


def test_null_and_zero_vectors_resemble_nothing(spark):
    rows = spark.createDataFrame(
        [("a", 1, None), ("b", 2, None), ("c", 3, [0.0, 0.0]), ("d", 4, [1.0, 0.0]), ("e", 5, [2.0, 0.0])],
        SCHEMA,
    )
    got = {r.id: r.admitted for r in admit(rows).collect()}
    assert got == {"a": True, "b": True, "c": True, "d": True, "e": False}


def test_store_rows_block_and_threshold_is_strict(spark):
    rows = spark.createDataFrame([("a", 1, [0.6, 0.8]), ("b", 2, [0.8, 0.6]), ("c", 3, [0.0, 1.0])], SCHEMA)
    store = spark.createDataFrame([([1.0, 0.0],), (None,)], "embedding array<float>")
    assert {r.id for r in resembling(rows, store, 0.7).collect()} == {"b"}
    doubles = rows.where("id = 'a'").withColumn("embedding", F.array(F.lit(0.6), F.lit(0.8)))
    assert not resembling(doubles, store, 0.6).count()
    assert {r.id for r in admit(rows, store, 0.7).where("admitted").collect()} == {"a"}


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 8, "cells": 5, "tile_rows": 16}])
def test_resembling_equals_brute_force(spark, options):
    vectors = near_copies(np.random.default_rng(3))
    unit = vectors / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    want = {f"k{i:05d}" for i in range(len(unit)) if (np.round(unit[:40] @ unit[i], 12) > 0.98).any()}
    rows = frame(spark, vectors)
    store = rows.where("id < 'k00040'")
    assert {r.id for r in resembling(rows, store, **options).collect()} == want


def test_empty_batches(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert admit(none).count() == 0
    assert admit(none, none).count() == 0
    one = spark.createDataFrame([("a", 1, [1.0, 0.0])], SCHEMA)
    assert admit(one, none).where("admitted").count() == 1


def test_different_dimensions_are_an_error(spark):
    rows = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("b", 2, [1.0, 0.0, 0.0])], SCHEMA)
    with pytest.raises(Exception, match="different vector dimensions"):
        admit(rows).collect()


def test_long_chain_takes_few_writes(spark, monkeypatch):
    """Each row resembles only its neighbours, so admission alternates along the chain."""
    import math

    from memlake.operators import duplicates

    writes = []
    real = duplicates.cut
    monkeypatch.setattr(duplicates, "cut", lambda df: writes.append(1) or real(df))
    step = 0.11  # of an angle; cos of one step is above the threshold, of two below
    rows = [(i, i, [math.cos(i * step / 2), math.sin(i * step / 2), 0.0]) for i in range(56)]
    batch = spark.createDataFrame(rows, "id bigint, position bigint, embedding array<double>")
    got = {r.id for r in duplicates.admit(batch, threshold=math.cos(step * 0.75), tile_rows=4, cells=1).collect() if r.admitted}
    want, kept = set(), []
    for i, _, v in rows:
        if all(sum(a * b for a, b in zip(v, w)) <= math.cos(step * 0.75) for w in kept):
            want.add(i)
            kept.append(v)
    assert got == want
    assert len(writes) < 30


def test_bands_act_at_every_size(spark):
    import random

    from memlake.operators.duplicates import admit

    r = random.Random(3)
    rows = [(i, i, [r.gauss(0, 1) for _ in range(8)]) for i in range(40)]
    rows += [(i + 100, i + 100, [x + r.gauss(0, 0.05) for x in v]) for i, _, v in rows]
    batch = spark.createDataFrame(rows, "id bigint, position bigint, embedding array<double>")
    small = {r.id for r in admit(batch, bands=(2, 12), tile_rows=8).collect() if r.admitted}
    large = {r.id for r in admit(batch, bands=(2, 12)).collect() if r.admitted}
    assert small == large


def unclustered(spark, n=2000, dim=64):
    vectors = np.random.default_rng(7).standard_normal((n, dim)).astype(np.float32)
    return spark.createDataFrame(
        [(i, i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id bigint, position bigint, embedding array<float>")


def test_vectors_without_clusters_visit_few_cells_and_are_not_sent(spark):
    from memlake.operators import duplicates, vector_blocks as vb

    rows = unclustered(spark)
    anchors = vb.pick_anchors(rows, 2000, 64, 256)
    light = duplicates.sketch_cells(rows, 0.98, anchors).cache()
    assert light.count() < 71 * 2000
    near = duplicates.near_pairs(light.where("home").drop("home"), light.drop("home"), 0.98)
    assert near.count() < 20


@pytest.mark.parametrize("dim,cells", [(2, 9), (8, 40), (64, 30)])
def test_sketches_and_planes_miss_no_pair(spark, dim, cells):
    from memlake.operators import duplicates, vector_blocks as vb

    vectors = near_copies(np.random.default_rng(dim), n=240, groups=12, dim=dim).astype(float)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = frame(spark, vectors)
    for threshold in (0.98, 0.7, -0.2):
        anchors = vb.pick_anchors(rows, len(vectors), dim, cells)
        light = duplicates.sketch_cells(rows, threshold, anchors)
        near = duplicates.near_pairs(light.where("home").drop("home"), light.drop("home"), threshold, 50).collect()
        homes = {(r.cell, int(r.id[1:])) for r in near if r.home}
        probes = {(r.cell, int(r.id[1:])) for r in near if not r.home}
        cell_of = {i: c for c, i in homes}
        for i, j in zip(*np.nonzero(np.triu(np.round(unit @ unit.T, 12) > threshold, 1))):
            assert (cell_of[i], j) in probes
