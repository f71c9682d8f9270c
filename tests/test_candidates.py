import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.operators.duplicates import resembling
from memlake.sources import candidates
from memlake.sources.scratch import new_path

SCHEMA = "id bigint, embedding array<float>"


def groups(rng, n, dim=12, count=6):
    centres = rng.standard_normal((count, dim)) * 3
    at = rng.integers(count, size=n)
    return at, (centres[at] + rng.standard_normal((n, dim)) * 0.6).astype(np.float32)


def frame(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(vectors)], SCHEMA)


@pytest.mark.parametrize("tile_rows", [16, 4096])
def test_index_answers_as_the_store_does(spark, tile_rows):
    _, vectors = groups(np.random.default_rng(1), 400)
    held, later, asked = frame(spark, vectors[:200]), frame(spark, vectors[200:300], 200), frame(spark, vectors[300:], 300)
    asked = asked.unionByName(spark.createDataFrame([(900, None), (901, [0.0] * 12)], SCHEMA))
    root = new_path(spark, "index")
    assert not candidates.exists(spark, root) and candidates.resembling(asked, root).count() == 0
    candidates.prepare(held, root)
    candidates.prepare(held, root)  # a second time changes nothing
    candidates.append(later, root, "b1")
    candidates.append(later, root, "b1")  # written again, it replaces itself
    want = {r.id for r in resembling(asked, held.unionByName(later)).collect()}
    assert 10 < len(want) < 100
    assert {r.id for r in candidates.resembling(asked, root, tile_rows=tile_rows).collect()} == want
    without = {r.id for r in resembling(asked, held).collect()}
    assert {r.id for r in candidates.resembling(asked, root, without_batch="b1").collect()} == without != want


def test_only_asked_cells_are_read(spark):
    at, vectors = groups(np.random.default_rng(2), 600, dim=16, count=8)
    root = new_path(spark, "index")
    assert candidates.create(frame(spark, vectors), root, cells=24)
    candidates.append(frame(spark, vectors), root, "held")
    asked, read = frame(spark, vectors[at == 0][:3], 5000), []
    assert candidates.resembling(asked, root, report=read).count() == 3
    sketches, full = read
    plan = sketches._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "embedding" not in plan.split("ReadSchema")[1]
    everything = spark.read.parquet(f"{root}/cells")
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    assert 0 < files(full) <= files(sketches) < files(everything) / 2
    assert sketches.select("cell").distinct().count() < everything.select("cell").distinct().count() / 2


def test_index_of_an_empty_store_starts_with_the_first_entries(spark):
    _, vectors = groups(np.random.default_rng(3), 60)
    root, none = new_path(spark, "index"), spark.createDataFrame([], SCHEMA)
    candidates.prepare(none, root)
    candidates.add(none, root, "b0")
    assert not candidates.exists(spark, root)
    candidates.add(frame(spark, vectors[:30]), root, "b1")
    candidates.prepare(frame(spark, vectors[:30]), root)  # already there, under its own label
    candidates.add(frame(spark, vectors[30:], 30), root, "b2")
    assert spark.read.parquet(f"{root}/cells").count() == 60
    assert candidates.resembling(frame(spark, vectors, 100), root).count() == 60
