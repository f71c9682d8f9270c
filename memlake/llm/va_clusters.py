"""Centroid clustering over a vector-approximation file.

Vectors become integers, floor(scale * x). Beside each vector stands its approximation: the number of
a cell in every dimension, a few bits each. The cells of a dimension are equally wide within four
deviations of its mean; the outermost reach to its least and greatest value, so every value lies in
its cell. For a set of centroids two lookup tables give, per centroid, dimension and cell, the least
and the greatest share that the dimension can have in the squared distance, less the distance to the
centroids' mean, which is the same for all and would only widen the interval. Their sums over the
dimensions are an interval per centroid. Where one lies below all others, the nearest centroid is
known without the vector; elsewhere the vector is fetched and compared exactly with the centroids
whose intervals reach the least upper end. Results are those of plain Lloyd rounds, bit for bit.

The first round reads all vectors, for the sums. Later rounds read the approximations alone; vectors
are fetched, by a join on the row's key, for undecided rows and for rows that change cluster, whose
vectors move from one sum to another. The last assignment reads all vectors again, for the distances.
Only seeds, bounds per dimension and sums per cluster pass the driver.

Defined results: vectors of another length than `dims`, null ones, ones with null or non-finite
components or with a component beyond 2^27 after scaling (whose distance no long can hold) are left
out; rows without vec_id take part but are no seeds; repeated rows count each for itself, and among
equal seed hashes the smaller vector comes first; fewer rows than centroids give fewer clusters, and
without a seed there are no rows; equal distances go to the smaller number; empty clusters keep their centroid.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from memlake.llm import rows
from memlake.sources.scratch import cut

#: Centroids, rounds, components of a vector and integers per unit.
CLUSTERS, ROUNDS, DIMS, SCALE = 16, 3, 64, 64
#: Bits of a cell.
BITS = 6
#: Largest component in magnitude.
WIDEST = 1 << 27


class Cells:
    """Cells of each dimension: `edges` (dims, cells + 1), cell j being edges[j] <= v < edges[j + 1]."""

    def __init__(self, least, greatest, mean, deviation, bits: int):
        self.bits, n = bits, 1 << bits
        width = np.maximum(1, np.ceil(8 * np.asarray(deviation) / n)).astype(np.int64)
        first = np.round(mean).astype(np.int64) - width * (n // 2)
        self.first, self.width = first, width
        edges = first[:, None] + width[:, None] * np.arange(n + 1)
        edges[:, 0] = np.minimum(edges[:, 0], least)
        edges[:, -1] = np.maximum(edges[:, -1], np.asarray(greatest) + 1)
        self.low, self.high = edges[:, :-1], edges[:, 1:] - 1

    def of(self, v: np.ndarray) -> np.ndarray:
        return np.clip((v - self.first) // self.width, 0, (1 << self.bits) - 1).astype(np.uint8)

    def pack(self, cells: np.ndarray) -> list[bytes]:
        each = np.unpackbits(cells[:, :, None], axis=2, count=None)[:, :, 8 - self.bits:]
        return [r.tobytes() for r in np.packbits(each.reshape(len(cells), -1), axis=1)]

    def unpack(self, packed: list[bytes]) -> np.ndarray:
        d = len(self.first)
        size = -(-d * self.bits // 8)
        flat = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), size)
        each = np.unpackbits(flat, axis=1)[:, :d * self.bits].reshape(len(packed), d, self.bits)
        return each @ (1 << np.arange(self.bits - 1, -1, -1))

    def tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest share (centroids, dims, cells) of each cell. With m the centroids' mean,
        (v - c)^2 - (v - m)^2 is linear in v, so its bounds lie at a cell's ends."""
        mean = centroids.sum(0) // len(centroids)
        start = centroids ** 2 - mean ** 2
        slope = -2 * (centroids - mean)
        ends = [start[:, :, None] + slope[:, :, None] * v for v in (self.low, self.high)]
        return np.minimum(*ends), np.maximum(*ends)


class Nearest:
    """Assignment of vectors to centroids by their cells, and exactly where cells do not tell."""

    def __init__(self, centroids: np.ndarray, cells: Cells):
        self.centroids, self.cells = centroids, cells
        self.least, self.greatest = cells.tables(centroids)

    def intervals(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.arange(at.shape[1])
        return tuple(np.stack([t[c][d, at].sum(1) for c in range(len(t))], 1)
                     for t in (self.least, self.greatest))

    def decide(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid with the least upper end, which centroids' intervals reach that end)."""
        least, greatest = self.intervals(at)
        best = greatest.argmin(1)
        return best, least <= greatest[np.arange(len(at)), best][:, None]

    def exact(self, at: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        best, open_ = self.decide(at)
        doubt = np.flatnonzero(open_.sum(1) > 1)
        i, j = np.nonzero(open_[doubt])
        apart = ((vectors[doubt[i]] - self.centroids[j]) ** 2).sum(1)
        order = np.lexsort((j, apart, i))
        first = order[np.searchsorted(i[order], np.arange(len(doubt)))]
        best[doubt] = j[first]
        return best


def _vectors(packed: list[bytes], dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.int32).reshape(len(packed), dims).astype(np.int64)


def usable(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id, ints (the scaled vector) of the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                       F.col("embedding").cast("array<double>").alias("e")).where(F.size("e") == dims)
    v = v.where(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale < float(WIDEST))))
    return v.select("vec_id", F.transform("e", lambda x: F.floor(x * scale).cast("int")).alias("ints"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims).astype(np.int64)


def _spread(ints: DataFrame, dims: int, bits: int) -> Cells | None:
    """Cells from least and greatest value, mean and deviation; one row a dimension from each task."""
    schema = "dim int, least long, greatest long, total double, squares double, n long"
    kind = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches):
        seen = None
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(0), dims)
                f = v.astype(float)
                here = [v.min(0), v.max(0), f.sum(0), (f * f).sum(0), np.full(dims, len(v))]
                seen = here if seen is None else [
                    op(a, b) for op, a, b in zip((np.minimum, np.maximum, np.add, np.add, np.add), seen, here)]
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip([np.arange(dims), *seen], arrow)], schema=arrow)

    found = ints.select("ints").mapInArrow(run, kind).groupBy("dim").agg(
        F.min("least"), F.max("greatest"), F.sum("total"), F.sum("squares"), F.sum("n")).orderBy("dim").collect()
    if not found:
        return None
    _, least, greatest, total, squares, n = (np.array(c) for c in zip(*found))
    mean = total / n
    return Cells(least, greatest, mean, np.sqrt(np.maximum(squares / n - mean ** 2, 0)), bits)


def _assigned(met: DataFrame, near: Nearest, dims: int, k: int) -> DataFrame:
    """Rows (key, cells, now) of met (key, cells, prev, vec), and per task one row a cluster with
    what its sum and its count gain: (cluster, gain)."""
    kind = _parse_datatype_string("key long, cells binary, now int, cluster int, gain array<long>")
    arrow = to_arrow_schema(kind)

    def run(batches):
        gain = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, rows.SLICE):
                part = batch.slice(at, rows.SLICE)
                col = {n: part.column(i) for i, n in enumerate(part.schema.names)}
                v = _vectors(col["vec"].to_pylist(), dims)
                now = near.exact(near.cells.unpack(col["cells"].to_pylist()), v)
                prev = col["prev"].fill_null(-1).to_numpy(zero_copy_only=False)
                v = np.hstack([v, np.ones((len(v), 1), np.int64)])
                moved = now != prev
                np.add.at(gain, now[moved], v[moved])
                left = moved & (prev >= 0)
                np.subtract.at(gain, prev[left], v[left])
                yield pa.RecordBatch.from_arrays(
                    [col["key"], col["cells"], pa.array(now, pa.int32()), pa.nulls(len(v), pa.int32()),
                     pa.nulls(len(v), arrow.field("gain").type)], schema=arrow)
        some = np.flatnonzero(gain.any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(some), f.type) for f in list(arrow)[:3]]
            + [pa.array(some, pa.int32()), pa.array(gain[some].tolist(), arrow.field("gain").type)], schema=arrow)

    return met.select("key", "cells", "prev", "vec").mapInArrow(run, kind)


def _gained(assigned: DataFrame, dims: int, k: int) -> list[list[int]]:
    """Sums of what each cluster gains, as exact integers; at most k rows."""
    sums = assigned.where("cluster is not null").groupBy("cluster").agg(
        *[F.sum(F.col("gain")[d].cast("decimal(38,0)")).alias(f"g{d}") for d in range(dims + 1)])
    out = [[0] * (dims + 1) for _ in range(k)]
    for r in sums.collect():
        out[r[0]] = [int(x) for x in r[1:]]
    return out


def _looked(state: DataFrame, near: Nearest) -> DataFrame:
    """key, cells, prev, now of state (key, cells, prev): now is null where intervals overlap."""

    def make():
        def work(cols):
            best, open_ = near.decide(near.cells.unpack(cols["cells"].to_pylist()))
            return cols | {"now": pa.array(best, pa.int32(), mask=open_.sum(1) > 1)}

        return work

    return rows.map_batches(state, "key long, cells binary, prev int, now int", make)


def _measured(placed: DataFrame, near: Nearest, dims: int) -> DataFrame:
    """vec_id, cluster, distance of placed (vec_id, cells, vec)."""

    def make():
        def work(cols):
            v = _vectors(cols["vec"].to_pylist(), dims)
            now = near.exact(near.cells.unpack(cols["cells"].to_pylist()), v)
            return {"vec_id": cols["vec_id"], "cluster": now, "distance": ((v - near.centroids[now]) ** 2).sum(1)}

        return work

    return rows.map_batches(placed.select("vec_id", "cells", "vec"), "vec_id long, cluster int, distance long", make)


def clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE,
             bits: int = BITS, seed: str = "1:", report: list | None = None) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance per row; the final centroids). Seeds are the k rows with the least
    sha256 of seed and vec_id. `report` gets, per middle round, how many rows were fetched."""
    ints = usable(vectors, dims, scale)
    cells = _spread(ints, dims, bits)
    spark = vectors.sparkSession
    if cells is None:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    hashed = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    seeds = ints.where("vec_id is not null").withColumn("h", hashed).orderBy("h", "ints").limit(k).collect()
    centroids = [list(r.ints) for r in seeds]
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    k = len(centroids)

    def make():
        def work(cols):
            v = _matrix(cols["ints"], dims) if len(cols["ints"]) else np.zeros((0, dims), np.int64)
            return {"key": cols["key"], "vec_id": cols["vec_id"], "cells": cells.pack(cells.of(v)),
                    "vec": [r.tobytes() for r in v.astype(np.int32)]}

        return work

    placed = cut(rows.map_batches(ints.withColumn("key", F.monotonically_increasing_id()),
                                  "key long, vec_id long, cells binary, vec binary", make))
    sums = [[0] * (dims + 1) for _ in range(k)]
    calm, state = None, None
    for n in range(rounds):
        near = Nearest(np.array(centroids, np.int64), cells)
        if state is None:
            met = placed.withColumn("prev", F.lit(None).cast("int"))
        else:
            seen = cut(_looked(state, near))
            stays = F.col("now").isNotNull() & (F.col("now") == F.col("prev"))
            calm = seen.where(stays).select("key", "cells", "prev")
            asked = seen.where(~stays).select("key", "cells", "prev")
            if report is not None:
                report.append(asked.count())
            met = asked.join(placed.select("key", "vec"), "key")
        assigned = cut(_assigned(met, near, dims, k))
        for mine, gain in zip(sums, _gained(assigned, dims, k)):
            mine[:] = [a + b for a, b in zip(mine, gain)]
        state = assigned.where("key is not null").select("key", "cells", F.col("now").alias("prev"))
        if calm is not None:
            state = state.unionByName(calm)
        centroids = [[x // s[-1] for x in s[:-1]] if s[-1] else c for s, c in zip(sums, centroids)]
    return _measured(placed, Nearest(np.array(centroids, np.int64), cells), dims), centroids


def with_totals(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 per row."""
    found, centroids = clusters(vectors, **options)
    found = cut(found)
    sums = {r[0]: r[1] for r in found.groupBy("cluster").agg(F.sum("distance")).collect()}  # a row a cluster
    named = [(c, sums[c], sum(sums.values()), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest())
             for c, v in enumerate(centroids) if c in sums]
    table = vectors.sparkSession.createDataFrame(
        named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
