"""Approximate nearest neighbours by inner product along shifted space-filling curves.

Vectors are turned by a fixed rotation; each curve takes a few of the turned coordinates, shifts
them by its own offset, and orders all vectors by Hilbert index. An order is cut into blocks of
equally many vectors. A query meets the vectors of its own block and of the blocks up to a window
away, on every curve; what it meets is scored on the original vectors.

How wide the window must be depends on the data: near copies lie in the same block, vectors without
any structure lie anywhere. So it is measured: a bounded sample of queries is compared with all
vectors, and the window is the least at which the aimed share of their true neighbours is met.
On vectors without structure it approaches the whole curve, and the work that of brute force.

Equal vectors are folded to their least id; of each fold the k + 1 least ids can be neighbours.
A pair is scored on the first curve where it meets. The own blocks come first and give each query
a score that later blocks must reach, so a task returns few rows per query.

Defined results: vectors that are null, zero, of another length than most, or that hold null or
non-finite components, and rows without vec_id, take no part; rows repeated with id and vector
count once; an id with two vectors asks with both; fewer candidates than k give fewer rows.
"""

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from memlake.llm import rows
from memlake.sources.scratch import cut

#: Curves, coordinates and bits per curve, vectors per block, about.
CURVES, DIMS, BITS, BLOCK = 6, 4, 12, 1024
#: Bound on the queries that the window is measured with, and the share it aims at.
SAMPLE, AIM = 64, 0.96
#: Queries per task and block, about.
ASKING = 4096


def hilbert(at: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (n, dims), one bit of every coordinate after another."""
    x = [c.astype(np.uint64) for c in at.T]
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):  # undo the turns of each quadrant
        q, p = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for i in range(len(x)):
            up = (x[i] & q) > 0
            swap = np.where(up, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ swap)
            x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros(len(at), np.uint64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> np.uint64(b)) & one > 0, np.uint64((1 << b) - 1), np.uint64(0))
    key = np.zeros(len(at), np.uint64)
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = (key << one) | (((c ^ turn) >> np.uint64(b)) & one)
    return key.astype(np.int64)


def curve_keys(vectors: np.ndarray, curves: int, dims: int, bits: int) -> np.ndarray:
    """Hilbert keys (n, curves). The grid spans three deviations of a direction's coordinates."""
    d = vectors.shape[1]
    r = np.random.default_rng(10)
    turned, unit = [], np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    while sum(t.shape[1] for t in turned) < curves * dims:
        rotation, _ = np.linalg.qr(r.normal(size=(d, d)))
        turned.append(vectors / unit @ rotation)
    flat = np.concatenate(turned, axis=1)[:, :curves * dims] * np.sqrt(d) / 6 + 0.5
    grid = 1 << bits
    out = np.empty((len(vectors), curves), np.int64)
    for c in range(curves):
        shifted = flat[:, c * dims:(c + 1) * dims] * 0.75 + 0.25 * r.random(dims)
        out[:, c] = hilbert(np.clip(shifted * grid, 0, grid - 1).astype(np.int64), bits)
    return out


def usable(vectors: DataFrame, width: int | None = None) -> DataFrame:
    """vec_id, embedding (doubles) of the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                       F.col("embedding").cast("array<double>").alias("embedding")).where(
        "vec_id is not null and embedding is not null")
    good = "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    v = v.where(f"{good} and exists(embedding, x -> x <> 0)")
    if width is None:
        width = v.select(F.mode(F.size("embedding"), True)).first()[0]
    return v.where(F.size("embedding") == (width or 0)).distinct()


def _stacked(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), -1)


def _placed(folded: DataFrame) -> DataFrame:
    """rep, vec (packed doubles), asks, k0.. (keys on the curves)."""
    schema = "rep long, asks boolean, vec binary, " + ", ".join(f"k{c} long" for c in range(CURVES))

    def make():
        def work(cols):
            values = cols["embedding"].flatten().to_numpy(zero_copy_only=False)
            n = len(cols["rep"])
            x = np.ascontiguousarray(values.reshape(n, -1)) if n else np.zeros((0, 1))
            keys = curve_keys(x, CURVES, DIMS, BITS)
            return {"rep": cols["rep"], "asks": cols["asks"], "vec": [r.tobytes() for r in x]} | {
                f"k{c}": keys[:, c] for c in range(CURVES)}

        return work

    return rows.map_batches(folded, schema, make)


def _blocked(placed: DataFrame, count: int) -> tuple[DataFrame, int]:
    """rep, asks, vec, b0.. (block numbers on the curves), blocks (the same, packed), and how many
    blocks a curve has. Only the blocks' bounds pass the driver."""
    blocks = max(1, -(-count // BLOCK))
    names = [f"k{c}" for c in range(CURVES)]
    probs = [i / blocks for i in range(1, blocks)]
    bounds = [np.array(b) for b in placed.approxQuantile(names, probs, 0.1 / blocks)] if probs else [np.zeros(0)] * CURVES

    def make():
        def work(cols):
            at = np.stack([np.searchsorted(bounds[c], cols[f"k{c}"].to_numpy(), side="right")
                           for c in range(CURVES)], axis=1).astype(np.int32)
            return {n: cols[n] for n in ("rep", "asks", "vec")} | {"blocks": [r.tobytes() for r in at]} | {
                f"b{c}": at[:, c] for c in range(CURVES)}

        return work

    schema = "rep long, asks boolean, vec binary, blocks binary, " + ", ".join(f"b{c} int" for c in range(CURVES))
    return rows.map_batches(placed, schema, make), blocks


def _top(score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest of each row."""
    if score.shape[1] <= k:
        return np.tile(np.arange(score.shape[1]), (len(score), 1))
    return np.argpartition(-score, k - 1, axis=1)[:, :k]


def _best_of(q: np.ndarray, v: np.ndarray, score: np.ndarray, rep: np.ndarray, floor: np.ndarray, k: int):
    """Rows of q and of v, and their products summed alike wherever a pair meets, of the k best of
    each row of q, and none below its floor; equal products go to the smaller rep. Pairs at -inf in
    score are out."""
    edge = floor
    if score.shape[1] > k:
        edge = np.maximum(edge, np.partition(score, score.shape[1] - k, axis=1)[:, -k])
    # a matrix product differs from the sum below by far less than this
    slack = 1e-12 * np.linalg.norm(q, axis=1) * np.linalg.norm(v, axis=1).max(initial=0)
    i, j = np.nonzero((score >= (edge - slack)[:, None]) & (score > -np.inf))
    exact = np.concatenate([np.zeros(0)] + [
        (q[i[a:a + 65536]] * v[j[a:a + 65536]]).sum(1) for a in range(0, len(i), 65536)])
    order = np.lexsort((rep[j], -exact, i))
    i, j, exact = i[order], j[order], exact[order]
    nth = np.arange(len(i)) - np.searchsorted(i, i)
    kept = (nth < k) & (exact >= floor[i])
    return i[kept], j[kept], exact[kept]


def window_for(blocked: DataFrame, blocks: int, k: int, sample: int = SAMPLE, aim: float = AIM) -> int:
    """The least window at which the sampled queries meet the aimed share of their neighbours."""
    some = blocked.where("asks").orderBy(F.xxhash64("rep"), "rep").limit(sample).collect()
    if not some or blocks == 1:
        return 0
    asked = _stacked([r.vec for r in some])
    own = np.array([np.frombuffer(r.blocks, np.int32) for r in some])

    def make():
        def work(cols):
            packed = cols["vec"].to_pylist()
            if not packed:
                return {"query": [], "score": [], "apart": []}
            score = asked @ _stacked(packed).T
            at = _top(score, k)
            here = np.array([np.frombuffer(b, np.int32) for b in cols["blocks"].to_pylist()])
            q = np.repeat(np.arange(len(asked)), at.shape[1])
            x = at.ravel()
            return {"query": q, "score": score[q, x], "apart": np.abs(own[q] - here[x]).min(1)}

        return work

    met = rows.map_batches(blocked, "query int, score double, apart int", make)
    best = Window.partitionBy("query").orderBy(F.desc("score"))
    apart = [r[0] for r in met.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).select("apart").collect()]
    return int(np.quantile(apart, aim, method="higher"))


def _score(group: dict, k: int, window: int) -> list[tuple]:
    """(query, rep, score) of pairs that meet first on this curve: the k best of each query, and
    none below what it has already."""
    asks = np.array(group["role"]) == 1
    if not asks.any() or asks.all():
        return []
    curve, rep = group["curve"][0], np.array(group["rep"])
    x, at = _stacked(group["vec"]), np.array([np.frombuffer(b, np.int32) for b in group["blocks"]])
    floor = np.array([-np.inf if f is None else f for f in group["floor"]])[asks]
    q, v = x[asks], x[~asks]
    qa, va = at[asks], at[~asks]
    out = []
    for s in range(0, len(q), 512):
        score = q[s:s + 512] @ v.T
        for c in range(curve):
            score[np.abs(qa[s:s + 512, None, c] - va[None, :, c]) <= window] = -np.inf
        i, j, exact = _best_of(q[s:s + 512], v, score, rep[~asks], floor[s:s + 512], k)
        out += zip(rep[asks][s + i].tolist(), rep[~asks][j].tolist(), exact.tolist())
    return out


def _met(blocked: DataFrame, asking: DataFrame, steps: list[int], window: int, k: int, parts: int) -> DataFrame:
    """Scores of queries with the blocks so many steps from their own, on every curve."""

    def on_curves(d):
        return d.select("*", F.posexplode(F.array(*[F.col(f"b{c}") for c in range(CURVES)])).alias("curve", "block"))

    base = on_curves(blocked).select(
        "rep", "vec", "blocks", F.lit(0).alias("role"), F.lit(None).cast("double").alias("floor"), "curve", "block",
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    asked = on_curves(asking).select(
        "rep", "vec", "blocks", F.lit(1).alias("role"), "floor", "curve",
        F.explode(F.transform(F.array(*map(F.lit, steps)), lambda step: F.col("block") + step)).alias("block"),
        F.pmod(F.xxhash64("rep"), F.lit(parts)).cast("int").alias("part"))
    return rows.map_groups(base.unionByName(asked), ["curve", "block", "part"], ["rep"],
                           "query long, rep long, score double", lambda g: _score(g, k, window))


def _best(met: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    return met.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def nearest(vectors: DataFrame, k: int = 20, asks: str = "vec_id % 20 = 0", window: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row that asks, but itself."""
    v = cut(usable(vectors))
    folded = cut(v.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.max(F.expr(asks)).alias("asks")))
    count = folded.count()
    blocked, blocks = _blocked(cut(_placed(folded)), count)
    blocked = cut(blocked)
    more = k + 1  # a query's own vector is among what it finds
    reach = window_for(blocked, blocks, more) if window is None else min(window, blocks - 1)
    asking = blocked.where("asks")
    parts = max(1, -(-asking.count() * (2 * reach + 1) // (blocks * ASKING)))
    first = cut(_best(_met(blocked, asking.withColumn("floor", F.lit(None).cast("double")), [0], reach, more, parts), more))
    found = first
    if reach:
        floors = first.groupBy("query").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
        waiting = asking.join(floors, F.col("rep") == F.col("query"), "left").withColumn(
            "floor", F.when(F.col("n") >= more, F.col("least"))).drop("query", "least", "n")
        steps = [s for s in range(-reach, reach + 1) if s]
        found = _best(first.unionByName(_met(blocked, waiting, steps, reach, more, parts)), more)
    # back from folds to rows: the least ids of what was found, for every row that asked
    members = v.join(folded.select("embedding", "rep"), "embedding").select("vec_id", "rep")
    least = members.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("vec_id"))).where(
        F.col("n") <= more).select("vec_id", "rep")
    who = members.where(asks).select(F.col("vec_id").alias("query_id"), F.col("rep").alias("query"))
    pairs = who.join(found.join(least, "rep").select("query", "vec_id", "score"), "query").where("query_id <> vec_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
