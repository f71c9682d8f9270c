"""Near-duplicate tests and sequential admission.

`admit` gives the result of testing texts one by one, in order, against everything already
stored: a copy of a *rejected* text can still be admitted. That is a greedy choice over the
similarity graph, not its connected components, and no list of pairs is ever built: each
row carries at most its earliest open blocker from round to round.
"""

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from memlake.constants import DUPLICATE_THRESHOLD
from memlake.functions import kernels, vectors
from memlake.operators import vector_blocks as vb
from memlake.sources.scratch import cut

# Prefix rounds go on while one of them settles at least this share of what is left.
_PREFIX_GAIN = 0.2
_CHORD_MARGIN = 1e-6


def _band_cells(df, dim, bands):
    """Rows with their candidate cells: columns of `df`, `cell`, `home`."""
    ddl = ", ".join(f"{c} {vb.type_of(df, c)}" for c in df.columns) + ", cell bigint, home boolean"
    spark_schema, arrow_schema = vb.schema_of(df, ddl)
    count, bits = bands
    return df.mapInArrow(kernels.band_cells(count, bits, dim, 11, arrow_schema), spark_schema)


def chord_of(threshold: float) -> float:
    """How far apart unit vectors of that cosine similarity are."""
    return math.sqrt(max(0.0, 2 - 2 * threshold)) + _CHORD_MARGIN


def sketch_cells(df: DataFrame, threshold: float, anchors, vectors: bool = False) -> DataFrame:
    """Columns of `df`, the vector only on demand, with `sketch`, `cell` and `home`: a row for each
    cell that may hold a partner. Exact: no pair above the threshold is missed."""
    names = [c for c in df.columns if vectors or c != "embedding"]
    ddl = ", ".join(f"{c} {vb.type_of(df, c)}" for c in names) + ", sketch array<float>, cell bigint, home boolean"
    spark_schema, arrow_schema = vb.schema_of(df, ddl)
    run = kernels.nearest_cells(anchors, vb.pick_pivots(anchors), chord_of(threshold), arrow_schema)
    return df.mapInArrow(run, spark_schema)


def near_pairs(homes: DataFrame, probes: DataFrame, threshold: float, tile_rows: int = vb.TILE_ROWS,
               dim: int = 0) -> DataFrame:
    """cell, id, home: the rows of each cell that have a partner in it by their sketches.

    `homes` and `probes` hold id, sketch, cell and where order matters position. Ids and sketches
    alone move between cells; vectors follow for what this leaves. The dimension of the vectors tells
    how wide sketches are.
    """
    spark_schema, arrow_schema = vb.schema_of(homes, f"cell bigint, id {vb.type_of(homes, 'id')}, home boolean")
    near = kernels.tile_near(chord_of(threshold), arrow_schema)
    homes = homes.withColumn("at", F.col("cell"))
    sketch = 8 * max(vb.PIVOTS, dim // vb.PIVOT_DIMS)
    return cut(vb.tile_join(homes, probes, near, spark_schema, tile_rows, sketch).distinct())


def matching(homes: DataFrame, batch: DataFrame, near: DataFrame, threshold: float, dim: int,
             tile_rows: int = vb.TILE_ROWS) -> DataFrame:
    """Column `row` of `batch` (row, id, embedding) where a vector of `homes` (cell, id, embedding)
    resembles it; both are looked at only where `near` left them."""
    spark_schema, arrow_schema = vb.schema_of(batch, f"id {vb.type_of(batch, 'row')}")
    homes = homes.join(near.where("home").select("cell", "id"), ["cell", "id"], "left_semi")
    probes = batch.join(near.where("not home").select("cell", "id"), "id").select(
        F.col("row").alias("id"), "embedding", "cell")
    return vb.tile_join(
        homes, probes, kernels.tile_matches(threshold, dim, arrow_schema), spark_schema, tile_rows, 8 * dim
    ).distinct()


def by_hash(batch: DataFrame) -> DataFrame:
    """row, id (a long), embedding of a batch (id, embedding)."""
    return batch.select(F.col("id").alias("row"), F.xxhash64("id").alias("id"), "embedding")


def resembling(
    batch: DataFrame,
    store: DataFrame,
    threshold: float = DUPLICATE_THRESHOLD,
    *,
    bands: tuple[int, int] | None = None,
    broadcast_bytes: int = vb.BROADCAST_BYTES,
    tile_rows: int = vb.TILE_ROWS,
    cells: int | None = None,
) -> DataFrame:
    """Ids of `batch` rows (id, embedding) that some `store` row (embedding) resembles.

    A batch below `broadcast_bytes` is broadcast and the store is scanned where it lies,
    without a shuffle. A larger one meets the store cell by cell; a store row sits in one
    cell, and the batch row visits every cell the plane bounds allow, so nothing is
    missed. They meet as ids with sketches first, and vectors are sent only to the cells where
    the sketches leave a partner. `bands=(count, bits)` swaps the exact cells for sign-bit bands: faster on
    stores without clusters, and able to miss a pair, at every size.
    """
    batch = batch.select("id", "embedding").where(vectors.has_length("embedding"))
    if threshold >= 1:  # no similarity exceeds one
        return batch.select("id").limit(0)
    store = store.select("embedding").where(F.col("embedding").isNotNull())
    n, dim = vb.size_and_dim(batch)
    id_type = vb.type_of(batch, "id")
    spark_schema, arrow_schema = vb.schema_of(batch, f"id {id_type}")
    if n == 0:
        return batch.select("id")
    if not bands and n * dim * 8 <= broadcast_bytes:
        table = vb.fetch(batch)
        matrix, _ = kernels.unit_rows(table.column("embedding"), dim)
        shared = vb.share(batch, {"matrix": matrix, "id": kernels.sortable(table.column("id"))})
        return store.mapInArrow(
            kernels.scan_matches(shared, threshold, arrow_schema), spark_schema
        ).distinct()
    # A store row needs no id of its own; its vector spreads it over the chunks of a cell.
    store = store.select(F.xxhash64("embedding").alias("id"), "embedding")
    if not bands:
        anchors, batch = vb.pick_anchors(batch, n, dim, cells), by_hash(batch)
        homes = sketch_cells(store, threshold, anchors, vectors=True).where("home").drop("home")
        probes = sketch_cells(batch.drop("row"), threshold, anchors).drop("home")
        near = near_pairs(homes.drop("embedding"), probes, threshold, tile_rows, dim)
        return matching(homes.drop("sketch"), batch, near, threshold, dim, tile_rows)
    homes = _band_cells(store, dim, bands).where("home").drop("home")
    probes = _band_cells(batch, dim, bands).drop("home")
    return vb.tile_join(
        homes, probes, kernels.tile_matches(threshold, dim, arrow_schema), spark_schema, tile_rows, 8 * dim
    ).distinct()


def _first_copies(rows: DataFrame) -> DataFrame:
    """The earliest row of each exactly equal vector. The later ones can never be admitted."""
    first = rows.groupBy("embedding").agg(F.min(F.struct("position", "id")).alias("first"))
    return first.select("first.id", "first.position", "embedding")


def _admit_block(rows: DataFrame, dim: int, threshold: float) -> DataFrame:
    """Greedy admission of a block that the caller has bounded, in one task."""
    spark_schema, arrow_schema = vb.schema_of(
        rows, f"id {vb.type_of(rows, 'id')}, admitted boolean"
    )
    return rows.groupBy().applyInArrow(
        kernels.greedy_block(threshold, dim, arrow_schema), spark_schema
    )


def _blockers(homes, probes, dim, threshold, id_type, tile_rows):
    """Per probe: the earliest similar home row before it and after its floor, and how many."""
    spark_schema, arrow_schema = vb.schema_of(
        homes, f"id {id_type}, b_position bigint, b_id {id_type}, n bigint"
    )
    found = vb.tile_join(
        homes, probes, kernels.tile_blockers(threshold, dim, arrow_schema), spark_schema, tile_rows, 8 * dim
    )
    return found.groupBy("id").agg(
        F.min(F.struct("b_position", "b_id")).alias("b"), F.sum("n").alias("n")
    ).select("id", "b.b_position", "b.b_id", "n")


def _jumped(state: DataFrame) -> DataFrame:
    """Let open rows with one blocker point past it, while that is such a row too.

    The verdict of a row with one blocker is the opposite of its blocker's, so a chain of them
    hangs on its end: `flip` says whether a row's verdict is the opposite of what `b_id` gets.
    Pointers double, so the rounds grow with the logarithm of the longest chain.
    """
    state = cut(state.withColumn("flip", F.lit(True)))
    while True:
        lone = F.col("admitted").isNull() & (F.col("n") == 1)
        past = state.where(lone).select(
            F.col("id").alias("t_id"), F.col("b_id").alias("t_to"), F.col("flip").alias("t_flip"))
        jumps = F.col("t_id").isNotNull()
        state = cut(
            state.join(past, lone & (F.col("b_id") == F.col("t_id")), "left").select(
                "id", "admitted", "b_position", F.coalesce("t_to", "b_id").alias("b_id"), "n",
                F.when(jumps, F.col("flip") != F.col("t_flip")).otherwise(F.col("flip")).alias("flip"),
                jumps.alias("jumped"),
            )
        )
        if not state.where("jumped").limit(1).count():
            return state.drop("jumped")
        state = state.drop("jumped")


def _resolve(rows, n, dim, threshold, tile_rows, cells, bands):
    """Greedy admission of any number of rows (id, position, embedding), by rounds.

    Each round asks, for every row that has no known blocker, for its earliest similar
    row that is not rejected. None: admitted. An admitted one: rejected. A rejected one:
    ask again, after it. The earliest open row is decided in every round, so it ends.
    """
    id_type = vb.type_of(rows, "id")
    lowest_id = F.lit("").cast(id_type) if id_type == "string" else F.lit(-(1 << 63)).cast(id_type)
    lowest = F.lit(-(1 << 63)).cast("bigint")
    if bands:
        placed = cut(_band_cells(rows, dim, bands))
        homes, asks = placed.where("home").drop("home"), placed.drop("home")
    else:
        light = cut(sketch_cells(rows, threshold, vb.pick_anchors(rows, n, dim, cells)))
        near = near_pairs(light.where("home").drop("home"), light.drop("home"), threshold, tile_rows, dim)
        placed = cut(rows.join(near, "id").select(*rows.columns, "cell", "home"))
        homes, asks = placed.where("home").drop("home"), placed.where("not home").drop("home")
    # id, verdict (null while open), current blocker, blockers seen, whether to ask again
    state = rows.select(
        "id", F.lit(None).cast("boolean").alias("admitted"),
        lowest.alias("b_position"), lowest_id.alias("b_id"),
        F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("ask"),
    )
    while True:
        asking = state.where("ask").select(
            "id", F.col("b_position").alias("floor_position"), F.col("b_id").alias("floor_id")
        )
        alive = state.where("admitted is null or admitted").select("id")
        probes = asks.join(asking, "id")
        # Later rounds ask little: only homes in asked cells are looked at again.
        near = homes.join(probes.select("cell").distinct(), "cell", "left_semi")
        found = _blockers(
            near.join(alive, "id", "left_semi").select(*homes.columns), probes,
            dim, threshold, id_type, tile_rows,
        )
        found = found.select(
            "id", F.col("b_position").alias("f_position"), F.col("b_id").alias("f_id"),
            F.col("n").alias("f_n"),
        )
        asked = F.col("ask")
        state = cut(
            state.join(found, "id", "left").select(
                "id",
                F.when(asked & F.col("f_id").isNull(), True).otherwise(F.col("admitted")).alias("admitted"),
                F.when(asked, F.col("f_position")).otherwise(F.col("b_position")).alias("b_position"),
                F.when(asked, F.col("f_id")).otherwise(F.col("b_id")).alias("b_id"),
                F.when(asked, F.col("f_n")).otherwise(F.col("n")).alias("n"),
            )
        )
        # Follow known blockers as far as they are decided; only ids move here.
        state = _jumped(state)
        while True:
            verdicts = state.where("admitted is not null").select(
                F.col("id").alias("b_id"), F.col("admitted").alias("b_admitted")
            )
            open_ = F.col("admitted").isNull()
            blocked = F.col("b_admitted")
            state = cut(
                state.join(verdicts, "b_id", "left").select(
                    "id",
                    F.when(open_ & (F.col("n") == 1), F.col("flip") != blocked)
                    .when(open_ & blocked, False)
                    .otherwise(F.col("admitted")).alias("admitted"),
                    "b_position", "b_id", "n", "flip",
                    (open_ & ~blocked & (F.col("n") > 1)).alias("moved"),
                    (open_ & blocked.isNotNull() & (blocked | (F.col("n") == 1))).alias("settled"),
                )
            )
            settled, moved, left = state.agg(
                F.count_if("settled"), F.count_if(F.coalesce("moved", F.lit(False))),
                F.count_if(F.col("admitted").isNull()),
            ).first()
            if not settled or not left:
                break
            state = state.drop("moved", "settled")
        if not left:
            return state.select("id", "admitted")
        if not moved and not settled:
            raise RuntimeError("admission made no progress")
        state = state.withColumn("ask", F.coalesce("moved", F.lit(False))).drop("moved", "settled", "flip")


def admit(
    batch: DataFrame,
    store: DataFrame | None = None,
    threshold: float = DUPLICATE_THRESHOLD,
    *,
    bands: tuple[int, int] | None = None,
    broadcast_bytes: int = vb.BROADCAST_BYTES,
    tile_rows: int = vb.TILE_ROWS,
    cells: int | None = None,
    against: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Sequential admission of `batch` (id, position, embedding) -> (id, admitted).

    `position` is a long; order is (position, id). Null and zero vectors resemble nothing
    and are admitted. Steps, each exact: equal vectors are folded to their earliest row;
    rows like the store are rejected; then the earliest rows, as many as fit one tile, are
    settled and everything like them is rejected, for as long as that pays; what is left
    is settled by rounds over tiles. `against` may stand for the store: given rows (id,
    embedding), it returns the ids of those that the store resembles. With `bands` all rows go by rounds, whatever their number.
    """
    options = {"bands": bands, "broadcast_bytes": broadcast_bytes, "tile_rows": tile_rows,
               "cells": cells}
    batch = batch.select("id", "position", "embedding")
    if threshold >= 1:
        return batch.select("id", F.lit(True).alias("admitted"))
    rows = cut(_first_copies(batch.where(vectors.has_length("embedding"))))
    n, dim = vb.size_and_dim(rows)
    kept = []
    if n and store is not None:
        rows = cut(rows.join(resembling(rows, store, threshold, **options), "id", "left_anti"))
        n = rows.count()
    if n and against is not None:
        rows = cut(rows.join(against(rows.select("id", "embedding")), "id", "left_anti"))
        n = rows.count()
    if n and bands:
        kept.append(
            _resolve(rows, n, dim, threshold, tile_rows, cells, bands).where("admitted").select("id"))
        n = 0
    while n:
        head = rows.orderBy("position", "id").limit(tile_rows)
        settled = _admit_block(head, dim, threshold).where("admitted").select("id")
        if n <= tile_rows:
            kept.append(settled)
            break
        settled = cut(settled)
        kept.append(settled)
        table = vb.fetch(head.join(settled, "id", "left_semi").select("embedding"))
        shared = vb.share(rows, {"matrix": kernels.unit_rows(table.column("embedding"), dim)[0]})
        # What is admitted resembles itself, so the head leaves with its like.
        rows = cut(rows.mapInArrow(kernels.scan_unlike(shared, threshold), rows.schema))
        before, n = n, rows.count()
        if n and before - n - tile_rows < _PREFIX_GAIN * before and n > tile_rows:
            kept.append(
                _resolve(rows, n, dim, threshold, tile_rows, cells, bands)
                .where("admitted").select("id")
            )
            break
    admitted = batch.where(~vectors.has_length("embedding")).select("id")
    for part in kept:
        admitted = admitted.unionByName(part)
    return batch.select("id").join(
        admitted.withColumn("admitted", F.lit(True)), "id", "left"
    ).select("id", F.coalesce("admitted", F.lit(False)).alias("admitted"))
