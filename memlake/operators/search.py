"""Vector top-k: one query, many queries, and the approximate list index."""

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from memlake.constants import IVF_LISTS
from memlake.functions import kernels, vectors
from memlake.operators import vector_blocks as vb
from memlake.sources import list_index
from memlake.sources.scratch import cut


def narrowed(entries: DataFrame, entry_type: str | None = None, project: str | None = None):
    """Optional type and project filters; an empty text means no filter."""
    if entry_type:
        entries = entries.where(F.col("entry_type") == entry_type)
    if project:
        entries = entries.where(F.array_contains("projects", project))
    return entries


def top_k(entries: DataFrame, vector, k: int, entry_type=None, project=None) -> DataFrame:
    """The k rows nearest to one vector, with `similarity_score`; null vectors come last."""
    scored = narrowed(entries, entry_type, project).withColumn(
        "similarity_score", vectors.similarity_to(vector)
    )
    return scored.drop("embedding").orderBy(F.desc_nulls_last("similarity_score"), "id").limit(k)


def _ask(part: DataFrame, dim: int) -> dict:
    """A bounded part of the queries as one broadcast payload."""
    table = vb.fetch(part)
    matrix, usable = kernels.unit_rows(table.column("embedding"), dim)
    ask = {
        "matrix": matrix,
        "usable": usable,
        "query_id": table.column("query_id").to_numpy(),
        "limits": table.column("limit").to_numpy().astype(np.int64),
    }
    return ask | kernels.filters_of(table)


def _ranked(hits: DataFrame) -> DataFrame:
    """Merge the local bests of each query; every task sent at most `limit` rows of it."""
    by_score = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("similarity_score"), "id")
    ranked = hits.withColumn("rank", F.row_number().over(by_score))
    return ranked.where(F.col("rank") <= F.col("limit"))


def _payload(queries: DataFrame) -> tuple[int, int, int]:
    """Number of queries, their dimension, and about how many bytes they take in memory."""
    texts = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in queries.columns if c != "embedding"]
    n, dim, rest = queries.agg(
        F.count("*"), F.max(F.size("embedding")), F.sum(sum(texts, F.lit(16 * len(texts))).cast("bigint"))).first()
    return n, dim or 0, n * (dim or 0) * 8 + (rest or 0)


def top_k_many(
    entries: DataFrame, queries: DataFrame, *, broadcast_bytes: int = vb.BROADCAST_BYTES,
    tile_rows: int = vb.TILE_ROWS, cells: int | None = None, report: list | None = None,
) -> DataFrame:
    """Exact top-k of many queries -> (query_id, id, similarity_score, rank).

    `queries` holds query_id, embedding, limit and optionally entry_type, project,
    visible_until (only entries created by then) and exclude_id. Queries whose counted size is
    below `broadcast_bytes` are broadcast: entries are scanned where they lie, and only k rows
    per query leave a task. More queries meet the entries tile by tile, see `_by_cells`.
    """
    n, dim, size = _payload(queries)
    columns = ["id", "embedding"]
    for column, name in (("entry_type", "entry_type"), ("project", "projects"), ("visible_until", "created_at")):
        if column in queries.columns:
            columns.append(name)
    entries = entries.select(*columns)
    spark_schema, arrow_schema = vb.schema_of(
        entries, f"query_id {vb.type_of(queries, 'query_id')}, id {vb.type_of(entries, 'id')}, "
        "similarity_score double, limit int")
    if size > broadcast_bytes:
        found = _by_cells(entries, queries, dim, (spark_schema, arrow_schema), tile_rows, cells, report)
    else:
        shared = vb.share(queries, _ask(queries, dim))
        found = _ranked(entries.mapInArrow(kernels.scan_top_k(shared, arrow_schema), spark_schema))
    return found.drop("limit")


def _by_cells(entries, queries, dim, schemas, tile_rows, cells, report):
    """Queries and entries meet in tiles of a cell; queries never pass the driver.

    Entries lie in the cell of their nearest anchor, and each cell knows between which angles to
    its anchor they lie. A query visits its most promising cell first, then the next two, four and so on.
    From its k best so far it has a floor, and goes only to cells that can hold something as good;
    a tile returns nothing below the floor. `report` gets the visits of each round.
    """
    count = entries.count()
    usable = entries.where(vectors.has_length("embedding")).select("id", "embedding")
    anchors = vb.pick_anchors(usable, count, dim, cells)
    anchors = anchors.reshape(-1, dim)
    ddl = ", ".join(f"{c} {vb.type_of(entries, c)}" for c in entries.columns) + ", cell bigint, angle double"
    spark_schema, arrow_schema = vb.schema_of(entries, ddl)
    placed = cut(entries.mapInArrow(kernels.home_cells(anchors, dim, arrow_schema), spark_schema))
    rings = np.full((len(anchors), 2), np.nan)
    for cell, least, most in placed.where("cell >= 0").groupBy("cell").agg(F.min("angle"), F.max("angle")).collect():
        rings[cell] = least, most  # one row a cell
    placed = placed.drop("angle")
    queries = cut(queries)
    best, state = None, queries.withColumn("floor", F.lit(None).cast("double"))
    first = 0
    while first <= len(anchors):
        last = 2 * first + 1
        ddl = ", ".join(f"{c} {vb.type_of(state, c)}" for c in state.columns) + ", cell bigint"
        spark_schema, arrow_schema = vb.schema_of(state, ddl)
        visits = kernels.next_cells(anchors, rings, dim, first, last, arrow_schema)
        asked = cut(state.mapInArrow(visits, spark_schema).withColumn("id", F.col("query_id")))
        visited = asked.count()
        if report is not None:
            report.append(visited)
        if not visited:
            break
        hits = vb.tile_join(placed, asked, kernels.tile_top_k(dim, schemas[1], complete=True), schemas[0], tile_rows,
                            8 * dim)
        best = cut(_ranked(hits if best is None else hits.unionByName(best.drop("rank"))))
        floors = best.groupBy("query_id").agg(
            F.min(F.coalesce("similarity_score", F.lit(-2.0))).alias("least"), (F.count("*") >= F.max("limit")).alias("full"))
        state = queries.join(floors, "query_id", "left").withColumn("floor", F.when(F.col("full"), F.col("least"))).drop(
            "least", "full")
        first = last
    if best is None:
        return queries.sparkSession.createDataFrame([], schemas[0].add("rank", "int"))
    return best


def build_lists(entries: DataFrame, path: str, lists: int = IVF_LISTS, seed: int = 17) -> None:
    """Approximate index: entries by their nearest centroid under `path`. Centroids come from
    cosine k-means over all usable rows; every row is put in a list."""
    list_index.create(list_index.train(entries, lists, seed), path)
    list_index.append(entries, path, "built")


def ann_top_k(
    index_path: str, queries: DataFrame, probes: int = 10, *, tile_rows: int = vb.TILE_ROWS
) -> DataFrame:
    """Approximate top-k: only the `probes` lists nearest to each query are compared.

    `queries` is as for `top_k_many`. Filters may leave fewer than k rows, and null vectors do
    not appear. Only probed lists are read; a crowded list is cut into more tiles.
    """
    spark = queries.sparkSession
    known = list_index.centroids(spark, index_path)
    wanted = ("query_id", "embedding", "limit", "entry_type", "project", "visible_until", "exclude_id")
    queries = queries.select(*[c for c in wanted if c in queries.columns])
    asked = list_index.nearest(queries, known, probes).withColumn("id", F.col("query_id"))
    asked = cut(asked.withColumn("cell", F.col("list_id").cast("bigint")).drop("list_id"))
    probed = [r[0] for r in asked.select("cell").distinct().collect()]  # at most one per list
    rows = list_index.read(spark, index_path, probed)
    needed = [c for c, name in (("entry_type", "entry_type"), ("projects", "project"), ("created_at", "visible_until"))
              if name in queries.columns]
    rows = rows.select("id", "embedding", *needed, F.col("list_id").cast("bigint").alias("cell"))
    spark_schema, arrow_schema = vb.schema_of(
        rows,
        f"query_id {vb.type_of(queries, 'query_id')}, id {vb.type_of(rows, 'id')}, "
        "similarity_score double, limit int",
    )
    hits = vb.tile_join(
        rows, asked, kernels.tile_top_k(dim=known[1].shape[1], schema=arrow_schema), spark_schema, tile_rows,
        8 * known[1].shape[1],
    )
    return _ranked(hits).drop("limit")
