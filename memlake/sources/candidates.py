"""A persisted candidate index for the duplicate test: entries by cell, with sketches and vectors.

Layout: `<root>/anchors` holds the cells' anchors, fixed when the index is made;
`<root>/cells/batch=<label>/cell=<c>/*.parquet` holds id, sketch and embedding of the entries of a
cell. A batch is written whole under its own label, so writing it again replaces it.

A test reads the sketches of the cells its rows ask for, and then the vectors of the cells in which
sketches left a partner; both are partition filters, and columns not read stay on disk.
"""

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from memlake.constants import DUPLICATE_THRESHOLD
from memlake.functions import kernels, vectors
from memlake.operators import duplicates, vector_blocks as vb
from memlake.sources.scratch import cut, holds_files

_ROWS = (
    T.StructType()
    .add("id", T.LongType())
    .add("embedding", T.ArrayType(T.DoubleType()))
    .add("sketch", T.ArrayType(T.FloatType()))
    .add("batch", T.StringType())
    .add("cell", T.LongType())
)


def exists(spark: SparkSession, root: str) -> bool:
    return holds_files(spark, f"{root}/anchors")


def create(entries: DataFrame, root: str, cells: int | None = None) -> bool:
    """Choose the anchors from entries (id, embedding); False where none has a usable vector."""
    usable = entries.select("id", "embedding").where(vectors.has_length("embedding"))
    n, dim = vb.size_and_dim(usable)
    if not n:
        return False
    anchors = vb.pick_anchors(usable, n, dim, cells)
    entries.sparkSession.createDataFrame(
        [(i, a.tolist()) for i, a in enumerate(anchors)], "cell int, embedding array<double>"
    ).coalesce(1).write.mode("overwrite").parquet(f"{root}/anchors")
    return True


def prepare(store: DataFrame, root: str) -> None:
    """Index a store once, under the label `held`; a run that was cut short is taken up again."""
    spark = store.sparkSession
    done = holds_files(spark, f"{root}/cells/batch=held/_SUCCESS")
    if not done and (exists(spark, root) or create(store, root)):
        append(store, root, "held")


def add(entries: DataFrame, root: str, batch: str) -> None:
    """Append a batch; the first entries of all found an index whose store was empty."""
    spark = entries.sparkSession
    if not exists(spark, root):
        if not create(entries, root):
            return
        append(entries.limit(0), root, "held")
    append(entries, root, batch)


def anchors(spark: SparkSession, root: str) -> np.ndarray:
    """The anchors, of which an index has a bounded number."""
    table = vb.fetch(spark.read.parquet(f"{root}/anchors").orderBy("cell"))
    rows, _ = kernels.unit_rows(table.column("embedding"), len(table.column("embedding")[0]))
    return rows


def append(entries: DataFrame, root: str, batch: str) -> None:
    """Add entries (id, embedding) under a label; rows without a usable vector resemble nothing."""
    spark = entries.sparkSession
    rows = entries.where(vectors.has_length("embedding")).select(
        F.xxhash64("id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    placed = duplicates.sketch_cells(rows, DUPLICATE_THRESHOLD, anchors(spark, root), vectors=True)
    placed.where("home").drop("home").hint("rebalance", "cell").write.mode("overwrite").partitionBy(
        "cell").parquet(f"{root}/cells/batch={batch}")


def read(spark: SparkSession, root: str, cells: list[int], without_batch: str | None = None) -> DataFrame:
    """The entries of some cells; other cells' files are not opened."""
    path = f"{root}/cells"
    if not holds_files(spark, path):
        return spark.createDataFrame([], _ROWS).drop("batch")
    rows = spark.read.schema(_ROWS).option("basePath", path).parquet(path).where(F.col("cell").isin(cells))
    if without_batch is not None:
        rows = rows.where(F.col("batch") != without_batch)
    return rows.drop("batch")


def resembling(
    batch: DataFrame,
    root: str,
    threshold: float = DUPLICATE_THRESHOLD,
    *,
    without_batch: str | None = None,
    tile_rows: int = vb.TILE_ROWS,
    report: list | None = None,
) -> DataFrame:
    """Ids of `batch` rows (id, embedding) that an indexed entry resembles; exact.

    `report` gets the frames that were read: sketches, then vectors.
    """
    spark = batch.sparkSession
    batch = batch.select("id", "embedding").where(vectors.has_length("embedding"))
    if threshold >= 1 or not exists(spark, root):
        return batch.select("id").limit(0)
    known = anchors(spark, root)
    batch = duplicates.by_hash(batch)
    probes = cut(duplicates.sketch_cells(batch.drop("row"), threshold, known).drop("home"))

    def rows(of: DataFrame, *columns: str) -> DataFrame:
        asked = [r[0] for r in of.select("cell").distinct().collect()]  # at most one per anchor
        found = read(spark, root, asked, without_batch).select("id", *columns, "cell")
        if report is not None:
            report.append(found)
        return found

    near = duplicates.near_pairs(rows(probes, "sketch"), probes, threshold, tile_rows, known.shape[1])
    return duplicates.matching(rows(near, "embedding"), batch, near, threshold, known.shape[1], tile_rows)
