"""An approximate index that lives with its store: lists of entries by nearest centroid.

Layout: `<root>/centroids/version=<n>` holds the lists in force, with their centroids;
`<root>/lists/batch=<label>/list_id=<i>/*.parquet` holds the entries of a list. Entries are
appended under a label that replaces itself. A list that has become crowded is split: its rows
are written to two new lists, then a new version of the centroids names those instead of it. A list
id is never used again, so a reader keeps to the lists of the version it has read, whatever is
written meanwhile; `vacuum` removes rows of lists that no version in force names. One writer at a
time is assumed.
"""

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F

from memlake.constants import IVF_LISTS
from memlake.functions import kernels, vectors
from memlake.operators import vector_blocks as vb
from memlake.sources.scratch import cut, holds_files, names_in, remove

#: Columns kept beside id and embedding where the entries have them.
KEPT = ("entry_type", "projects", "created_at")
#: Most lists an index may have; their centroids go to every task.
MOST_LISTS = 16384


def train(entries: DataFrame, lists: int = IVF_LISTS, seed: int = 17) -> DataFrame:
    """list_id, embedding of centroids, by cosine k-means over all usable rows."""
    usable = entries.where(vectors.has_length("embedding"))
    rows = cut(usable.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features")))
    model = KMeans(k=lists, seed=seed, distanceMeasure="cosine", maxIter=10).fit(rows)
    return entries.sparkSession.createDataFrame(
        [(i, c.tolist()) for i, c in enumerate(model.clusterCenters())], "list_id int, embedding array<double>")


def versions(spark: SparkSession, root: str) -> list[int]:
    """Complete versions of the centroids, oldest first."""
    found = [int(n.split("=")[1]) for n in names_in(spark, f"{root}/centroids") if n.startswith("version=")]
    return sorted(v for v in found if holds_files(spark, f"{root}/centroids/version={v}/_SUCCESS"))


def centroids(spark: SparkSession, root: str, version: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(list ids, unit centroids) of a version, by default the newest."""
    version = versions(spark, root)[-1] if version is None else version
    rows = spark.read.parquet(f"{root}/centroids/version={version}").orderBy("list_id")
    table = vb.fetch(rows.limit(MOST_LISTS + 1))
    if table.num_rows > MOST_LISTS:
        raise ValueError(f"more than {MOST_LISTS} lists")
    units, _ = kernels.unit_rows(table.column("embedding"), len(table.column("embedding")[0]))
    return table.column("list_id").to_numpy(), units


def create(given: DataFrame, root: str) -> None:
    """Start an index with given centroids (list_id, embedding)."""
    given.select(F.col("list_id").cast("int"), F.col("embedding").cast("array<double>")).coalesce(1).write.mode(
        "overwrite").parquet(f"{root}/centroids/version=0")


def nearest(df: DataFrame, known: tuple[np.ndarray, np.ndarray], probes: int) -> DataFrame:
    """Rows with the list_id of each of their nearest centroids."""
    ddl = ", ".join(f"{c} {vb.type_of(df, c)}" for c in df.columns) + ", list_id int"
    spark_schema, arrow_schema = vb.schema_of(df, ddl)
    return df.mapInArrow(kernels.nearest_lists(known[1], probes, arrow_schema, known[0]), spark_schema)


def append(entries: DataFrame, root: str, batch: str) -> None:
    """Put entries into the lists in force; rows without a usable vector are in none."""
    rows = entries.where(vectors.has_length("embedding")).select(
        "id", "embedding", *[c for c in KEPT if c in entries.columns])
    _write(nearest(rows, centroids(entries.sparkSession, root), 1), root, batch)


def _write(rows: DataFrame, root: str, batch: str) -> None:
    rows.hint("rebalance", "list_id").write.mode("overwrite").partitionBy("list_id").parquet(
        f"{root}/lists/batch={batch}")


def read(spark: SparkSession, root: str, lists: list[int]) -> DataFrame:
    """The rows of some lists; other lists' files are not opened."""
    if not _written(spark, root):
        return spark.createDataFrame([], "id bigint, embedding array<double>, list_id int")
    rows = spark.read.option("basePath", f"{root}/lists").parquet(f"{root}/lists").drop("batch")
    return rows.where(F.col("list_id").isin([int(i) for i in lists]))


def sizes(spark: SparkSession, root: str) -> DataFrame:
    """list_id, rows of the lists in force that have any; no column of them is read."""
    ids, _ = centroids(spark, root)
    return read(spark, root, list(ids)).groupBy("list_id").agg(F.count(F.lit(1)).alias("rows"))


def split(spark: SparkSession, root: str, most_rows: int, rounds: int = 2) -> int:
    """Split every list of more than so many rows in two, and say how many were.

    Its row least like the centroid and the row least like that one (the smaller id of equals) start
    the new lists; then each takes the rows nearer to it, and its mean as the next centroid, for
    some rounds. All crowded lists are split in the same jobs. Lists of equal vectors stay whole.
    """
    ids, units = centroids(spark, root)
    crowded = [r.list_id for r in sizes(spark, root).where(F.col("rows") > most_rows).select("list_id").collect()]
    if not crowded:
        return 0
    rows = read(spark, root, crowded)
    far = _farthest(rows, dict(zip(ids.tolist(), units)))
    farther = _farthest(rows, far)
    pairs = {i: (far[i], farther[i]) for i in sorted(crowded) if far[i] @ farther[i] < 1 - 1e-9}
    if not pairs:
        return 0
    rows = rows.where(F.col("list_id").isin(list(pairs)))
    first = 1 + max([*ids.tolist(), *_written(spark, root)])
    child = {i: first + 2 * n for n, i in enumerate(pairs)}
    made = np.array([v for i in pairs for v in pairs[i]])
    for _ in range(rounds):
        sums = _sums(_dealt(rows, child, made, first), made.shape[1])
        made = np.array([_unit(sums.get(first + n, v), v) for n, v in enumerate(made)])
    version = versions(spark, root)[-1] + 1
    _write(_dealt(rows, child, made, first), root, f"split-{version:06d}")
    keep = [(int(i), u.tolist()) for i, u in zip(ids, units) if int(i) not in pairs]
    keep += [(first + n, v.tolist()) for n, v in enumerate(made)]
    spark.createDataFrame(keep, "list_id int, embedding array<double>").coalesce(1).write.mode("overwrite").parquet(
        f"{root}/centroids/version={version}")
    return len(pairs)


def vacuum(spark: SparkSession, root: str, keep_versions: int = 1) -> int:
    """Remove files of lists that none of the newest versions names; readers of older ones must
    be done. Returns how many lists' folders went."""
    known = versions(spark, root)
    live = {int(i) for v in known[-keep_versions:] for i in centroids(spark, root, v)[0]}
    gone = 0
    for batch in names_in(spark, f"{root}/lists"):
        for name in names_in(spark, f"{root}/lists/{batch}"):
            if name.startswith("list_id=") and int(name.split("=")[1]) not in live:
                remove(spark, f"{root}/lists/{batch}/{name}")
                gone += 1
    for v in known[:-keep_versions]:
        remove(spark, f"{root}/centroids/version={v}")
    return gone


def _written(spark: SparkSession, root: str) -> list[int]:
    """Ids of all lists that have files, whether in force or not."""
    return [int(n.split("=")[1]) for batch in names_in(spark, f"{root}/lists")
            for n in names_in(spark, f"{root}/lists/{batch}") if n.startswith("list_id=")]


def _unit(v: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
    unit = kernels.unit_vector(v)
    return otherwise if unit is None else unit


def _farthest(rows: DataFrame, known: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Unit vector of each list's row that is least like the list's given vector; ties to the least id."""
    spark_schema, arrow_schema = vb.schema_of(
        rows, f"list_id int, similarity double, id {vb.type_of(rows, 'id')}, unit array<double>")
    found = rows.select("list_id", "id", "embedding").mapInArrow(
        kernels.farthest_rows(known, arrow_schema), spark_schema)
    best = found.groupBy("list_id").agg(F.min(F.struct("similarity", "id", "unit")).alias("best")).collect()
    return {r.list_id: np.array(r.best.unit) for r in best}  # a row a crowded list


def _dealt(rows: DataFrame, child: dict[int, int], made: np.ndarray, first: int) -> DataFrame:
    """Rows with the id of the nearer one of their list's two new lists."""
    spark_schema, arrow_schema = vb.schema_of(
        rows, ", ".join(f"{c} {vb.type_of(rows, c)}" for c in rows.columns))
    return rows.mapInArrow(kernels.nearer_child(child, made, first, arrow_schema), spark_schema)


def _sums(rows: DataFrame, dim: int) -> dict[int, np.ndarray]:
    """Sum of each list's unit vectors; one row a list leaves a task."""
    spark_schema, arrow_schema = vb.schema_of(rows, "list_id int, total array<double>")
    sums = rows.select("list_id", "embedding").mapInArrow(kernels.unit_sums(dim, arrow_schema), spark_schema)
    at = sums.select("list_id", F.posexplode("total").alias("d", "x")).groupBy("list_id", "d").agg(F.sum("x").alias("x"))
    whole = at.groupBy("list_id").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("total"))
    return {r.list_id: np.array([p.x for p in r.total]) for r in whole.collect()}
