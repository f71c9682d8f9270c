"""The entries table: defaults, checks, append, snapshot read and purge.

Layout: `<root>/batch=<label>/created_month=<first day>/*.parquet`, rows in order of time, so that a
month is a folder to prune by and its days are ranges of a file; a folder a day would be as many
files as days, however few rows they hold. A batch is written whole under
its own label, so writing it again replaces it and nothing else. `compact` joins batches.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from memlake.constants import (
    DEFAULT_SOURCE, ENTRY_TYPES, MAX_SOURCE_CLIENT, TAG_COLUMNS,
)
from memlake.schemas import ENTRIES
from memlake.sources import batches

_STORED = (
    T.StructType(list(ENTRIES.fields))
    .add("batch", T.StringType())
    .add("created_date", T.DateType())
    .add("created_month", T.DateType())
)


def with_defaults(entries: DataFrame, as_of=None) -> DataFrame:
    """Fill missing columns and nulls with the table's defaults, in table order."""
    no_tags = F.array().cast("array<string>")
    now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    defaults = {
        "id": F.uuid(),
        "entry_type": F.lit("observation"),
        **{name: no_tags for name in TAG_COLUMNS},
        "source_client": F.lit(DEFAULT_SOURCE),
        "relevance_score": F.lit(0.0),
        "created_at": now,
    }

    def column(field):
        default = defaults.get(field.name, F.lit(None))
        if field.name not in entries.columns:
            return default.cast(field.dataType).alias(field.name)
        given = F.col(field.name).cast(field.dataType)
        return F.coalesce(given, default).alias(field.name)

    return entries.select(*[column(f) for f in ENTRIES.fields])


def entry_fault(dim: int | None = None, text: str = "raw_text"):
    """Why a row may not be stored, or null."""
    fault = (
        F.when(F.col(text).isNull(), "raw_text is null")
        .when(~F.col("entry_type").isin(*ENTRY_TYPES), "unknown entry_type")
        .when(F.length("source_client") > MAX_SOURCE_CLIENT, "source_client too long")
        .when(F.forall("embedding", lambda x: x == 0), "vector without length")
        .when(F.exists("embedding", lambda x: x.isNull() | F.isnan(x)), "vector with gaps")
        .when(F.exists("embedding", lambda x: F.abs(x) == float("inf")), "infinite vector")
    )
    if dim is not None:
        fault = fault.when(F.size("embedding") != dim, "wrong vector dimension")
    return fault


def checked(entries: DataFrame, dim: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, quarantined rows with a `fault`)."""
    judged = entries.withColumn("fault", entry_fault(dim))
    return judged.where("fault is null").drop("fault"), judged.where("fault is not null")


def append(entries: DataFrame, root: str, batch: str) -> None:
    """Write one batch of checked entries; months are spread over files by their size."""
    day = F.to_date("created_at")
    (
        entries.select(*ENTRIES.fieldNames(), day.alias("created_date"), F.trunc(day, "month").alias("created_month"))
        .hint("rebalance", "created_month")
        .sortWithinPartitions("created_month", "created_at")
        .write.mode("overwrite")
        .partitionBy("created_month")
        .parquet(f"{root}/batch={batch}")
    )


def _rows(spark: SparkSession, root: str, without_batch: str | None = None) -> DataFrame:
    paths = batches.paths(spark, root, without_batch)
    if not paths:
        return spark.createDataFrame([], _STORED)
    return spark.read.schema(_STORED).option("basePath", root).parquet(*paths)


def read(spark: SparkSession, root: str, without_batch: str | None = None) -> DataFrame:
    """Snapshot of the store, with `created_date` and `created_month` for pruning; empty when nothing
    is stored."""
    return _rows(spark, root, without_batch).drop("batch")


def compact(spark: SparkSession, root: str, keep: int = 0) -> str | None:
    """Rewrite batches as one whose months are whole files, beside running readers (`batches`)."""
    return batches.compact(spark, root, _rows(spark, root), lambda rows, label: append(rows, root, label), keep)


def purge(entries: DataFrame, keys: DataFrame, on: str = "id") -> DataFrame:
    """The store without the rows named by `keys` (distinct ids or source clients).

    Write the result to a new root; files in use are never edited.
    """
    return entries.join(keys.select(on).distinct(), on, "left_anti")
