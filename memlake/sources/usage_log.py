"""The token usage table: defaults, pricing, checks, append and read."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from memlake.constants import MAX_MODEL, MAX_OPERATION, MAX_PROVIDER
from memlake.operators.rates import with_cost
from memlake.schemas import USAGE
from memlake.sources import batches

_STORED = T.StructType(list(USAGE.fields)).add("batch", T.StringType()).add(
    "created_date", T.DateType()
)


def with_defaults(rows: DataFrame, as_of=None) -> DataFrame:
    """Missing columns take their default. An explicit null token count stays null."""
    now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    absent = {
        "id": F.uuid(), "operation": F.lit("chat"), "prompt_tokens": F.lit(0),
        "completion_tokens": F.lit(0), "created_at": now,
    }
    for name, default in absent.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, default)
    return rows.drop("total_tokens", "estimated_cost")


def priced(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """Usage rows with generated total, exact cost, and a `fault` where they cannot be stored."""
    total = F.try_add(F.col("prompt_tokens").cast("int"), F.col("completion_tokens").cast("int"))
    out = with_cost(rows.withColumn("total_tokens", total), rates)
    fault = (
        F.when(F.col("provider").isNull() | F.col("model").isNull(), "provider or model is null")
        .when(F.col("operation").isNull(), "operation is null")
        .when(F.length("provider") > MAX_PROVIDER, "provider too long")
        .when(F.length("model") > MAX_MODEL, "model too long")
        .when(F.length("operation") > MAX_OPERATION, "operation too long")
        .when(
            F.col("prompt_tokens").isNull() | F.col("completion_tokens").isNull(),
            "token count is null",
        )
        .when(F.col("total_tokens").isNull(), "token count overflows")
        .when(F.col("estimated_cost").isNull(), "cost overflows")
    )
    return out.withColumn("fault", fault)


def append(usage: DataFrame, root: str, batch: str) -> None:
    (
        usage.select(
            *[F.col(f.name).cast(f.dataType).alias(f.name) for f in USAGE.fields],
            F.to_date("created_at").alias("created_date"),
        )
        .hint("rebalance", "created_date")
        .write.mode("overwrite")
        .partitionBy("created_date")
        .parquet(f"{root}/batch={batch}")
    )


def _rows(spark: SparkSession, root: str) -> DataFrame:
    paths = batches.paths(spark, root)
    if not paths:
        return spark.createDataFrame([], _STORED)
    return spark.read.schema(_STORED).option("basePath", root).parquet(*paths)


def read(spark: SparkSession, root: str) -> DataFrame:
    """The log; empty when nothing was appended yet."""
    return _rows(spark, root).drop("batch")


def compact(spark: SparkSession, root: str, keep: int = 0) -> str | None:
    """Rewrite batches as one whose days are whole files, beside running readers (`batches`)."""
    return batches.compact(spark, root, _rows(spark, root), lambda rows, label: append(rows, root, label), keep)
