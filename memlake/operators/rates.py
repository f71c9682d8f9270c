"""Token rates and their join to usage rows."""

from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from memlake.functions.costs import estimated_cost
from memlake.schemas import RATES


def rates_table(spark: SparkSession, costs: dict) -> DataFrame:
    """{"provider/model" or "provider": {"prompt_per_1k", "completion_per_1k"}} as a table."""

    def rate(value):
        return None if value is None else Decimal(str(value)).quantize(Decimal(1).scaleb(-15))

    rows = [
        (key, rate((r or {}).get("prompt_per_1k")), rate((r or {}).get("completion_per_1k")))
        for key, r in costs.items()
    ]
    # A local relation: its exact size is known, so the join is a broadcast below the limit.
    return spark.createDataFrame(
        pa.Table.from_pylist([dict(zip(RATES.names, row)) for row in rows], to_arrow_schema(RATES)), RATES
    )


def with_cost(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """Add `estimated_cost`: the exact key's rate, else the provider's, else zero.

    An exact key with an empty rate prices at zero and does not fall back, so the choice
    looks at the key, not at the value. Null where the cost overflows its column.
    """

    def keyed(name):
        return rates.select(
            F.col("rate_key").alias(f"{name}_key"),
            F.col("prompt_per_1k").alias(f"{name}_prompt"),
            F.col("completion_per_1k").alias(f"{name}_completion"),
        )

    exact_key = F.concat_ws("/", "provider", "model")
    joined = usage.join(keyed("exact"), exact_key == F.col("exact_key"), "left").join(
        keyed("base"), F.col("provider") == F.col("base_key"), "left"
    )
    hit = F.col("exact_key").isNotNull()
    picked = joined.withColumn(
        "_prompt_rate", F.when(hit, F.col("exact_prompt")).otherwise(F.col("base_prompt"))
    ).withColumn(
        "_completion_rate",
        F.when(hit, F.col("exact_completion")).otherwise(F.col("base_completion")),
    )
    return picked.select(
        *[usage_column for usage_column in usage.columns if usage_column != "estimated_cost"],
        estimated_cost(
            "_prompt_rate", "_completion_rate", "prompt_tokens", "completion_tokens"
        ).alias("estimated_cost"),
    )
