"""Schemas of the stored tables and of the records that flow between jobs."""

from pyspark.sql import types as T

from memlake.constants import TAG_COLUMNS

_tags = T.ArrayType(T.StringType())

ENTRIES = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("raw_text", T.StringType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("entry_type", T.StringType(), False),
        *[T.StructField(name, _tags, False) for name in TAG_COLUMNS],
        T.StructField("source_client", T.StringType(), False),
        T.StructField("relevance_score", T.DoubleType(), False),
        T.StructField("created_at", T.TimestampType(), False),
    ]
)

USAGE = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("provider", T.StringType(), False),
        T.StructField("model", T.StringType(), False),
        T.StructField("operation", T.StringType(), False),
        T.StructField("prompt_tokens", T.IntegerType(), False),
        T.StructField("completion_tokens", T.IntegerType(), False),
        T.StructField("total_tokens", T.IntegerType(), False),
        T.StructField("estimated_cost", T.DecimalType(12, 8), False),
        T.StructField("created_at", T.TimestampType(), False),
    ]
)

REQUESTS = T.StructType(
    [
        T.StructField("request_id", T.StringType(), False),
        T.StructField("text", T.StringType()),
        T.StructField("source_client", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

RESPONSES = T.StructType(
    [
        T.StructField("request_id", T.StringType(), False),
        T.StructField("operation", T.StringType(), False),
        T.StructField("attempt", T.IntegerType(), False),
        T.StructField("raw", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("prompt_eval_count", T.IntegerType()),
        T.StructField("eval_count", T.IntegerType()),
        T.StructField("error", T.StringType()),
    ]
)

OUTCOMES = T.StructType(
    [
        T.StructField("request_id", T.StringType(), False),
        T.StructField("outcome", T.StringType(), False),
        T.StructField("stored", T.BooleanType(), False),
        T.StructField("id", T.StringType()),
        T.StructField("reason", T.StringType(), False),
    ]
)

TURNS = T.StructType(
    [
        T.StructField("conv_id", T.LongType(), False),
        T.StructField("turn", T.LongType(), False),
        T.StructField("role", T.StringType(), False),
        T.StructField("text", T.StringType()),
    ]
)

MESSAGES = T.ArrayType(
    T.StructType(
        [
            T.StructField("role", T.StringType()),
            T.StructField("content", T.StringType()),
        ]
    )
)

RATES = T.StructType(
    [
        T.StructField("rate_key", T.StringType(), False),
        T.StructField("prompt_per_1k", T.DecimalType(24, 15)),
        T.StructField("completion_per_1k", T.DecimalType(24, 15)),
    ]
)
