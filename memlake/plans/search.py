"""Search and recency listings."""

from pyspark.sql import DataFrame, functions as F, types as T

from memlake.constants import RECENT_DAYS, RECENT_LIMIT, SEARCH_LIMIT, SEARCH_LIMIT_CAP
from memlake.functions.text import iso_timestamp
from memlake.functions.windows import lookback
from memlake.operators.search import ann_top_k, narrowed, top_k, top_k_many

RESULT_COLUMNS = (
    "id", "raw_text", "entry_type", "topics", "projects", "people", "action_items",
    "source_client", "relevance_score", "created_at",
)


def result_columns(entries: DataFrame) -> list[str]:
    return [c for c in RESULT_COLUMNS if c in entries.columns]


def search(
    entries: DataFrame,
    vector,
    limit: int = SEARCH_LIMIT,
    entry_type: str | None = None,
    project: str | None = None,
) -> DataFrame:
    """Entries ranked by cosine similarity to one vector; at most 50."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    k = min(limit, SEARCH_LIMIT_CAP)
    shown = entries.select(*result_columns(entries), "embedding")
    return top_k(shown, vector, k, entry_type, project)


def search_many(entries: DataFrame, queries: DataFrame, **options) -> DataFrame:
    """`search` for a table of queries: query_id, rank, result columns, similarity_score.

    A missing `limit` column means 10; limits above 50 are cut to 50. Texts are fetched
    for the hits only, in a second scan that leaves the vectors alone.
    """
    return _shown(top_k_many(entries, _limited(queries), **options), entries)


def ann_search(entries: DataFrame, index_root: str, queries: DataFrame, probes: int = 10, **options) -> DataFrame:
    """`search_many` by an index of lists that is kept beside the store (`sources.list_index`)."""
    return _shown(ann_top_k(index_root, _limited(queries), probes, **options), entries)


def _limited(queries: DataFrame) -> DataFrame:
    limit = F.coalesce("limit", F.lit(SEARCH_LIMIT)) if "limit" in queries.columns else F.lit(SEARCH_LIMIT)
    return queries.withColumn("limit", F.least(limit.cast("int"), F.lit(SEARCH_LIMIT_CAP)))


def _shown(hits: DataFrame, entries: DataFrame) -> DataFrame:
    shown = entries.select(*result_columns(entries))
    return hits.join(shown, "id").select(
        "query_id", "rank", *result_columns(entries), "similarity_score"
    )


def recent(
    entries: DataFrame,
    as_of,
    days: int = RECENT_DAYS,
    entry_type: str | None = None,
    project: str | None = None,
    limit: int = RECENT_LIMIT,
) -> DataFrame:
    """Entries of the last `days` days (at least one), newest first."""
    kept = narrowed(lookback(entries, as_of, max(1, days)), entry_type, project)
    return (
        kept.select(*result_columns(entries)).orderBy(F.desc("created_at"), "id").limit(limit)
    )


def json_safe(df: DataFrame) -> DataFrame:
    """Timestamps as ISO text, doubles rounded to 4 places, `id` as text."""

    def safe(field: T.StructField):
        column = F.col(field.name)
        if isinstance(field.dataType, T.TimestampType):
            column = iso_timestamp(column)
        elif isinstance(field.dataType, T.TimestampNTZType):
            column = iso_timestamp(column, zoned=False)
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = F.bround(column.cast("double"), 4)
        elif field.name == "id":
            column = column.cast("string")
        return column.alias(field.name)

    return df.select(*[safe(f) for f in df.schema.fields])


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text per row, in JSON-safe values; write it with `.write.text(path)`."""
    return json_safe(df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
