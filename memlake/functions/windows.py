"""Report windows. `as_of` is always given; nothing reads the clock."""

from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame, functions as F, types as T


def as_timestamp(as_of) -> Column:
    """A datetime, ISO text or Column as a timestamp Column; zoned datetimes are taken in UTC."""
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, datetime):
        if as_of.tzinfo is not None:
            as_of = as_of.astimezone(timezone.utc).replace(tzinfo=None)
        as_of = as_of.isoformat(sep=" ")
    elif isinstance(as_of, date):
        as_of = as_of.isoformat()
    return F.lit(as_of).cast("timestamp_ntz")


def moment(df: DataFrame, as_of, column: str = "created_at") -> Column:
    """`as_of` in the type of the compared column, so that the filter reaches the scan."""
    return as_timestamp(as_of).cast(df.schema[column].dataType)


def lookback_start(df: DataFrame, as_of, days: int, column: str = "created_at") -> Column:
    return moment(df, as_of, column) - F.make_dt_interval(F.lit(int(days)))


def since(df: DataFrame, start: Column, column: str = "created_at") -> DataFrame:
    """Rows from `start` on, with no upper bound; prunes date and month partitions where there are any."""
    out = df.where(F.col(column) >= start)
    if "created_date" in df.columns and isinstance(df.schema["created_date"].dataType, T.DateType):
        out = out.where(F.col("created_date") >= F.to_date(start))
    if "created_month" in df.columns and isinstance(df.schema["created_month"].dataType, T.DateType):
        out = out.where(F.col("created_month") >= F.trunc(F.to_date(start), "month"))
    return out


def lookback(df: DataFrame, as_of, days: int, column: str = "created_at") -> DataFrame:
    return since(df, lookback_start(df, as_of, days, column), column)
