"""Usage logging."""

from pyspark.sql import DataFrame

from memlake.sources import usage_log


def log_usage(rows: DataFrame, rates: DataFrame, as_of=None) -> tuple[DataFrame, DataFrame]:
    """Price usage rows -> (rows to append, quarantined rows with a `fault`).

    Rates are a few configuration rows; Spark broadcasts them below its own size limit.
    """
    judged = usage_log.priced(usage_log.with_defaults(rows, as_of), rates)
    return judged.where("fault is null").drop("fault"), judged.where("fault is not null")
