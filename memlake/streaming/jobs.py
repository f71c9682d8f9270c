"""Streaming capture, usage log with daily roll-up, and the budget monitor.

Every micro-batch writes whole files under its own label, so a batch that is run again
after a failure replaces its output.
"""

from collections.abc import Callable
from datetime import datetime, timezone
from functools import partial
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from memlake.constants import ALERT_LEVELS, MONTHLY_BUDGET, STATS_DAYS
from memlake.plans.capture import capture
from memlake.plans.reports import budget_alert, token_stats
from memlake.plans.usage import log_usage
from memlake.sources import candidates, store, usage_log
from memlake.sources.scratch import cut, names_in


def _now():
    return datetime.now(timezone.utc)


def _label(batch_id: int) -> str:
    return f"stream-{batch_id:08d}"


def capture_stream(
    requests: DataFrame,
    responses: DataFrame | Callable[[DataFrame], DataFrame],
    store_root: str,
    out_root: str,
    index_root: str | None = None,
    **options,
) -> DataStreamWriter:
    """Capture requests as they arrive, each micro-batch against the store before it.

    With `index_root` the duplicate test reads a candidate index, of which only the cells that
    the micro-batch asks for, and every micro-batch adds its entries to it. An index that does not
    exist yet is made from the store, or from the first entries where the store is empty.

    `responses` is a static table, or a function from the micro-batch to its answers (for
    instance one that reads what the model stage has appended, or calls `run_model`); only
    the answers of the batch's own requests are looked at.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        label = _label(batch_id)
        spark = batch.sparkSession
        batch = cut(batch)  # evaluated once, however often it is looked at
        given = responses(batch) if callable(responses) else responses
        answers = given.join(batch.select("request_id"), "request_id", "left_semi")
        held = store.read(spark, store_root, without_batch=label)
        if index_root is None:
            done = capture(batch, answers, held, **options)
        else:
            candidates.prepare(held, index_root)
            known = partial(candidates.resembling, root=index_root, without_batch=label)
            done = capture(batch, answers, against=known, **options)
        store.append(done.entries, store_root, label)
        if index_root is not None:
            candidates.add(done.entries, index_root, label)
        done.outcomes.write.mode("overwrite").parquet(f"{out_root}/outcomes/batch={label}")
        done.usage.write.mode("overwrite").parquet(f"{out_root}/usage/batch={label}")
        done.quarantine.write.mode("overwrite").parquet(f"{out_root}/quarantine/batch={label}")

    return requests.writeStream.foreachBatch(run)


class Monitor(NamedTuple):
    """Where and how a usage stream reports: budget alerts and a token report per micro-batch."""

    root: str
    limit: float = MONTHLY_BUDGET
    days: int = STATS_DAYS
    clock: Callable = _now


def usage_stream(
    rows: DataFrame, rates: DataFrame, root: str, monitor: Monitor | None = None
) -> DataStreamWriter:
    """Price usage rows as they arrive and append them; bad rows go to `<root>-quarantine`.

    With `monitor` the micro-batch that has just been appended brings the months' totals up to
    date, adds alerts for the levels that a month has newly reached, and a fresh token report.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        good, bad = log_usage(cut(batch), rates)
        usage_log.append(good, root, _label(batch_id))
        bad.write.mode("overwrite").parquet(f"{root}-quarantine/batch={_label(batch_id)}")
        if monitor is not None:
            _watch(good, root, _label(batch_id), monitor)

    return rows.writeStream.foreachBatch(run)


def _watch(good: DataFrame, usage_root: str, label: str, monitor: Monitor) -> None:
    """Alerts (month, alert, monthly_spent, monthly_limit), each level of a month once.

    A month's total is the sum of what each micro-batch added to it, kept under its label; a
    micro-batch that runs again replaces its share and finds the alerts of the others.
    """
    spark = good.sparkSession
    months, alerts = f"{monitor.root}/months", f"{monitor.root}/alerts"
    good.groupBy(F.to_date(F.date_trunc("month", "created_at")).alias("month")).agg(
        F.sum("estimated_cost").alias("spent")).coalesce(1).write.mode("overwrite").parquet(f"{months}/batch={label}")
    totals = spark.read.parquet(months).groupBy("month").agg(F.sum("spent").cast("double").alias("monthly_spent"))
    levels = F.array(*[F.struct(F.lit(share).alias("share"), F.lit(name).alias("alert")) for name, share in ALERT_LEVELS])
    reached = totals.select("month", "monthly_spent", F.explode(levels).alias("level")).where(
        F.lit(monitor.limit > 0) & (F.col("monthly_spent") >= F.col("level.share") * F.lit(float(monitor.limit))))
    known = [p for p in names_in(spark, alerts) if p != f"batch={label}"]
    if known:
        told = spark.read.option("basePath", alerts).parquet(*[f"{alerts}/{p}" for p in known])
        reached = reached.withColumn("alert", F.col("level.alert")).join(told.select("month", "alert"), ["month", "alert"], "left_anti")
    reached.select(
        "month", F.col("level.alert").alias("alert"), "monthly_spent", F.lit(float(monitor.limit)).alias("monthly_limit")
    ).coalesce(1).write.mode("overwrite").parquet(f"{alerts}/batch={label}")
    token_stats(usage_log.read(spark, usage_root), monitor.clock(), monitor.days, monitor.limit).write.mode(
        "overwrite").parquet(f"{monitor.root}/reports/batch={label}")


def daily_stream(usage: DataFrame, root: str, lateness: str = "1 day") -> DataStreamWriter:
    """Daily totals of a priced usage stream; each micro-batch writes the days it changed.

    Rows later than the watermark are dropped, unlike in the batch report.
    """
    days = (
        usage.withWatermark("created_at", lateness)
        .groupBy(F.window("created_at", "1 day").alias("w"))
        .agg(
            F.sum(F.col("total_tokens").cast("bigint")).alias("tokens"),
            F.sum("estimated_cost").alias("cost"),
        )
        .select(F.to_date("w.start").alias("day"), "tokens", "cost")
    )

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{root}/{_label(batch_id)}"
        )

    return days.writeStream.outputMode("update").foreachBatch(run)


def daily_totals(spark, root: str) -> DataFrame:
    """The newest totals of each day from what `daily_stream` wrote."""
    newest = spark.read.parquet(f"{root}/*").groupBy("day").agg(
        F.max(F.struct("batch_id", "tokens", "cost")).alias("last")
    )
    return newest.select("day", "last.tokens", "last.cost")


def budget_monitor(
    rows: DataFrame,
    usage_root: str,
    out_root: str,
    limit: float = MONTHLY_BUDGET,
    days: int = STATS_DAYS,
    clock: Callable = _now,
    every: str = "60 seconds",
) -> DataStreamWriter:
    """At each trigger with new usage: alert rows and a fresh token report.

    The report reads the usage table, pruned to the days it needs. It never stops anything.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        as_of = clock()
        usage = usage_log.read(spark, usage_root)
        label = _label(batch_id)
        budget_alert(usage, as_of, limit).write.mode("overwrite").parquet(
            f"{out_root}/alerts/batch={label}"
        )
        token_stats(usage, as_of, days, limit).write.mode("overwrite").parquet(
            f"{out_root}/reports/batch={label}"
        )

    return rows.writeStream.trigger(processingTime=every).foreachBatch(run)
