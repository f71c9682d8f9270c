"""Store report, token report and budget."""

from pyspark.sql import DataFrame, Window, functions as F

from memlake.constants import MONTHLY_BUDGET, STATS_DAYS, TOP_TAGS
from memlake.functions.windows import lookback, lookback_start, moment, since


# ---- store report ---------------------------------------------------------------------


def store_sections(entries: DataFrame, as_of, days: int = STATS_DAYS) -> DataFrame:
    """Counts per (section, key) over the window: entry_type, topic, project; with rank.

    One scan and one shuffle serve all sections. Repeated tags in one entry count each
    time; empty lists vanish.
    """
    tag = lambda kind, column: F.transform(
        column, lambda x: F.struct(F.lit(kind).alias("section"), x.alias("key"))
    )
    marks = F.concat(
        F.array(F.struct(F.lit("entry_type").alias("section"), F.col("entry_type").alias("key"))),
        tag("topic", F.coalesce("topics", F.array().cast("array<string>"))),
        tag("project", F.coalesce("projects", F.array().cast("array<string>"))),
    )
    counts = (
        lookback(entries, as_of, max(1, days))
        .select("created_at", F.explode(marks).alias("mark"))
        .groupBy("mark.section", "mark.key")
        .agg(F.count("*").alias("cnt"), F.max("created_at").alias("most_recent"))
    )
    order = Window.partitionBy("section").orderBy(F.desc("cnt"), "key")
    ranked = counts.withColumn("rank", F.row_number().over(order))
    # The five entry types fit in the same limit, so only the top rows leave each task.
    return ranked.where(F.col("rank") <= TOP_TAGS)


def store_section(entries: DataFrame, section: str, as_of, days: int = STATS_DAYS) -> DataFrame:
    """One section as (key, cnt): every entry type present, or the top ten tags."""
    window = lookback(entries, as_of, max(1, days))
    if section == "entry_type":
        key = F.col("entry_type")
    else:
        key = F.explode({"topic": "topics", "project": "projects"}[section])
    counts = window.select(key.alias(section)).groupBy(section).agg(F.count("*").alias("cnt"))
    ordered = counts.orderBy(F.desc("cnt"), section)
    return ordered if section == "entry_type" else ordered.limit(TOP_TAGS)


def store_summary(entries: DataFrame, as_of, days: int = STATS_DAYS) -> DataFrame:
    """total_in_window, most_recent (within the window) and total_all_time.

    The all-time count needs no column, so it is a separate read of row counts only.
    """
    window = lookback(entries, as_of, max(1, days)).agg(
        F.count("*").alias("total_in_window"), F.max("created_at").alias("most_recent")
    )
    total = entries.agg(F.count("*").alias("total_all_time"))
    return _one_row(window, total)


def _one_row(*one_row_frames: DataFrame) -> DataFrame:
    """Fold one-row results with different columns into one row."""
    stacked = one_row_frames[0]
    for frame in one_row_frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def store_stats(entries: DataFrame, as_of, days: int = STATS_DAYS) -> DataFrame:
    """The whole store report as one row; ordered lists of (key, cnt)."""
    sections = store_sections(entries, as_of, days)

    def listed(section):
        rows = F.collect_list(
            F.when(F.col("section") == section, F.struct("rank", "key", "cnt"))
        )
        return F.transform(
            F.array_sort(rows), lambda r: F.struct(r["key"].alias("key"), r["cnt"].alias("cnt"))
        )

    is_type = F.col("section") == "entry_type"
    report = sections.agg(
        F.coalesce(F.sum(F.when(is_type, F.col("cnt"))), F.lit(0)).alias("total_in_window"),
        F.max(F.when(is_type, F.col("most_recent"))).alias("most_recent"),
        listed("entry_type").alias("by_entry_type"),
        listed("topic").alias("top_topics"),
        listed("project").alias("top_projects"),
    )
    return _one_row(report, entries.agg(F.count("*").alias("total_all_time")))


# ---- token report ---------------------------------------------------------------------

_SETS = {"summary": (), "by_provider": ("provider",), "by_model": ("provider", "model"),
         "by_operation": ("operation",), "daily": ("day",)}


def usage_grain(usage: DataFrame, as_of, days: int) -> DataFrame:
    """Sums per provider, model, operation, day and window flag: the base of every section.

    Only rows of the longest window needed are read; what leaves the first aggregate is
    as small as the number of distinct combinations.
    """
    start = lookback_start(usage, as_of, days)
    month = F.date_trunc("month", moment(usage, as_of)).cast(usage.schema["created_at"].dataType)
    return (
        since(usage, F.least(start, month))
        .groupBy(
            "provider", "model", "operation",
            F.to_date("created_at").alias("day"),
            (F.col("created_at") >= start).alias("in_window"),
        )
        .agg(*_totals())
    )


def _totals():
    """Sums over usage rows; zero when there are none."""
    zero = lambda source, name: F.coalesce(
        F.sum(F.col(source).cast("bigint")), F.lit(0)
    ).alias(name)
    return (
        zero("prompt_tokens", "prompt"),
        zero("completion_tokens", "completion"),
        zero("total_tokens", "tokens"),
        F.coalesce(F.sum("estimated_cost"), F.lit(0)).cast("decimal(38,8)").alias("cost"),
        F.count("*").alias("requests"),
    )


def _sums():
    """Sums over rows that are sums already."""
    zero = lambda name: F.coalesce(F.sum(name), F.lit(0)).alias(name)
    return (
        *[zero(c) for c in ("prompt", "completion", "tokens")],
        F.coalesce(F.sum("cost"), F.lit(0)).cast("decimal(38,8)").alias("cost"),
        zero("requests"),
    )


def token_sections(usage: DataFrame, as_of, days: int = STATS_DAYS) -> DataFrame:
    """All windowed sections in one frame: section, provider, model, operation, day, sums.

    `days` is taken as given, also zero and negative.
    """
    grain = usage_grain(usage, as_of, days).where("in_window")
    keys = ("provider", "model", "operation", "day")
    sets = [[F.col(c) for c in names] for names in _SETS.values()]
    rolled = grain.groupingSets(sets, *keys).agg(F.grouping_id().alias("gid"), *_sums())
    section = None
    for name, names in _SETS.items():
        gid = sum(1 << (len(keys) - 1 - i) for i, key in enumerate(keys) if key not in names)
        test = F.col("gid") == gid
        section = F.when(test, name) if section is None else section.when(test, name)
    return rolled.select(section.alias("section"), *keys, "prompt", "completion", "tokens",
                         "cost", "requests")


def _windowed(usage, as_of, days, *keys):
    keys = [F.to_date("created_at").alias(k) if k == "day" else k for k in keys]
    return lookback(usage, as_of, days).groupBy(*keys).agg(*_totals())


def token_summary(usage: DataFrame, as_of, days: int = STATS_DAYS) -> DataFrame:
    return _windowed(usage, as_of, days).select(
        F.col("tokens").alias("total_tokens"), F.col("cost").alias("total_cost"),
        F.col("requests").alias("total_requests"),
    )


def tokens_by_provider(usage: DataFrame, as_of, days: int = STATS_DAYS) -> DataFrame:
    return (
        _windowed(usage, as_of, days, "provider")
        .select("provider", "tokens", "cost", "requests")
        .orderBy(F.desc("tokens"), "provider")
    )


def tokens_by_model(usage: DataFrame, as_of, days: int = STATS_DAYS) -> DataFrame:
    return (
        _windowed(usage, as_of, days, "provider", "model")
        .select("provider", "model", "prompt", "completion", F.col("tokens").alias("total"),
                "cost", "requests")
        .orderBy(F.desc("total"), "provider", "model")
    )


def tokens_by_operation(usage: DataFrame, as_of, days: int = STATS_DAYS) -> DataFrame:
    return (
        _windowed(usage, as_of, days, "operation")
        .select("operation", "tokens", "requests")
        .orderBy(F.desc("tokens"), "operation")
    )


def tokens_daily(usage: DataFrame, as_of, days: int = STATS_DAYS) -> DataFrame:
    """Days without rows are absent."""
    return _windowed(usage, as_of, days, "day").select("day", "tokens", "cost").orderBy("day")


def period_to_date(usage: DataFrame, as_of, unit: str) -> DataFrame:
    """Tokens and cost since the start of the day or month of `as_of`; no upper bound."""
    start = F.date_trunc(unit, moment(usage, as_of)).cast(usage.schema["created_at"].dataType)
    return since(usage, start).agg(
        F.coalesce(F.sum(F.col("total_tokens").cast("bigint")), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum("estimated_cost"), F.lit(0)).cast("decimal(38,8)").alias("cost"),
    )


def budget_columns(spent, limit: float) -> list:
    """monthly_limit, monthly_spent, percent_used, status; rounded first, then compared."""
    spent = spent.cast("double")
    if limit > 0:
        percent = F.bround(spent / F.lit(float(limit)) * 100, 1)
        status = F.when(percent >= 100, "exceeded").when(percent >= 80, "warning").otherwise("ok")
    else:
        percent, status = F.lit(0.0), F.lit("no_budget")
    return [
        F.lit(float(limit)).alias("monthly_limit"), spent.alias("monthly_spent"),
        percent.alias("percent_used"), status.alias("status"),
    ]


def budget_status(usage: DataFrame, as_of, limit: float = MONTHLY_BUDGET) -> DataFrame:
    return period_to_date(usage, as_of, "month").select(*budget_columns(F.col("cost"), limit))


def budget_alert(usage: DataFrame, as_of, limit: float = MONTHLY_BUDGET) -> DataFrame:
    """One row when the unrounded ratio reaches 0.8 or 1.0, none otherwise."""
    ratio = F.col("cost").cast("double") / F.lit(float(limit))
    alerts = period_to_date(usage, as_of, "month").select(
        F.lit(float(limit)).alias("monthly_limit"),
        F.col("cost").cast("double").alias("monthly_spent"),
        (F.when(ratio >= 1.0, "exceeded").when(ratio >= 0.8, "warning") if limit > 0
         else F.lit(None).cast("string")).alias("alert"),
    )
    return alerts.where("alert is not null")


def token_stats(
    usage: DataFrame, as_of, days: int = STATS_DAYS, budget: float = MONTHLY_BUDGET
) -> DataFrame:
    """The whole token report as one row of structs and ordered lists, from one scan."""
    grain = usage_grain(usage, as_of, days)
    month = F.to_date(F.date_trunc("month", moment(usage, as_of)))
    today = F.to_date(moment(usage, as_of))
    keys = ("provider", "model", "operation", "day")
    # Second, small aggregates: the grain is already reduced to distinct combinations.
    inside = F.col("in_window")
    flagged = grain.select(
        *[F.when(inside, F.col(k)).alias(k) for k in keys], "in_window",
        F.col("day").alias("_day"), "prompt", "completion", "tokens", "cost", "requests",
    )
    sets = [[F.col("in_window"), *[F.col(k) for k in names]] for names in _SETS.values()]
    rolled = flagged.groupingSets(sets, "in_window", *keys).agg(
        F.grouping_id().alias("gid"), *_sums(),
        *[
            F.coalesce(F.sum(F.when(F.col("_day") >= start, F.col(value))), F.lit(0)).alias(f"{name}_{value}")
            for name, start in (("today", today), ("month", month))
            for value in ("tokens", "cost")
        ],
    )
    section = None
    for name, names in _SETS.items():
        gid = sum(1 << (len(keys) - 1 - i) for i, key in enumerate(keys) if key not in names)
        test = F.col("gid") == gid
        section = F.when(test, name) if section is None else section.when(test, name)
    rows = rolled.withColumn("section", section)
    cost = F.col("cost").cast("double").alias("cost")

    def listed(name, order, *fields):
        picked = F.when(
            (F.col("section") == name) & inside, F.struct(*order, F.struct(*fields).alias("row"))
        )
        return F.transform(F.array_sort(F.collect_list(picked)), lambda r: r["row"]).alias(name)

    most = (-F.col("tokens")).alias("_order")
    summary = F.col("section") == "summary"

    def total(column):
        return F.coalesce(F.sum(F.when(summary, F.col(column))), F.lit(0))

    def window_total(column):
        return F.coalesce(F.sum(F.when(summary & inside, F.col(column))), F.lit(0))

    report = rows.agg(
        F.struct(
            window_total("tokens").alias("total_tokens"),
            window_total("cost").cast("double").alias("total_cost"),
            window_total("requests").alias("total_requests"),
        ).alias("summary"),
        F.struct(total("today_tokens").alias("tokens"),
                 total("today_cost").cast("double").alias("cost")).alias("today"),
        F.struct(total("month_tokens").alias("tokens"),
                 total("month_cost").cast("double").alias("cost")).alias("month"),
        listed("by_provider", [most, F.col("provider")], "provider", "tokens", cost, "requests"),
        listed("by_model", [most, F.col("provider"), F.col("model")], "provider", "model",
               "prompt", "completion", F.col("tokens").alias("total"), cost, "requests"),
        listed("by_operation", [most, F.col("operation")], "operation", "tokens", "requests"),
        listed("daily", [F.col("day")], F.col("day").cast("string").alias("day"), "tokens", cost),
    )
    return report.withColumn("budget", F.struct(*budget_columns(F.col("month.cost"), budget)))
