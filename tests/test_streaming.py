from datetime import datetime, timedelta

from pyspark.sql import functions as F

import __spark_entry__ as entry
from memlake.functions.windows import as_timestamp, since
from memlake.operators.rates import rates_table
from memlake.plans import reports
from memlake.plans.capture import capture
from memlake.plans.usage import log_usage
from memlake.sources import batches, store, usage_log
from memlake.streaming import jobs
from test_capture import GOOD, META, case

NOW = datetime(2024, 3, 15, 12)
RATES = {"p": {"prompt_per_1k": 100.0, "completion_per_1k": 50.0}}


def files(spark, df, path, column, values):
    """One file per value, in order of arrival."""
    for value in values:
        df.where(F.col(column) == value).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def run(writer, checkpoint):
    query = writer.option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination()


def usage_rows(spark):
    rows = [(f"u{i}", "p", "m", 10 + i, 1, NOW - timedelta(hours=40 - 4 * i), i // 4) for i in range(12)]
    return spark.createDataFrame(
        rows, "id string, provider string, model string, prompt_tokens int, completion_tokens int, created_at timestamp, part int")


def test_usage_log_daily_totals_and_monitor(spark, tmp_path):
    df = usage_rows(spark)
    rates = rates_table(spark, RATES)
    stream = files(spark, df, tmp_path / "in", "part", (0, 1, 2))
    root = str(tmp_path / "usage")
    run(jobs.usage_stream(stream.drop("part"), rates, root), tmp_path / "c1")
    logged = usage_log.read(spark, root)
    batch, _ = log_usage(df.drop("part"), rates)
    key = ("id", "total_tokens", "estimated_cost")
    assert sorted(logged.select(*key).collect()) == sorted(batch.select(*key).collect())

    good, _ = log_usage(stream.drop("part"), rates)
    run(jobs.daily_stream(good, str(tmp_path / "daily")), tmp_path / "c2")
    totals = sorted(tuple(r) for r in jobs.daily_totals(spark, str(tmp_path / "daily")).collect())
    assert totals == sorted(tuple(r) for r in batch.groupBy(F.to_date("created_at").alias("day")).agg(
        F.sum("total_tokens"), F.sum("estimated_cost")).collect())

    out = str(tmp_path / "monitor")
    run(jobs.budget_monitor(stream, root, out, limit=20.0, clock=lambda: NOW), tmp_path / "c3")
    assert spark.read.parquet(f"{out}/reports").count() == 3
    month = reports.period_to_date(logged, NOW, "month").first().cost
    assert {r.month.cost for r in spark.read.parquet(f"{out}/reports").collect()} == {float(month)}
    assert spark.read.parquet(f"{out}/alerts").count() == (3 if month >= 16 else 0)


def test_streamed_capture_equals_one_batch(spark, tmp_path):
    rows = [
        ("a", GOOD, META, [1.0, 0.0, 0.0]), ("b", GOOD, META, [0.99, 0.14, 0.0]), ("c", GOOD, META, [0.0, 1.0, 0.0]),
        ("d", GOOD, META, [0.96, 0.28, 0.0]), ("e", '{"label": "too_short"}', META, [0.0, 0.0, 1.0]), ("f", GOOD, META, [0.0, 0.01, 1.0]),
    ]
    asked, answers = case(spark, rows)
    stream = files(spark, asked, tmp_path / "in", "request_id", "abcdef")
    root, out = str(tmp_path / "store"), str(tmp_path / "out")
    run(jobs.capture_stream(stream, answers, root, out), tmp_path / "c")
    streamed = {(r.request_id, r.outcome, r.id) for r in spark.read.parquet(f"{out}/outcomes").collect()}
    whole = {(r.request_id, r.outcome, r.id) for r in capture(asked, answers).outcomes.collect()}
    assert streamed == whole
    assert store.read(spark, root).count() == sum(o == "stored" for _, o, _ in whole)


def test_a_repeated_micro_batch_replaces_its_output(spark, tmp_path):
    asked, answers = case(spark, [("a", GOOD, META, [1.0, 0.0]), ("b", GOOD, META, [0.0, 1.0])])
    root, out = str(tmp_path / "store"), str(tmp_path / "out")
    for checkpoint in ("c1", "c2"):  # a fresh checkpoint runs batch 0 once more
        asked.write.mode("overwrite").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(asked.schema).parquet(str(tmp_path / "in"))
        run(jobs.capture_stream(stream, answers, root, out), tmp_path / checkpoint)
        assert store.read(spark, root).count() == 2
        assert spark.read.parquet(f"{out}/outcomes").where("stored").count() == 2


def test_alerts_are_written_once_per_level(spark, tmp_path):
    rows = [("a", 100, datetime(2024, 3, 3), 0), ("b", 30, datetime(2024, 2, 3), 0), ("c", 65, datetime(2024, 3, 4), 1),
            ("d", 10, datetime(2024, 3, 5), 2), ("e", 30, datetime(2024, 3, 6), 3), ("f", 500, datetime(2024, 3, 7), 4)]
    df = spark.createDataFrame(
        [(i, "p", "m", n, 0, at, part) for i, n, at, part in rows],
        "id string, provider string, model string, prompt_tokens int, completion_tokens int, created_at timestamp, part int")
    root, out = str(tmp_path / "usage"), str(tmp_path / "monitor")
    monitor = jobs.Monitor(out, limit=20.0, clock=lambda: NOW)  # 100 per 1000 tokens
    first = files(spark, df, tmp_path / "in0", "part", (0,)).drop("part")
    run(jobs.usage_stream(first, rates_table(spark, RATES), root, monitor), tmp_path / "c0")
    assert spark.read.parquet(f"{out}/alerts").count() == 0
    stream = files(spark, df, tmp_path / "in", "part", (0, 1, 2, 3, 4)).drop("part")
    run(jobs.usage_stream(stream, rates_table(spark, RATES), root, monitor), tmp_path / "c1")  # batch 0 runs again
    got = sorted((r.batch, str(r.month), r.alert, r.monthly_spent) for r in spark.read.parquet(f"{out}/alerts").collect())
    assert got == [("stream-00000001", "2024-03-01", "warning", 16.5), ("stream-00000003", "2024-03-01", "exceeded", 20.5)]
    assert spark.read.parquet(f"{out}/reports").count() == 5
    assert usage_log.read(spark, root).count() == 6
    free = jobs.Monitor(str(tmp_path / "free"), limit=0.0, clock=lambda: NOW)
    run(jobs.usage_stream(stream, rates_table(spark, RATES), str(tmp_path / "u2"), free), tmp_path / "c2")
    assert spark.read.parquet(f"{free.root}/alerts").count() == 0


def test_compaction_beside_readers(spark, tmp_path):
    root = str(tmp_path / "usage")
    rows, _ = log_usage(usage_rows(spark), rates_table(spark, RATES))
    for part in (0, 1, 2):
        usage_log.append(rows.where(F.col("id").isin([f"u{i}" for i in range(4 * part, 4 * part + 4)])), root, f"b{part}")
    ids = lambda df: sorted(r.id for r in df.collect())
    want = ids(rows)
    reader = usage_log.read(spark, root)  # from before the switch
    usage_log.append(rows.where("id = 'u0'"), root, "compact-00000001")  # cut short: it has no record
    assert ids(usage_log.read(spark, root)) == want
    label = usage_log.compact(spark, root, keep=1)
    assert label == "compact-00000002" and batches.live(spark, root) == ["b2", label]
    assert ids(usage_log.read(spark, root)) == ids(reader) == want
    usage_log.append(rows.where("id = 'u3'").withColumn("id", F.lit("new")), root, "b3")
    again = usage_log.compact(spark, root)
    assert batches.live(spark, root) == [again] and usage_log.compact(spark, root) is None
    assert batches.retire(spark, root) == 6 and batches.labels(spark, root) == [again]
    assert ids(usage_log.read(spark, root)) == sorted([*want, "new"])
    assert len(usage_log.read(spark, root).inputFiles()) <= 4


def test_a_table_of_several_files_is_streamed_whole(spark, tmp_path):
    rows = spark.range(40).selectExpr("id as doc_id", "concat('t', id) as text")
    rows.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    (part,) = (tmp_path / "one").glob("part-*.parquet")
    part.rename(tmp_path / "labels.parquet")
    for name in ("documents", "labels"):  # a folder, and a single file
        got = str(tmp_path / f"got-{name}")
        entry._run(spark, entry._stream(spark, str(tmp_path), name).writeStream.format("parquet").option("path", got))
        assert sorted(spark.read.parquet(got).collect()) == sorted(rows.collect())


def test_a_store_of_many_days_is_few_files_and_still_pruned(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = spark.range(600).selectExpr(
        "cast(id as string) as id", "'t' as raw_text", "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id * 4) as created_at")
    store.append(store.with_defaults(rows), root, "one")
    held = store.read(spark, root)
    assert held.count() == 600 and held.select("created_date").distinct().count() == 100
    assert len(held.inputFiles()) <= 8  # four months
    late = since(held, as_timestamp("2024-04-01 12:00:00"))
    assert sorted(int(r.id) for r in late.collect()) == list(range(549, 600))
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(created_month" in plan and "GreaterThanOrEqual(created_at" in plan
