"""Queries over the test tables, and the SQL each is compared with."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

from memlake.constants import ENTRY_TYPES  # noqa: E402
from memlake.functions.text import iso_timestamp  # noqa: E402
from memlake.functions.vectors import hashed_vector  # noqa: E402
from memlake.operators import responses as answers  # noqa: E402
from memlake.operators import search as topk  # noqa: E402
from memlake.operators import stand_ins, turns as pick  # noqa: E402
from memlake.operators.duplicates import admit, resembling  # noqa: E402
from memlake.operators.rates import rates_table  # noqa: E402
from memlake.plans import capture as cap  # noqa: E402
from memlake.plans import chats, reports, search  # noqa: E402
from memlake.plans.usage import log_usage  # noqa: E402
from memlake.sources import batches, list_index, store, usage_log, views  # noqa: E402
from memlake.sources.scratch import cut, is_folder, new_path  # noqa: E402
from memlake.streaming import jobs  # noqa: E402
from oracle_queries import ORACLES  # noqa: E402

try:  # the training-data operators are an optional part
    from memlake.llm import queries as llm
except ImportError:
    llm = None
try:
    import corpus_pipeline
except ImportError:
    corpus_pipeline = None

ENTRIES_AS_OF = "2024-01-15 00:00:00"
USAGE_AS_OF = "2024-02-08 12:00:00"
DAYS = 14
BUDGET = 50.0


def _vector(spark, sf_dir, vec_id=0):
    rows = views.table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id)
    return rows.select("embedding").first()[0]


def _shown(df: DataFrame) -> DataFrame:
    """Lists and times as text, scores to 6 places, for comparison across engines."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f.name)
        if kind == "array<string>":
            c = F.array_join(c, "|")
        elif kind == "timestamp_ntz":
            c = iso_timestamp(c, zoned=False)
        elif kind == "timestamp":
            c = iso_timestamp(c)
        elif kind == "date":
            c = c.cast("string")
        elif kind.startswith("decimal") or kind == "double":
            c = F.round(c.cast("double"), 6)
        out.append(c.alias(f.name))
    return df.select(*out)


def _usage(spark, sf_dir) -> DataFrame:
    good, _ = log_usage(views.v_usage(spark, sf_dir), rates_table(spark, views.RATES))
    return good


def search_topk(spark, sf_dir, **kw):
    return _shown(search.search(views.v_entries(spark, sf_dir), _vector(spark, sf_dir), **kw))


def _asks(spark, sf_dir):
    return views.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), "embedding"
    )


def search_many(spark, sf_dir):
    asks = _asks(spark, sf_dir).withColumn("limit", F.lit(3))
    return _shown(
        search.search_many(views.v_entries(spark, sf_dir), asks)
        .select("query_id", "rank", "id", "entry_type", "similarity_score")
    )


def search_many_filtered(spark, sf_dir):
    """Every entry searches its own type and its document's project."""
    own = views.v_entries(spark, sf_dir).select("id", "entry_type")
    source = views.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("project")
    )
    asks = own.join(source, "id").withColumnRenamed("id", "query_id").join(
        _asks(spark, sf_dir), "query_id"
    ).withColumn("limit", F.lit(5))
    return _shown(
        search.search_many(views.v_entries(spark, sf_dir), asks)
        .select("query_id", "rank", "id", "similarity_score")
    )


def _lists(spark, sf_dir):
    """An index whose centroids are the first vector of each label; all entries in two batches."""
    root, e = new_path(spark, "lists"), views.table(spark, sf_dir, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    list_index.create(first.withColumnRenamed("label", "list_id"), root)
    entries = views.v_entries(spark, sf_dir)
    early = F.col("created_at") < F.lit(ENTRIES_AS_OF).cast("timestamp_ntz")
    list_index.append(entries.where(early), root, "early")
    list_index.append(entries.where(~early), root, "late")
    return root


def _ann_asks(spark, sf_dir):
    """Every vector asks for the entries other than itself up to ten days after its own."""
    own = views.v_entries(spark, sf_dir).select(
        F.col("id").alias("query_id"), (F.col("created_at") + F.make_dt_interval(F.lit(10))).alias("visible_until"))
    return _asks(spark, sf_dir).join(own, "query_id").withColumn("exclude_id", F.col("query_id")).withColumn(
        "limit", F.lit(3))


def ann_search(spark, sf_dir):
    """The four nearest of ten lists are probed."""
    found = search.ann_search(
        views.v_entries(spark, sf_dir), _lists(spark, sf_dir), _ann_asks(spark, sf_dir), probes=4)
    return _shown(found.drop("raw_text"))


def ann_search_split(spark, sf_dir):
    """The same after lists of more than a tenth of all entries were split in two, and files of
    the former lists removed."""
    root, entries = _lists(spark, sf_dir), views.v_entries(spark, sf_dir)
    list_index.split(spark, root, entries.count() // 10, rounds=0)
    list_index.vacuum(spark, root)
    return _shown(search.ann_search(entries, root, _ann_asks(spark, sf_dir), probes=4).drop("raw_text"))


def ann_recall(spark, sf_dir):
    """Share of the exact best three that are found, by number of probed lists."""
    root, out = _lists(spark, sf_dir), None
    asks = _asks(spark, sf_dir).withColumn("limit", F.lit(3))
    exact = cut(topk.top_k_many(views.v_entries(spark, sf_dir), asks)).select(
        "query_id", "id", F.lit(1).alias("found"))
    for probes in (1, 2, 4, 8):
        hits = topk.ann_top_k(root, asks, probes).join(exact, ["query_id", "id"])
        part = exact.agg(F.count("*").alias("wanted")).join(hits.agg(F.count("*").alias("found")))
        part = part.select(F.lit(probes).alias("probes"), "wanted", "found", (F.col("found") / F.col("wanted")).alias("recall"))
        out = part if out is None else out.unionByName(part)
    return _shown(out)


def ann_search_all_lists(spark, sf_dir):
    """Probing every list must give the exact ranking."""
    path = new_path(spark, "lists")
    topk.build_lists(views.v_entries(spark, sf_dir), path, lists=10)
    asks = _asks(spark, sf_dir).withColumn("limit", F.lit(3))
    return _shown(topk.ann_top_k(path, asks, probes=10))


def json_output(spark, sf_dir):
    rows = search.search(views.v_entries(spark, sf_dir), _vector(spark, sf_dir, 1))
    return _shown(search.json_safe(rows))


def store_stats(spark, sf_dir):
    report = reports.store_stats(views.v_entries(spark, sf_dir), ENTRIES_AS_OF, DAYS)
    pairs = lambda c: F.array_join(
        F.transform(c, lambda p: F.concat_ws("=", p["key"], p["cnt"].cast("string"))), "|"
    ).alias(c)
    return _shown(report.select(
        "total_in_window", "most_recent", "total_all_time",
        pairs("by_entry_type"), pairs("top_topics"), pairs("top_projects"),
    ))


def token_report(spark, sf_dir):
    """The one-row report, its lists as text."""
    report = reports.token_stats(_usage(spark, sf_dir), USAGE_AS_OF, DAYS, BUDGET)

    def lines(name, *fields):
        return F.array_join(
            F.transform(name, lambda r: F.concat_ws("=", *[
                F.round(r[f] * 1000, 0).cast("bigint").cast("string") if f == "cost"
                else r[f].cast("string") for f in fields])), "|",
        ).alias(name)

    return _shown(report.select(
        "summary.total_tokens", "summary.total_cost", "summary.total_requests",
        F.col("today.tokens").alias("today_tokens"), F.col("today.cost").alias("today_cost"),
        F.col("month.tokens").alias("month_tokens"), F.col("month.cost").alias("month_cost"),
        lines("by_provider", "provider", "tokens", "cost", "requests"),
        lines("by_model", "provider", "model", "prompt", "completion", "total", "requests"),
        lines("by_operation", "operation", "tokens", "requests"),
        lines("daily", "day", "tokens"),
        "budget.monthly_limit", "budget.monthly_spent", "budget.percent_used", "budget.status",
    ))


def token_sections(spark, sf_dir):
    return _shown(reports.token_sections(_usage(spark, sf_dir), USAGE_AS_OF, DAYS))


def _gate(spark, sf_dir):
    return answers.resolve_attempts(views.v_responses(spark, sf_dir))


def parse_gate(spark, sf_dir):
    return _shown(answers.parse_attempts(views.v_responses(spark, sf_dir)).select(
        "request_id", "attempt", "status", F.col("gate.label").alias("label"),
        F.col("gate.confidence").alias("confidence"), F.col("gate.reason").alias("reason")))


def parse_metadata(spark, sf_dir):
    meta = answers.metadata_results(answers.resolve_attempts(views.v_extracts(spark, sf_dir)))
    return _shown(meta.drop("attempt"))


def dup_against_store(spark, sf_dir):
    rows = views.v_vec_dup(spark, sf_dir)
    return resembling(rows.where("variant > 0"), rows.where("variant = 0"))


def dedupe_batch(spark, sf_dir):
    return admit(views.v_vec_dup(spark, sf_dir).withColumn("position", F.col("id")))


def dup_against_store_cells(spark, sf_dir):
    """The same by cells and tiles, as a batch beyond the broadcast size goes."""
    rows = views.v_vec_dup(spark, sf_dir)
    return resembling(rows.where("variant > 0"), rows.where("variant = 0"),
                      broadcast_bytes=1, cells=4, tile_rows=128)


def dedupe_batch_tiled(spark, sf_dir):
    """The same by rounds over tiles, as a batch beyond one tile goes."""
    return admit(views.v_vec_dup(spark, sf_dir).withColumn("position", F.col("id")),
                 cells=4, tile_rows=128)


def search_many_parts(spark, sf_dir):
    """The same by tiles of cells, as queries beyond the broadcast size go."""
    asks = _asks(spark, sf_dir).withColumn("limit", F.lit(3))
    return _shown(
        search.search_many(views.v_entries(spark, sf_dir), asks, broadcast_bytes=64 * 8 * 200, cells=8,
                           tile_rows=512)
        .select("query_id", "rank", "id", "entry_type", "similarity_score")
    )


def search_many_filtered_parts(spark, sf_dir):
    """Every entry searches its own type among entries other than itself, by tiles of cells."""
    own = views.v_entries(spark, sf_dir).select(
        F.col("id").alias("query_id"), "embedding", F.lit(5).alias("limit"), "entry_type", F.col("id").alias("exclude_id"),
        (F.col("created_at") + F.make_dt_interval(F.lit(10))).alias("visible_until"))
    return _shown(
        search.search_many(views.v_entries(spark, sf_dir), own, broadcast_bytes=1, cells=8, tile_rows=512)
        .select("query_id", "rank", "id", "similarity_score")
    )


def usage_cost_exact(spark, sf_dir):
    """Costs to all 8 places."""
    return _usage(spark, sf_dir).select("id", "total_tokens", F.col("estimated_cost").cast("string").alias("estimated_cost"))


def _chat_vectors(spark, sf_dir):
    return views.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("conv_id"), "embedding"
    )


def memory_blocks(spark, sf_dir):
    turns = views.table(spark, sf_dir, "conversations")
    asks = chats.asking_turns(turns, _chat_vectors(spark, sf_dir))
    return chats.memory_blocks(asks, views.v_entries(spark, sf_dir))


def augment_chats(spark, sf_dir):
    turns = views.table(spark, sf_dir, "conversations")
    return chats.augment_chats(
        turns, _chat_vectors(spark, sf_dir), views.v_entries(spark, sf_dir),
        preamble="Memories:\n\n", divider="\n\n--- Memories ---\n",
    )


def chat_hook(spark, sf_dir):
    """Each chat's message is captured first; then its memories come from the store that holds it,
    once with and once without its own entry."""
    turns = views.table(spark, sf_dir, "conversations")
    vectors = _chat_vectors(spark, sf_dir).withColumn("embedding", F.transform(
        "embedding", lambda x, i: (x.cast("double") + F.when(i == 0, 0.45).otherwise(0.0)).cast("float")))
    requests = chats.capture_turns(turns, "2024-03-01 00:00:00")
    vector = pick.user_turns(turns).join(vectors, "conv_id").select(
        chats.turn_request_id().alias("request_id"), F.lit("embed").alias("operation"), F.lit(1).alias("attempt"),
        F.lit(None).cast("string").alias("raw"), "embedding", F.lit(1).alias("prompt_eval_count"),
        F.lit(0).alias("eval_count"))
    held = views.v_entries(spark, sf_dir).withColumns(
        {"id": F.col("id").cast("string"), "created_at": F.col("created_at").cast("timestamp")})
    done = cap.capture(requests, vector, held)
    shown = ["id", "raw_text", "embedding", "entry_type", "topics", "created_at"]
    after = cut(held.select(*shown).unionByName(done.entries.select(*shown)))
    out = None
    for own in (True, False):
        part = chats.augment_chats(turns, vectors, after, include_self=own, preamble="Memories:\n\n",
                                   divider="\n\n--- Memories ---\n").withColumn("own", F.lit(own))
        out = part if out is None else out.unionByName(part)
    return out


def capture_turns(spark, sf_dir):
    turns = views.table(spark, sf_dir, "conversations")
    return _shown(chats.capture_turns(turns, "2024-03-01 00:00:00", assistant=True))


def _captured(spark, sf_dir):
    held = views.v_entries(spark, sf_dir)
    return cap.capture(views.v_requests(spark, sf_dir), views.v_answers(spark, sf_dir), held)


def capture_entries(spark, sf_dir):
    return _shown(_captured(spark, sf_dir).entries.drop("embedding"))


def seed_entries(spark, sf_dir):
    """Every vector as a ready-made text; near-copies planted as in `v_vec_dup`."""
    rows = views.v_vec_dup(spark, sf_dir).select(
        F.col("id").alias("request_id"), F.col("id").cast("string").alias("text"), "embedding",
        F.lit("reference").alias("entry_type"), F.array(F.lit("seeded")).alias("topics"),
        F.lit("seed").alias("source_client"),
        F.lit("2024-03-01 00:00:00").cast("timestamp").alias("created_at"),
    )
    return _shown(cap.seed(rows, projects=("memlake",)).entries.drop("embedding"))


def quarantine(spark, sf_dir):
    """Documents as entries, some outside the type domain, some with over-long sources."""
    rows = views.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("raw_text"),
        F.when(F.col("doc_id") % 6 == 5, F.col("lang")).when(F.col("doc_id") % 6 == 4, F.lit(None))
        .otherwise("decision").alias("entry_type"),
        F.repeat("source", F.when(F.col("doc_id") % 10 == 3, 30).otherwise(1)).alias("source_client"),
    )
    good, bad = store.checked(store.with_defaults(rows, "2024-01-01 00:00:00"))
    return good.select("id", "entry_type", F.lit(None).cast("string").alias("fault")).unionByName(
        bad.select("id", "entry_type", "fault")
    )


def store_roundtrip(spark, sf_dir):
    """Append all entries, purge one source, write the rest anew, and count per day."""
    root, kept_root = new_path(spark, "store"), new_path(spark, "store")
    good, _ = store.checked(store.with_defaults(views.v_entries(spark, sf_dir)))
    store.append(good, root, "first")
    gone = spark.createDataFrame([("src_fr",)], "source_client string")
    store.append(store.purge(store.read(spark, root), gone, "source_client"), kept_root, "first")
    return _shown(
        store.read(spark, kept_root).groupBy("created_date", "source_client")
        .agg(F.count("*").alias("entries"), F.sum("relevance_score").alias("score"))
    )


def _terms(spark, sf_dir) -> DataFrame:
    """Languages and sources of the documents, nations, and the opening words of benchmark items."""
    docs = views.table(spark, sf_dir, "documents")
    named = lambda c, kind: (c.alias("term"), F.lit(kind).alias("kind"))
    people = views.table(spark, sf_dir, "nation").select(*named(F.initcap("n_name"), "people"))
    openings = F.array_join(F.slice(F.split("text", " "), 1, 2), " ")
    return docs.select(*named(F.col("lang"), "topics")).unionByName(docs.select(*named(F.col("source"), "projects"))).unionByName(
        people).unionByName(views.table(spark, sf_dir, "benchmark").select(*named(openings, "projects"))).distinct()


def rule_metadata(spark, sf_dir, **options):
    texts = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id"), "text")
    return _shown(stand_ins.rule_metadata(texts, _terms(spark, sf_dir), **options).select(
        "request_id", "entry_type", "topics", "people", "projects",
        F.md5(F.array_join("action_items", "|")).alias("action_items_md5")))


def hashed_vectors(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(hashed_vector("text", 64)).alias("bucket", "w")).where(
        "w > 0"
    ).select("doc_id", "bucket", F.round(F.col("w").cast("double"), 4).alias("weight"))


def inference_requests(spark, sf_dir):
    texts = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id"), "text")
    gate = answers.gate_results(_gate(spark, sf_dir))
    first = answers.inference_requests(texts, classify="Gate: {text} ?", extract="")
    then = answers.inference_requests(texts, gate, classify="", extract="Tags: {text} !")
    return first.unionByName(then).select(
        "request_id", "operation", F.md5("prompt").alias("prompt_md5"))


def _stream(spark, sf_dir, name):
    """A table as a stream, whether it is one file or a folder of files."""
    source, path = views.table(spark, sf_dir, name), f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(source.schema)
    if is_folder(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _run(spark, writer, available_now=True):
    writer = writer.option("checkpointLocation", new_path(spark, "stream"))
    query = (writer.trigger(availableNow=True) if available_now else writer).start()
    query.awaitTermination()


def stream_daily(spark, sf_dir):
    root = new_path(spark, "daily")
    usage = views.usage_from(_stream(spark, sf_dir, "events"))
    good, _ = log_usage(usage, rates_table(spark, views.RATES))
    good = good.withColumn("created_at", F.col("created_at").cast("timestamp"))
    _run(spark, jobs.daily_stream(good, root))
    return _shown(jobs.daily_totals(spark, root))


def stream_usage(spark, sf_dir):
    """Usage log and budget monitor over the stream, read back."""
    root, out = new_path(spark, "usage"), new_path(spark, "monitor")
    events = _stream(spark, sf_dir, "events")
    _run(spark, jobs.usage_stream(views.usage_from(events), rates_table(spark, views.RATES), root))
    _run(spark, jobs.budget_monitor(events, root, out, BUDGET, DAYS, lambda: USAGE_AS_OF))
    alerts = spark.read.parquet(f"{out}/alerts")
    report = spark.read.parquet(f"{out}/reports").select(
        "batch", F.col("summary.total_tokens").alias("total_tokens"),
        F.col("month.cost").alias("month_cost"))
    return _shown(report.join(alerts, "batch", "left").select(
        "total_tokens", "month_cost", "monthly_limit", "alert"))


def stream_alerts(spark, sf_dir):
    """Usage in three micro-batches, one of them run twice: alerts of every month and level."""
    root, out, arrived = new_path(spark, "usage"), new_path(spark, "monitor"), new_path(spark, "arrived")
    events = views.table(spark, sf_dir, "events")
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    third = F.floor((F.col("event_id") - F.lit(low)) * 3 / F.lit(high - low + 1))
    rates, monitor = rates_table(spark, views.RATES), jobs.Monitor(out, BUDGET, DAYS, lambda: USAGE_AS_OF)
    first = new_path(spark, "stream")
    for no in range(3):
        events.where(third == no).write.mode("append").parquet(arrived)
        stream = spark.readStream.schema(events.schema).parquet(arrived)
        for checkpoint in (new_path(spark, "stream"), first) if no == 0 else (first,):
            writer = jobs.usage_stream(views.usage_from(stream), rates, root, monitor)
            writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return _shown(spark.read.parquet(f"{out}/alerts").select("month", "alert", "monthly_limit"))


def store_compacted(spark, sf_dir):
    """Entries appended in five batches, compacted, and what was replaced removed."""
    root, entries = new_path(spark, "store"), views.v_entries(spark, sf_dir)
    good = cut(store.checked(store.with_defaults(entries))[0])
    for kind in ENTRY_TYPES:
        store.append(good.where(F.col("entry_type") == kind), root, kind)
    files = lambda: store.read(spark, root).select(F.input_file_name().alias("f")).distinct().count()
    before = files()
    store.compact(spark, root)
    batches.retire(spark, root)
    return _shown(
        store.read(spark, root).groupBy("created_date", "source_client", "entry_type")
        .agg(F.count("*").alias("entries"), F.sum("relevance_score").alias("score"))
        .withColumns({"batches": F.lit(len(batches.labels(spark, root))), "fewer_files": F.lit(files() < before)})
    )


def _requests(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").alias("request_id"), "text",
        F.concat(F.lit("src_"), "lang").alias("source_client"),
        (F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")
         + F.make_dt_interval(F.lit(0), F.lit(0), F.col("doc_id").cast("int"))).alias("created_at"),
    )


def stream_capture_batches(spark, sf_dir):
    """The same in three micro-batches, one after another, with the candidate index."""
    root, out, index = new_path(spark, "store"), new_path(spark, "capture"), new_path(spark, "index")
    arrived, checkpoint = new_path(spark, "arrived"), new_path(spark, "stream")
    held, _ = store.checked(store.with_defaults(views.v_entries(spark, sf_dir)))
    store.append(held, root, "held")
    docs = views.table(spark, sf_dir, "documents")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    third = F.floor((F.col("doc_id") - F.lit(low)) * 3 / F.lit(high - low + 1))
    for no in range(3):
        docs.where(third == no).write.mode("append").parquet(arrived)
        stream = spark.readStream.schema(docs.schema).parquet(arrived)
        writer = jobs.capture_stream(_requests(stream), views.v_answers(spark, sf_dir), root, out, index)
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/outcomes").drop("batch")


def stream_capture(spark, sf_dir):
    root, out = new_path(spark, "store"), new_path(spark, "capture")
    held, _ = store.checked(store.with_defaults(
        views.v_entries(spark, sf_dir)))
    store.append(held, root, "held")
    requests = _requests(_stream(spark, sf_dir, "documents"))
    _run(spark, jobs.capture_stream(requests, views.v_answers(spark, sf_dir), root, out))
    return spark.read.parquet(f"{out}/outcomes").drop("batch")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def entries(fn):
        return lambda spark, sf_dir: _shown(fn(views.v_entries(spark, sf_dir)))

    def usage(fn):
        return lambda spark, sf_dir: _shown(fn(_usage(spark, sf_dir)))

    def turns(fn):
        return lambda spark, sf_dir: fn(views.table(spark, sf_dir, "conversations"))

    def documents(fn):
        return lambda spark, sf_dir: fn(views.table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "request_id"))

    optional = dict(llm.queries()) if llm else {}
    if corpus_pipeline:
        optional["pipeline"] = corpus_pipeline.run
    return optional | {
        "search_topk": search_topk,
        "search_by_type": lambda s, d: search_topk(s, d, entry_type="decision", limit=20),
        "search_by_project": lambda s, d: search_topk(s, d, project="src1", limit=99),
        "search_many": search_many,
        "search_many_filtered": search_many_filtered,
        "ann_search": ann_search,
        "ann_search_all_lists": ann_search_all_lists,
        "ann_search_split": ann_search_split,
        "ann_recall": ann_recall,
        "json_output": json_output,
        "recent_entries": entries(lambda e: search.recent(e, ENTRIES_AS_OF)),
        "recent_by_type": entries(
            lambda e: search.recent(e, ENTRIES_AS_OF, 10, entry_type="reference", project="src1")),
        "stats_summary": entries(lambda e: reports.store_summary(e, ENTRIES_AS_OF, DAYS)),
        "stats_by_type": entries(lambda e: reports.store_section(e, "entry_type", ENTRIES_AS_OF, DAYS)),
        "stats_top_topics": entries(lambda e: reports.store_section(e, "topic", ENTRIES_AS_OF, DAYS)),
        "stats_top_projects": entries(lambda e: reports.store_section(e, "project", ENTRIES_AS_OF, DAYS)),
        "store_stats": store_stats,
        "usage_cost": usage(lambda u: u.select("id", "total_tokens", "estimated_cost")),
        "usage_summary": usage(lambda u: reports.token_summary(u, USAGE_AS_OF, DAYS)),
        "usage_today": usage(lambda u: reports.period_to_date(u, USAGE_AS_OF, "day")),
        "usage_month": usage(lambda u: reports.period_to_date(u, USAGE_AS_OF, "month")),
        "usage_by_provider": usage(lambda u: reports.tokens_by_provider(u, USAGE_AS_OF, DAYS)),
        "usage_by_model": usage(lambda u: reports.tokens_by_model(u, USAGE_AS_OF, DAYS)),
        "usage_by_operation": usage(lambda u: reports.tokens_by_operation(u, USAGE_AS_OF, DAYS)),
        "usage_daily": usage(lambda u: reports.tokens_daily(u, USAGE_AS_OF, DAYS)),
        "usage_budget": usage(lambda u: reports.budget_status(u, USAGE_AS_OF, BUDGET)),
        "usage_alert": usage(lambda u: reports.budget_alert(u, USAGE_AS_OF, BUDGET)),
        "token_sections": token_sections,
        "token_report": token_report,
        "parse_gate": parse_gate,
        "parse_metadata": parse_metadata,
        "resolve_attempts": lambda s, d: _gate(s, d).select(
            "request_id", "attempt", "status", F.size("used").alias("used")),
        "gate_results": lambda s, d: _shown(answers.gate_results(_gate(s, d)).drop("attempt")),
        "response_usage": lambda s, d: answers.usage_rows(_gate(s, d).select("request_id", "used")).drop("request_id"),
        "inference_requests": inference_requests,
        "dup_against_store": dup_against_store,
        "dedupe_batch": dedupe_batch,
        "dup_against_store_cells": dup_against_store_cells,
        "dedupe_batch_tiled": dedupe_batch_tiled,
        "search_many_parts": search_many_parts,
        "search_many_filtered_parts": search_many_filtered_parts,
        "search_clamped": lambda s, d: search_topk(s, d, limit=99),
        "usage_cost_exact": usage_cost_exact,
        "user_turns": turns(pick.user_turns),
        "assistant_turns": turns(pick.assistant_turns),
        "capture_turns": capture_turns,
        "memory_blocks": memory_blocks,
        "augment_chats": augment_chats,
        "chat_hook": chat_hook,
        "capture_outcomes": lambda s, d: _captured(s, d).outcomes,
        "capture_entries": capture_entries,
        "capture_usage": lambda s, d: _shown(_captured(s, d).usage),
        "seed_entries": seed_entries,
        "quarantine": quarantine,
        "store_roundtrip": store_roundtrip,
        "rule_gate": documents(lambda t: stand_ins.rule_gate(t).select(
            "request_id", "label", "confidence", "should_store")),
        "rule_metadata": rule_metadata,
        "rule_metadata_parts": lambda s, d: rule_metadata(s, d, dictionary_bytes=3000),
        "hashed_vectors": hashed_vectors,
        "stream_daily": stream_daily,
        "stream_usage": stream_usage,
        "stream_capture": stream_capture,
        "stream_capture_batches": stream_capture_batches,
        "stream_alerts": stream_alerts,
        "store_compacted": store_compacted,
    }


def oracle_sql() -> dict[str, str]:
    optional = dict(llm.oracle_sql()) if llm else {}
    if corpus_pipeline and corpus_pipeline.ORACLE_SQL:
        optional["pipeline"] = corpus_pipeline.ORACLE_SQL
    return optional | ORACLES


def entry(spark: SparkSession) -> DataFrame:
    """Top ten memories for one vector."""
    return search_topk(spark, "/root/testdata/sf0.001")
