"""Capture: gate, metadata, vector, duplicate test and store, for a table of requests."""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from memlake.constants import (
    DEFAULT_SOURCE, DUPLICATE_REASON, DUPLICATE_THRESHOLD, ERROR_REASON, FILTERED_REASON, MAX_ATTEMPTS,
    STORE_LABELS, STORED_REASON, TAG_COLUMNS,
)
from memlake.functions.text import filled
from memlake.operators.duplicates import admit
from memlake.operators.responses import resolve_requests, unavailable_reason, usage_rows
from memlake.schemas import ENTRIES
from memlake.sources.scratch import cut
from memlake.sources.store import checked, entry_fault


class Captured(NamedTuple):
    outcomes: DataFrame
    entries: DataFrame
    usage: DataFrame
    quarantine: DataFrame


def entry_id(request_id) -> Column:
    """A stable id in UUID form, so that a rerun names the same entry the same way."""
    digest = F.md5(F.col(request_id).cast("string") if isinstance(request_id, str)
                   else request_id.cast("string"))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digest, at, n) for at, n in cuts])


def judge(requests: DataFrame, resolved: DataFrame) -> DataFrame:
    """Requests with their gate verdict, metadata and vector, and how far they get.

    `resolved` comes from `resolve_requests`. `state` is filtered, error or candidate. A missing or unusable gate lets the text
    through; missing metadata becomes an observation; a missing vector is an error.
    """
    none = F.array().cast("array<string>")
    no_use = F.array().cast(resolved.select("classify.used").schema[0].dataType)
    joined = requests.join(resolved, "request_id", "left")
    unusable = F.coalesce(F.col("classify.status") == "failed", F.lit(True))
    label = F.when(unusable, "uncertain").otherwise(F.col("classify.gate.label"))
    fatal = F.coalesce(F.col("classify.status") == "fatal", F.lit(False))
    no_vector = F.coalesce(F.size("embed.embedding"), F.lit(0)) <= 0
    state = (
        F.when(fatal, "error")
        .when(~label.isin(*STORE_LABELS), "filtered")
        .when(no_vector, "error")
        .otherwise("candidate")
    )
    error = (
        F.when(fatal, "unusable label or confidence in classifier answer")
        .when(state == "error", F.concat(
            F.lit(f"embedding failed after {MAX_ATTEMPTS} attempts: "),
            F.coalesce("embed.last_error", F.lit("no usable answer")),
        ))
    )
    return joined.select(
        "request_id", "text",
        F.coalesce("source_client", F.lit(DEFAULT_SOURCE)).alias("source_client"),
        F.coalesce(F.col("created_at").cast("timestamp"), F.current_timestamp()).alias("created_at"),
        label.alias("label"),
        F.when(unusable, 0.0).otherwise(F.col("classify.gate.confidence")).alias("confidence"),
        F.when(unusable, unavailable_reason(F.col("classify.last_error")))
        .otherwise(F.col("classify.gate.reason")).alias("gate_reason"),
        F.coalesce("extract.meta.entry_type", F.lit("observation")).alias("entry_type"),
        *[F.coalesce(f"extract.meta.{c}", none).alias(c) for c in TAG_COLUMNS],
        F.col("embed.embedding").alias("embedding"),
        state.alias("state"), error.alias("error"),
        # Metadata and vectors are asked for only where the gate lets the text through.
        F.concat(
            F.coalesce("classify.used", no_use),
            F.when(~fatal & label.isin(*STORE_LABELS), F.concat(
                F.coalesce("extract.used", no_use), F.coalesce("embed.used", no_use)))
            .otherwise(no_use),
        ).alias("used"),
    )


def _as_entries(judged: DataFrame) -> DataFrame:
    given = {
        "id": entry_id("request_id"), "raw_text": F.col("text"),
        "relevance_score": F.col("confidence"),
    }
    return judged.select(
        "request_id",
        *[given.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in ENTRIES.fields],
    )


def _admitted(entries: DataFrame, store, threshold, options) -> DataFrame:
    """Entries (with request_id) in arrival order against the store and each other."""
    ordered = entries.select(
        F.col("request_id").alias("id"),
        F.unix_micros(F.col("created_at").cast("timestamp")).alias("position"), "embedding",
    )
    return admit(ordered, store, threshold, **options).withColumnRenamed("id", "request_id")


def outcome_columns() -> list[Column]:
    """outcome, stored, id and reason from `state`, `admitted`, `error` and the gate columns."""
    stored = (F.col("state") == "candidate") & F.coalesce("admitted", F.lit(False))
    outcome = (
        F.when(stored, "stored")
        .when(F.col("state") == "candidate", "duplicate")
        .otherwise(F.col("state"))
    )
    confidence = F.format_string("%.2f", F.bround("confidence", 2))
    reason = (
        F.when(outcome == "stored", filled(STORED_REASON, entry_type=F.col("entry_type"), confidence=confidence))
        .when(outcome == "duplicate", DUPLICATE_REASON)
        .when(outcome == "filtered", filled(FILTERED_REASON, label=F.col("label"), reason=F.col("gate_reason")))
        .otherwise(filled(ERROR_REASON, error=F.col("error")))
    )
    return [
        outcome.alias("outcome"), stored.alias("stored"),
        F.when(stored, entry_id("request_id")).alias("id"), reason.alias("reason"),
    ]


def capture(
    requests: DataFrame,
    responses: DataFrame,
    store: DataFrame | None = None,
    *,
    threshold: float = DUPLICATE_THRESHOLD,
    dim: int | None = None,
    provider: str = "ollama",
    models: dict | None = None,
    **options,
) -> Captured:
    """Run a batch of requests (request_id, text, source_client, created_at).

    `responses` holds the model answers of all three operations. Every request gets one
    outcome. Entries to append, usage rows due and quarantined rows come along; nothing is
    written here.
    """
    judged = judge(requests, resolve_requests(responses))
    judged = judged.withColumn(
        "fault",
        F.when(F.col("state") == "candidate", entry_fault(dim, text="text")),
    ).withColumn("error", F.coalesce("error", "fault")).withColumn(
        "state", F.when(F.col("fault").isNotNull(), "error").otherwise(F.col("state"))
    )
    judged = cut(judged)
    entries = _as_entries(judged.where(F.col("state") == "candidate"))
    verdicts = cut(_admitted(entries, store, threshold, options))
    outcomes = judged.select(
        "request_id", "state", "error", "label", "gate_reason", "confidence", "entry_type"
    ).join(verdicts, "request_id", "left").select("request_id", *outcome_columns())
    kept = entries.join(verdicts.where("admitted"), "request_id", "left_semi").drop("request_id")
    usage = usage_rows(
        judged.select("request_id", "created_at", "used"), provider, models
    ).drop("request_id")
    return Captured(outcomes, kept, usage, judged.where("fault is not null").drop("used"))


def seed(
    entries: DataFrame, store: DataFrame | None = None, *, projects: tuple = (), **options
) -> Captured:
    """Store ready-made texts (request_id, text, embedding, entry_type, topics, source_client,
    created_at) without the gate: given tags, score 1.0, still deduplicated."""
    none = F.array().cast("array<string>")
    judged = cut(
        entries.select(
            "request_id", "text", "source_client", "created_at",
            F.lit("store").alias("label"), F.lit(1.0).alias("confidence"),
            F.lit("").alias("gate_reason"), "entry_type", "topics",
            none.alias("people"),
            (F.array(*[F.lit(p) for p in projects]) if projects else none).alias("projects"),
            none.alias("action_items"), "embedding",
            F.lit("candidate").alias("state"), F.lit(None).cast("string").alias("error"),
        )
    )
    ready = _as_entries(judged)
    good, bad = checked(ready)
    verdicts = cut(_admitted(good, store, DUPLICATE_THRESHOLD, options))
    faults = bad.select("request_id", "fault")
    outcomes = judged.join(verdicts, "request_id", "left").join(faults, "request_id", "left").drop(
        "state", "error"
    ).withColumn("state", F.when(F.col("fault").isNull(), "candidate").otherwise("error")).withColumn(
        "error", F.col("fault")
    ).select("request_id", *outcome_columns())
    kept = good.join(verdicts.where("admitted"), "request_id", "left_semi").drop("request_id")
    usage = judged.sparkSession.createDataFrame([], "id string, provider string, model string, "
                                                "operation string, prompt_tokens int, completion_tokens int")
    return Captured(outcomes, kept, usage, bad)
