"""Model requests out, model answers in: prompts, attempts, fallbacks and usage rows."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from memlake.constants import MAX_ATTEMPTS, STORE_LABELS, TAG_COLUMNS, UNAVAILABLE_REASON
from memlake.functions import text as ft
from memlake.sources.scratch import cut

OPERATIONS = ("classify", "extract", "embed")

_TAGS = "array<string>"
# One attempt, small enough to aggregate: the answer's text never enters the shuffle.
_GATE = "struct<label:string,confidence:double,reason:string>"
_META = "struct<entry_type:string," + ",".join(f"{c}:{_TAGS}" for c in TAG_COLUMNS) + ">"


def requests_for(
    texts: DataFrame, operation: str, template: str = "{text}", split: str = "{text}"
) -> DataFrame:
    """One rendered model request per row (request_id, text) -> request_id, operation, prompt."""
    before, _, after = template.partition(split)
    return texts.select(
        "request_id",
        F.lit(operation).alias("operation"),
        F.concat(F.lit(before), F.col("text"), F.lit(after)).alias("prompt"),
    )


def inference_requests(
    texts: DataFrame, gate: DataFrame | None = None, *, classify: str, extract: str
) -> DataFrame:
    """Gate prompts for all texts; once `gate` is known, the other two for those it lets pass."""
    if gate is None:
        return requests_for(texts, "classify", classify)
    passed = texts.join(gate.where("should_store").select("request_id"), "request_id", "left_semi")
    return requests_for(passed, "extract", extract).unionByName(requests_for(passed, "embed"))


def run_model(requests: DataFrame, batch_function: Callable, schema) -> DataFrame:
    """Hand requests to the caller's own model, batch by batch, on the executors."""
    return requests.mapInPandas(batch_function, schema)


def parse_attempts(responses: DataFrame) -> DataFrame:
    """Each attempt with `status`: good, fatal or failed; plus the parsed gate and metadata.

    Fatal means a shape that ends the attempts at once: a label that is not text, or a
    confidence that is null or a container. The label is looked at first.
    """
    columns = responses.columns
    error = F.col("error") if "error" in columns else F.lit(None).cast("string")
    vector = F.col("embedding") if "embedding" in columns else F.lit(None).cast("array<float>")
    model = F.col("model") if "model" in columns else F.lit(None).cast("string")
    parsed = responses.where(F.col("attempt").between(1, MAX_ATTEMPTS)).select(
        "request_id", "operation", "attempt", model.alias("model"), error.alias("error"),
        vector.alias("embedding"), "prompt_eval_count", "eval_count",
        F.when((F.col("operation") != "embed") & error.isNull(), ft.parse_answer("raw")).alias("answer"),
    )
    answer, operation = F.col("answer"), F.col("operation")
    label, kind = ft.gate_label(answer), ft.gate_confidence_kind(answer)
    status = (
        F.when(F.col("error").isNotNull(), "failed")
        .when(operation == "embed",
              F.when(F.coalesce(F.size("embedding"), F.lit(0)) > 0, "good").otherwise("failed"))
        .when(answer.isNull(), "failed")
        .when(operation == "extract", "good")
        .when(label.isNull() | (kind == "fatal"), "fatal")
        .when(kind == "bad", "failed")
        .otherwise("good")
    )
    gate = F.struct(
        label.alias("label"), ft.gate_confidence(answer).alias("confidence"),
        ft.gate_reason(answer).alias("reason"),
    )
    meta = F.struct(
        ft.entry_type(answer).alias("entry_type"),
        *[ft.tag_list(answer, c).alias(c) for c in TAG_COLUMNS],
    )
    good = F.col("status") == "good"
    return parsed.withColumn("status", status).select(
        "request_id", "operation", "attempt", "status", "model", "error",
        F.when(good & (operation == "classify"), gate).cast(_GATE).alias("gate"),
        F.when(good & (operation == "extract"), meta).cast(_META).alias("meta"),
        F.when(good & (operation == "embed"), F.col("embedding")).alias("embedding"),
        "prompt_eval_count", "eval_count",
    )


# A deciding attempt as one integer, so that the earliest is a minimum over longs: its number,
# whether it is good or fatal, and a hash of its payload, which settles between unlike copies.
_HASH_BITS = 48
_PAYLOAD = {"classify": "gate", "extract": "meta", "embed": "embedding"}


def _packed() -> Column:
    hashed = F.shiftrightunsigned(F.xxhash64("gate", "meta", "embedding"), 64 - _HASH_BITS)
    code = F.col("attempt").cast("bigint") * 2 + (F.col("status") == "fatal").cast("bigint")
    return F.when(F.col("status").isin("good", "fatal"), F.shiftleft(code, _HASH_BITS) + hashed)


def _attempts(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parsed attempts without vectors, written once; vectors of good attempts)."""
    operation, none = F.col("operation"), F.lit(0)
    tokens = F.shiftleft(F.coalesce("prompt_eval_count", none).cast("bigint"), 32) + F.when(
        operation == "embed", 0).otherwise(F.coalesce("eval_count", none)).cast("bigint")
    parsed = parse_attempts(responses).withColumns({"packed": _packed(), "tokens": tokens})
    light = cut(parsed.select(
        "request_id", "operation", "attempt", "model", "error", "gate", "meta", "packed",
        F.when(F.col("error").isNull(), F.col("tokens")).alias("tokens")))
    return light, parsed.where((operation == "embed") & F.col("packed").isNotNull()).select(
        "request_id", "packed", "embedding")


def _resolved(light: DataFrame, vectors: DataFrame, operation: str, named: bool) -> DataFrame:
    """request_id, attempt, status, payload, last_error, used of one operation.

    The deciding attempt and the tokens of all come from a hash aggregate over longs, whatever
    the payloads weigh; then the payload of the deciding attempt alone is fetched.
    """
    mine = light.where(F.col("operation") == operation)
    numbers = range(1, MAX_ATTEMPTS + 1)
    decided = mine.groupBy("request_id").agg(
        F.min("packed").alias("packed"),
        *[F.min(F.when(F.col("attempt") == i, F.col("tokens"))).alias(f"slot{i}") for i in numbers],
    )
    column = _PAYLOAD[operation]
    payload = vectors if operation == "embed" else mine.where("packed is not null").select("request_id", "packed", column)
    # one exchange serves the folding of copies and the join
    payload = payload.repartition("request_id", "packed").distinct()
    found = decided.join(payload, ["request_id", "packed"], "left")
    if named:  # texts travel only where the answers carry any
        told = mine.groupBy("request_id").agg(
            F.max(F.struct("attempt", "error"))["error"].alias("last_error"),
            F.array(*[F.min(F.when((F.col("attempt") == i) & F.col("error").isNull(), F.col("model"))) for i in numbers])
            .alias("models"))
        found = found.join(told, "request_id")
    else:
        found = found.withColumns({
            "last_error": F.lit(None).cast("string"),
            "models": F.array(*[F.lit(None).cast("string") for _ in numbers])})
    attempt = F.shiftright("packed", _HASH_BITS + 1).cast("int")
    fatal = F.shiftright("packed", _HASH_BITS).bitwiseAND(F.lit(1)) == 1
    slots = F.array(*[
        F.when(F.col(f"slot{i}").isNotNull(), F.struct(
            F.lit(operation).alias("operation"), F.lit(i).alias("attempt"), F.col("models")[i - 1].alias("model"),
            F.shiftright(f"slot{i}", 32).cast("int").alias("prompt_tokens"),
            F.col(f"slot{i}").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("completion_tokens")))
        for i in numbers])
    made = F.coalesce(attempt, F.lit(MAX_ATTEMPTS))  # a run makes no attempt after the deciding one
    return found.select(
        "request_id", attempt.alias("attempt"),
        F.when(F.col("packed").isNull(), "failed").when(fatal, "fatal").otherwise("good").alias("status"),
        column, "last_error", F.filter(slots, lambda s: s["attempt"] <= made).alias("used"),
    )


def _each(responses: DataFrame) -> dict[str, DataFrame]:
    named = bool({"model", "error"} & set(responses.columns))
    light, vectors = _attempts(responses)
    return {operation: _resolved(light, vectors, operation, named) for operation in OPERATIONS}


def resolve_attempts(responses: DataFrame) -> DataFrame:
    """Per request and operation: the first good or fatal attempt, and what the run consumed.

    `used` lists the answered attempts a run would have made, with their token counts. Copies of
    an attempt count once; of unlike ones the payload with the least hash stands.
    """
    kinds = {"gate": _GATE, "meta": _META, "embedding": "array<float>"}
    out = None
    for operation, rows in _each(responses).items():
        if operation == "embed":
            kinds["embedding"] = rows.schema["embedding"].dataType
        part = rows.select(
            "request_id", F.lit(operation).alias("operation"), "attempt", "status",
            *[F.col(c) if c in rows.columns else F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()],
            "last_error", "used")
        out = part if out is None else out.unionByName(part)
    return out


def resolve_requests(responses: DataFrame) -> DataFrame:
    """All three operations of a request in one row: structs classify, extract and embed, each with
    its payload, last error and `used` attempts; null where an operation has no attempt."""
    out = None
    for operation, rows in _each(responses).items():
        part = rows.select("request_id", F.struct(
            "status", _PAYLOAD[operation], "last_error", "used").alias(operation))
        out = part if out is None else out.join(part, "request_id", "full_outer")
    return out


def gate_results(resolved: DataFrame) -> DataFrame:
    """Gate verdict per request; no usable attempt means uncertain, and the text is stored."""
    rows = resolved.where(F.col("operation") == "classify")
    failed = F.col("status") == "failed"
    label = F.when(failed, "uncertain").otherwise(F.col("gate.label"))
    return rows.select(
        "request_id", "attempt",
        (F.col("status") == "fatal").alias("fatal"),
        label.alias("label"),
        F.when(failed, 0.0).otherwise(F.col("gate.confidence")).alias("confidence"),
        F.when(failed, unavailable_reason(F.col("last_error")))
        .otherwise(F.col("gate.reason")).alias("reason"),
        F.coalesce(label.isin(*STORE_LABELS), F.lit(False)).alias("should_store"),
    )


def unavailable_reason(error):
    return ft.filled(UNAVAILABLE_REASON, error=F.coalesce(error, F.lit("no usable answer")))


def metadata_results(resolved: DataFrame) -> DataFrame:
    """Metadata per request; no usable attempt means an observation without tags."""
    none = F.array().cast(_TAGS)
    return resolved.where(F.col("operation") == "extract").select(
        "request_id", "attempt",
        F.coalesce("meta.entry_type", F.lit("observation")).alias("entry_type"),
        *[F.coalesce(f"meta.{c}", none).alias(c) for c in TAG_COLUMNS],
    )


def usage_rows(resolved: DataFrame, provider: str = "ollama", models: dict | None = None) -> DataFrame:
    """One usage row per attempt in `used`: answered and due, whether it parsed or not.

    Columns of `resolved` other than `used` are carried along.
    """
    named = F.lit(None).cast("string")
    for operation, model in (models or {}).items():
        named = F.when(F.col("use.operation") == operation, model).otherwise(named)
    carried = [c for c in resolved.columns if c not in ("used", "operation")]
    return resolved.select(*carried, F.explode("used").alias("use")).select(
        *carried,
        F.concat_ws("/", F.col("request_id").cast("string"), "use.operation",
                    F.col("use.attempt").cast("string")).alias("id"),
        F.lit(provider).alias("provider"),
        F.coalesce("use.model", named, F.lit("unknown")).alias("model"),
        "use.operation", "use.prompt_tokens", "use.completion_tokens",
    )
