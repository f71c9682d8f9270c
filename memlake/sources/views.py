"""Entries, usage rows, model answers and near-copies derived from the test tables."""

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def v_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text", "lang", "source")
    l = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"), "quality")
    none = F.array().cast("array<string>")
    kind = F.col("label") % 5
    known = e.join(d, "vec_id", "left").join(l, "vec_id", "left").withColumns({
        "lang": F.coalesce("lang", F.lit("xx")), "source": F.coalesce("source", F.lit("none"))})
    return known.select(
        F.col("vec_id").alias("id"),
        F.coalesce("text", F.concat(F.lit("vector "), F.col("vec_id").cast("string"))).alias("raw_text"),
        "embedding",
        F.when(kind == 0, "observation").when(kind == 1, "decision").when(kind == 2, "action_item")
        .when(kind == 3, "reference").otherwise("project_note").alias("entry_type"),
        F.when(F.col("vec_id") % 7 == 0, none).otherwise(F.array("lang", "source")).alias("topics"),
        F.when(F.col("vec_id") % 3 == 0, F.array("source")).otherwise(none).alias("projects"),
        F.concat(F.lit("src_"), "lang").alias("source_client"),
        F.coalesce("quality", F.lit(0.5)).cast("double").alias("relevance_score"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
         + F.make_dt_interval(F.lit(0), F.col("vec_id").cast("int"))).alias("created_at"),
    )


def usage_from(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("id"),
        F.when(F.col("user_id") % 3 == 0, "ollama").when(F.col("user_id") % 3 == 1, "openai")
        .otherwise("nvidia").alias("provider"),
        F.concat(F.lit("m"), (F.col("user_id") % 2).cast("string")).alias("model"),
        F.when(kind == "click", "classify").when(kind == "view", "extract")
        .when(kind == "signup", "embed").otherwise("chat").alias("operation"),
        F.floor(F.col("value") * 10).cast("int").alias("prompt_tokens"),
        F.when(kind == "signup", 0).otherwise(F.get_json_object("props", "$.k").cast("int"))
        .alias("completion_tokens"),
        (F.col("ts") + F.make_dt_interval(F.lit(10))).alias("created_at"),
    )


def v_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_from(table(spark, sf_dir, "events"))


def v_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifier answers, one malformed variant per request_id % 8."""
    labels = table(spark, sf_dir, "labels")
    variant = F.col("doc_id") % 8
    attempts = F.when(variant.isin(1, 5, 7), F.array(F.lit(1), F.lit(2), F.lit(3))).otherwise(
        F.array(F.lit(1))
    )
    good = F.concat(
        F.lit('```json {"label": "'),
        F.when(F.col("quality") == 1, "store").otherwise("system_noise"),
        F.lit('", "confidence": 0.9, "reason": "r"} ```'),
    )
    raw = (
        F.when((variant == 1) & (F.col("attempt") == 1), "no json here")
        .when(variant == 2, F.concat(
            F.lit('Sure. {"label": " STORE ", "confidence": "0.'),
            (F.col("doc_id") % 10).cast("string"), F.lit('"} done')))
        .when(variant == 3, '{"label": "banana", "confidence": 7}')
        .when(variant == 4, '{"label": "chit_chat"}')
        .when(variant == 5, '{"label": "store", "confidence": "high"}')
        .when(variant == 6, '{"label": null, "confidence": 0.4}')
        .when(variant == 7, '{"label": "store", "confidence": ')
        .otherwise(good)
    )
    return labels.withColumn("attempt", F.explode(attempts)).select(
        F.col("doc_id").alias("request_id"), F.lit("classify").alias("operation"), "attempt",
        raw.alias("raw"),
        (F.lit(10) + F.col("doc_id") % 50).cast("int").alias("prompt_eval_count"),
        (F.lit(5) + F.col("attempt")).cast("int").alias("eval_count"),
    )


def v_vec_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth vector with two planted neighbours."""
    e = table(spark, sf_dir, "embeddings")
    copies = F.when(F.col("vec_id") % 10 == 0, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(
        F.array(F.lit(0))
    )
    return e.withColumn("variant", F.explode(copies)).select(
        (F.col("vec_id") + F.col("variant") * 1000000).alias("id"), "variant",
        F.transform(
            "embedding",
            lambda x, i: x.cast("double") + F.when(i == 0, F.col("variant") * F.lit(0.15)).otherwise(0.0),
        ).alias("embedding"),
    )


def v_extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata answers for every document, one shape per doc_id % 5."""
    shape = F.col("doc_id") % 5
    raw = (
        F.when(shape == 0, F.concat(
            F.lit('{"entry_type": " Decision ", "topics": ["'), "lang", F.lit('", " ", null, "'),
            "source", F.lit('", "'), "lang", F.lit('"], "people": "nobody", "projects": [7, 0, false, ""]}')))
        .when(shape == 1, F.concat(
            F.lit('Here: ```json\n{"entry_type": "memo", "topics": [], "action_items": [" do '),
            F.col("n_chars").cast("string"), F.lit(' things "]}\n``` and {x}')))
        .when(shape == 2, F.concat(F.lit('{"entry_type": 3, "topics": {"a": 1}, "projects": ["'), "source", F.lit('"]}')))
        .when(shape == 3, '{"entry_type": "reference"')
        .otherwise(F.concat(F.lit('ok {"people": ["\u00a0'), "lang", F.lit('\\t", true], "entry_type": "PROJECT_NOTE"} bye')))
    )
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("request_id"), F.lit("extract").alias("operation"),
        F.lit(1).alias("attempt"), raw.alias("raw"),
        F.col("n_chars").cast("int").alias("prompt_eval_count"), F.lit(20).alias("eval_count"),
    )


def v_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a capture request; those without a label have no classifier answer."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("request_id"), "text",
        F.concat(F.lit("src_"), "lang").alias("source_client"),
        (F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")
         + F.make_dt_interval(F.lit(0), F.lit(0), F.col("doc_id").cast("int"))).alias("created_at"),
    )


def v_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embed answers: groups of four requests get vectors in a chain, where only neighbours
    in the chain are near-copies."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("base"), "embedding")
    step = F.col("doc_id") % 4
    return (
        table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") - step).alias("base"))
        .join(e, "base")
        .select(
            F.col("doc_id").alias("request_id"), F.lit("embed").alias("operation"),
            F.lit(1).alias("attempt"),
            F.transform(
                "embedding",
                lambda x, i: (x.cast("double")
                              + F.when(i == 0, step * F.lit(0.15)).otherwise(0.0)).cast("float"),
            ).alias("embedding"),
            F.lit(12).alias("prompt_eval_count"), F.lit(99).alias("eval_count"),
        )
    )


def v_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All model answers of `v_requests`."""
    parts = (v_responses(spark, sf_dir), v_extracts(spark, sf_dir), v_vectors(spark, sf_dir))
    out = None
    for part in parts:
        part = part.select(
            "request_id", "operation", "attempt",
            (F.col("raw") if "raw" in part.columns else F.lit(None).cast("string")).alias("raw"),
            (F.col("embedding") if "embedding" in part.columns
             else F.lit(None).cast("array<float>")).alias("embedding"),
            "prompt_eval_count", "eval_count",
        )
        out = part if out is None else out.unionByName(part)
    return out


RATES = {
    "openai/m0": {"prompt_per_1k": 0.15, "completion_per_1k": 0.60},
    "openai": {"prompt_per_1k": 0.50, "completion_per_1k": 1.50},
    "nvidia/m1": {},
    "nvidia": {"prompt_per_1k": 0.20, "completion_per_1k": 0.20},
}
