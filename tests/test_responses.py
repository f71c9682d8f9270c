from pyspark.sql import functions as F

from memlake.operators.responses import (
    gate_results, inference_requests, metadata_results, parse_attempts, resolve_attempts,
    run_model, usage_rows,
)
from memlake.schemas import RESPONSES

GOOD = '{"label": "store", "confidence": 0.9, "reason": "r"}'


def responses(spark, rows):
    """rows: (request_id, operation, attempt, raw, embedding, error)"""
    return spark.createDataFrame(
        [(r, o, a, raw, v, 10 * a, a, e) for r, o, a, raw, v, e in rows], RESPONSES)


def test_first_usable_attempt_wins_and_later_ones_are_ignored(spark):
    got = resolve_attempts(responses(spark, [
        ("a", "classify", 1, "nothing", None, None),
        ("a", "classify", 2, GOOD, None, None),
        ("a", "classify", 3, '{"label": "chit_chat"}', None, None),
        ("b", "classify", 1, None, None, "timeout"),
        ("b", "classify", 2, None, None, "refused"),
        ("b", "classify", 3, "{", None, None),
        ("b", "classify", 4, GOOD, None, None),
        ("c", "classify", 2, '{"label": null}', None, None),
        ("c", "classify", 3, GOOD, None, None),
        ("d", "classify", 1, GOOD, None, "answered late"),
    ]))
    by_id = {r.request_id: r for r in got.collect()}
    assert (by_id["a"].attempt, by_id["a"].status, by_id["a"].gate.label) == (2, "good", "store")
    assert (by_id["b"].attempt, by_id["b"].status) == (None, "failed")
    assert (by_id["c"].attempt, by_id["c"].status) == (2, "fatal")
    assert by_id["d"].status == "failed"
    assert [u.attempt for u in by_id["a"].used] == [1, 2]
    assert [u.attempt for u in by_id["b"].used] == [3]
    gate = {r.request_id: r for r in gate_results(got).collect()}
    assert gate["b"].label == "uncertain" and gate["b"].confidence == 0.0 and gate["b"].should_store
    assert gate["d"].reason == "Classifier unavailable: answered late"
    assert gate["c"].fatal and not gate["c"].should_store


def test_copies_of_an_attempt_fold(spark):
    rows = [("a", "classify", 1, "nope", None, None)] * 50 + [("a", "classify", 2, GOOD, None, None)] * 50
    got = resolve_attempts(responses(spark, rows))
    assert got.count() == 1 and usage_rows(got).count() == 2


def test_metadata_falls_back_to_an_observation(spark):
    got = metadata_results(resolve_attempts(responses(spark, [
        ("a", "extract", 1, "no", None, None),
        ("a", "extract", 3, '{"entry_type": "decision", "topics": ["x"]}', None, None),
        ("b", "extract", 1, "no", None, None),
    ])))
    by_id = {r.request_id: r for r in got.collect()}
    assert by_id["a"].entry_type == "decision" and by_id["a"].topics == ["x"]
    assert by_id["b"].entry_type == "observation"
    assert by_id["b"].topics == by_id["b"].people == by_id["b"].projects == by_id["b"].action_items == []


def test_empty_vectors_are_failed_attempts_and_embeds_cost_no_completion(spark):
    got = resolve_attempts(responses(spark, [
        ("a", "embed", 1, None, [], None),
        ("a", "embed", 2, None, [1.0, 2.0], None),
        ("b", "embed", 1, None, None, None),
    ]))
    by_id = {r.request_id: r for r in got.collect()}
    assert by_id["a"].embedding == [1.0, 2.0] and by_id["b"].embedding is None
    use = sorted((r.id, r.prompt_tokens, r.completion_tokens) for r in usage_rows(got).collect())
    assert use == [("a/embed/1", 10, 0), ("a/embed/2", 20, 0), ("b/embed/1", 10, 0)]


def test_missing_counts_are_zero_and_models_are_named(spark):
    rows = responses(spark, [("a", "classify", 1, GOOD, None, None)]).withColumn(
        "prompt_eval_count", F.lit(None).cast("int")).withColumn("eval_count", F.lit(None).cast("int"))
    use = usage_rows(resolve_attempts(rows), "p", {"classify": "m"}).first()
    assert (use.provider, use.model, use.prompt_tokens, use.completion_tokens) == ("p", "m", 0, 0)


def test_fatal_label_is_seen_before_the_confidence(spark):
    got = parse_attempts(responses(spark, [
        ("a", "classify", 1, '{"label": 1, "confidence": "high"}', None, None),
        ("b", "classify", 1, '{"label": "store", "confidence": "high"}', None, None),
    ]))
    assert {r.request_id: r.status for r in got.collect()} == {"a": "fatal", "b": "failed"}


def test_requests_for_the_model_and_the_hook(spark):
    texts = spark.createDataFrame([("a", "one {text}"), ("b", "two")], "request_id string, text string")
    first = inference_requests(texts, classify="Q: {text}.", extract="X {text}")
    assert {r.request_id: r.prompt for r in first.collect()} == {"a": "Q: one {text}.", "b": "Q: two."}
    gate = spark.createDataFrame([("a", True), ("b", False)], "request_id string, should_store boolean")
    then = inference_requests(texts, gate, classify="", extract="X {text}")
    assert {(r.operation, r.prompt) for r in then.collect()} == {("extract", "X one {text}"), ("embed", "one {text}")}

    def model(batches):
        for pdf in batches:
            yield pdf.assign(raw='{"label": "store"}', attempt=1)[["request_id", "operation", "attempt", "raw"]]

    answered = run_model(first, model, "request_id string, operation string, attempt int, raw string")
    full = answered.withColumn("prompt_eval_count", F.lit(1)).withColumn("eval_count", F.lit(1))
    assert {r.label for r in gate_results(resolve_attempts(full)).collect()} == {"store"}
