import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from memlake.operators import stand_ins
from memlake.plans.capture import capture, seed
from memlake.schemas import REQUESTS, RESPONSES
from memlake.sources import store, usage_log

NOW = datetime(2024, 3, 1)
GOOD = '{"label": "store", "confidence": 0.875, "reason": "fine"}'
META = '{"entry_type": "decision", "topics": ["db"], "people": ["Ann"]}'


def case(spark, rows):
    """rows: (request_id, gate answer, metadata answer, vector)"""
    asked = spark.createDataFrame(
        [(r[0], f"text {r[0]}", "src" if i else None, NOW + timedelta(minutes=i)) for i, r in enumerate(rows)], REQUESTS)
    answers = []
    for name, gate, meta, vector in rows:
        for op, raw, v in (("classify", gate, None), ("extract", meta, None), ("embed", None, vector)):
            if raw is not None or v is not None:
                answers.append((name, op, 1, raw, v, 5, 2, None))
    return asked, spark.createDataFrame(answers, RESPONSES)


ROWS = [
    ("a", GOOD, META, [1.0, 0.0, 0.0]),
    ("b", GOOD, META, [1.0, 0.01, 0.0]),                   # near-copy of a
    ("c", '{"label": "chit_chat", "reason": "hi"}', META, [0.0, 0.0, 1.0]),
    ("d", '{"label": 4}', META, [0.0, 1.0, 0.0]),          # fatal
    ("e", GOOD, META, None),                               # no vector
    ("f", None, None, [0.0, 1.0, 0.0]),                    # no answers but a vector
    ("g", GOOD, "broken", [0.0, 0.0, 1.0]),                # its near-copy c was filtered
    ("h", GOOD, META, [0.0, 0.0, 0.0]),                    # vector without length
]


def test_every_request_gets_one_outcome(spark):
    done = capture(*case(spark, ROWS))
    got = {r.request_id: r for r in done.outcomes.collect()}
    assert {k: r.outcome for k, r in got.items()} == {
        "a": "stored", "b": "duplicate", "c": "filtered", "d": "error", "e": "error", "f": "stored", "g": "stored", "h": "error"}
    assert got["a"].reason == "Stored as decision (confidence 0.88)"
    assert got["b"].reason == "Near-duplicate entry already exists (cosine similarity > 0.98)"
    assert got["c"].reason == "Filtered by relevance gate: chit_chat — hi"
    assert got["f"].reason == "Stored as observation (confidence 0.00)"
    assert got["h"].reason == "Error: vector without length" and got["h"].id is None
    entries = {r.raw_text: r for r in done.entries.collect()}
    assert set(entries) == {"text a", "text f", "text g"}
    assert entries["text a"].people == ["Ann"] and entries["text a"].relevance_score == 0.875
    assert entries["text a"].source_client == "unknown" and entries["text f"].source_client == "src"
    assert entries["text a"].id == got["a"].id
    assert [r.request_id for r in done.quarantine.collect()] == ["h"]


def test_usage_covers_only_what_a_run_would_ask(spark):
    got = {r.id for r in capture(*case(spark, ROWS)).usage.collect()}
    classify = {f"{r}/classify/1" for r in "abcdegh"}
    extract = {f"{r}/extract/1" for r in "abegh"}
    embed = {f"{r}/embed/1" for r in "abfgh"}
    assert got == classify | extract | embed


def test_a_rerun_against_the_store_adds_nothing(spark, tmp_path):
    root = str(tmp_path / "store")
    asked, answers = case(spark, ROWS)
    first = capture(asked, answers, store.read(spark, root))
    store.append(first.entries, root, "one")
    held = store.read(spark, root)
    assert held.count() == 3 and "created_date" in held.columns
    again = capture(asked, answers, held)
    assert again.entries.count() == 0
    assert again.outcomes.where("outcome = 'duplicate'").count() == 4
    store.append(first.entries, root, "one")  # the same batch replaces itself
    assert store.read(spark, root).count() == 3
    assert store.read(spark, root, without_batch="one").count() == 0
    held = store.read(spark, root)
    left = store.purge(held, held.where("raw_text = 'text a'").select("id"))
    assert {r.raw_text for r in left.collect()} == {"text f", "text g"}


def test_wrong_dimension_is_quarantined(spark):
    done = capture(*case(spark, ROWS[:1]), dim=5)
    assert done.outcomes.first().reason == "Error: wrong vector dimension"


def test_seed_skips_the_gate_but_not_the_duplicate_test(spark):
    rows = spark.createDataFrame(
        [("s1", "one", [1.0, 0.0], "reference", ["t"], "seed", NOW), ("s2", "two", [1.0, 0.001], "reference", [], "seed", NOW),
         ("s3", "three", [0.0, 1.0], "memo", [], "seed", NOW)],
        "request_id string, text string, embedding array<float>, entry_type string, topics array<string>, "
        "source_client string, created_at timestamp")
    done = seed(rows, projects=("Lake",))
    assert {r.request_id: r.outcome for r in done.outcomes.collect()} == {"s1": "stored", "s2": "duplicate", "s3": "error"}
    kept = done.entries.first()
    assert (kept.projects, kept.people, kept.relevance_score) == (["Lake"], [], 1.0)


def test_defaults(spark):
    rows = spark.createDataFrame([("x", None)], "raw_text string, topics array<string>")
    row = store.with_defaults(rows, "2024-01-01 00:00:00").first()
    assert (row.entry_type, row.topics, row.people, row.source_client, row.relevance_score) == ("observation", [], [], "unknown", 0.0)
    assert len(row.id) == 36 and row.created_at == datetime(2024, 1, 1)


def test_usage_log_round_trip(spark, tmp_path):
    root = str(tmp_path / "usage")
    rows = spark.createDataFrame([("1", "p", "m", "chat", 1, 2, 3, NOW)],
                                 "id string, provider string, model string, operation string, prompt_tokens int, "
                                 "completion_tokens int, total_tokens int, created_at timestamp")
    usage_log.append(rows.withColumn("estimated_cost", F.lit(0).cast("decimal(12,8)")), root, "one")
    assert usage_log.read(spark, root).first().total_tokens == 3


def labelled():
    """Texts made from what the labels mean, with the label each must get."""
    filler = "heron maple quartz dune cobalt fern".split()
    out = [(f"{mark}{level.upper()}{end} {' '.join(filler)}", "system_noise")
           for level in stand_ins.LOG_LEVELS for mark, end in (("", ":"), ("[", "]"), ("12.5 ", " |"))]
    out += [(f"{' '.join(filler)} {level}: x", "store") for level in stand_ins.LOG_LEVELS]
    out += [(f"{level} {' '.join(filler)}", "store") for level in stand_ins.LOG_LEVELS]
    some = stand_ins.COURTESIES
    out += [(", ".join(some[i:i + n]).capitalize() + "!", "chit_chat") for n in (1, 2, 5) for i in range(0, len(some) - n, 4)]
    out += [(f"{some[0]} {' '.join(filler[:n])}", "too_short" if n < 3 else "store") for n in range(1, 6)]
    return out + [(" ".join(filler[:n]), "store" if n >= 4 else "too_short") for n in range(7)] + [(" ... ", "too_short")]


def test_rule_gate(spark):
    cases = labelled()
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "request_id int, text string")
    got = {r.request_id: r for r in stand_ins.rule_gate(df).collect()}
    for i, (text, label) in enumerate(cases):
        assert got[i].label == label and got[i].should_store == (label == "store"), text


@pytest.mark.parametrize("options", [{}, {"dictionary_bytes": 400}])
def test_rule_metadata(spark, options):
    """Every cue and term in every place, against a plain search of spaced words."""
    r = random.Random(11)
    stock = "heron Maple quartz dune,cobalt fern ... maple-quartz".split()
    terms = [("Maple", "people"), ("maple quartz", "projects"), ("quartz dune", "topics"), ("FERN", "topics"), ("ern", "topics"),
             ("maple quartz dune", "people"), ("heron heron", "projects"), ("...", "topics"), ("maple", "other")]
    terms += [(f"term{i} x", "topics") for i in range(30)]
    cues = [c for _, runs in stand_ins.TYPE_CUES for c in runs]
    texts = [None, "", "!!"] + [" ".join(r.choice(stock) for _ in range(r.randint(1, 12))) for _ in range(60)]
    texts += [f"{r.choice(stock)} {c.upper()} {r.choice(stock)}" for c in cues] + [f"x{c} {c}x" for c in cues]
    texts += [" ".join(r.sample(cues, 2)) + f" term{i} x" for i in range(20)]
    spaced = lambda t: " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "
    df = spark.createDataFrame(list(enumerate(texts)), "request_id int, text string")
    got = {x.request_id: x for x in stand_ins.rule_metadata(
        df, spark.createDataFrame(terms, "term string, kind string"), **options).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        kind = next((n for n, runs in stand_ins.TYPE_CUES if any(f" {c} " in spaced(text) for c in runs)), "observation")
        assert got[i].entry_type == kind
        for k in ("topics", "people", "projects"):
            assert got[i][k] == sorted(t for t, its in terms if its == k and spaced(t).strip() and spaced(t) in spaced(text))
        assert got[i].action_items == ([text.strip()] if kind == "action_item" else [])
