from datetime import datetime

import pytest
from pyspark.sql import functions as F

from memlake.functions import text as ft


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "raw string").select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "raw, want",
    [
        ('{"a": 1}', '{"a": 1}'),
        ('Sure! {"a": {"b": 2}} bye', '{"a": {"b": 2}}'),
        ('```json\n{"a": 1}\n``` and {"b": 2}', '{"a": 1}'),
        ('```\n{"a":\n1}```', '{"a":\n1}'),
        ("{x} mid {y}", "{x} mid {y}"),
        ("nothing", None),
        ("", None),
        (None, None),
    ],
)
def test_json_block(spark, raw, want):
    assert one(spark, raw, ft.json_block("raw")) == want


def test_bad_fence_is_a_failure_not_a_second_try(spark):
    raw = '```json {"label": store} ``` {"label": "store"}'
    assert one(spark, raw, ft.parse_answer("raw").isNull())


@pytest.mark.parametrize(
    "raw, label, kind, confidence",
    [
        ('{"label": " Store\\n", "confidence": 0.7}', "store", "good", 0.7),
        ('{"confidence": "0.25"}', "uncertain", "good", 0.25),
        ('{"label": "else", "confidence": -3}', "uncertain", "good", 0.0),
        ('{"label": "chit_chat"}', "chit_chat", "good", 0.5),
        ('{"label": 3, "confidence": 1}', None, "good", 1.0),
        ('{"label": ["store"], "confidence": 1}', None, "good", 1.0),
        ('{"label": null}', None, "good", 0.5),
        ('{"label": "store", "confidence": null}', "store", "fatal", None),
        ('{"label": "store", "confidence": [1]}', "store", "fatal", None),
        ('{"label": "store", "confidence": {"a": 1}}', "store", "fatal", None),
        ('{"label": "store", "confidence": true}', "store", "good", 1.0),
        ('{"label": "store", "confidence": false}', "store", "good", 0.0),
        ('{"label": "store", "confidence": "high"}', "store", "bad", None),
        ('{"label": "store", "confidence": "1.0f"}', "store", "bad", None),
        ('{"label": "store", "confidence": " 1_0e-1 "}', "store", "good", 1.0),
        ('{"label": "store", "confidence": "nan"}', "store", "good", 1.0),
        ('{"label": "store", "confidence": "-inf"}', "store", "good", 0.0),
    ],
)
def test_gate_fields(spark, raw, label, kind, confidence):
    answer = ft.parse_answer("raw")
    got = one(spark, raw, F.struct(ft.gate_label(answer), ft.gate_confidence_kind(answer), ft.gate_confidence(answer)))
    assert got[0] == label and got[1] == kind
    if kind == "good":
        assert got[2] == confidence


@pytest.mark.parametrize(
    "raw, want",
    [
        ('{"t": ["b", " a ", "b"]}', ["b", "a", "b"]),
        ('{"t": ["\\u00a0x\\t", "", "  ", null, 0, 0.0, false, [], {}]}', ["x"]),
        ('{"t": ["false", "0", "null", 1.5, true, 7]}', ["false", "0", "null", "1.5", "true", "7"]),
        ('{"t": "text"}', []),
        ('{"t": {"a": 1}}', []),
        ("{}", []),
        ("no", []),
    ],
)
def test_tag_list(spark, raw, want):
    assert one(spark, raw, ft.tag_list(ft.parse_answer("raw"), "t")) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ('{"entry_type": " DECISION "}', "decision"),
        ('{"entry_type": "memo"}', "observation"),
        ('{"entry_type": null}', "observation"),
        ('{"entry_type": 4}', "observation"),
        ("{}", "observation"),
    ],
)
def test_entry_type(spark, raw, want):
    assert one(spark, raw, ft.entry_type(ft.parse_answer("raw"))) == want


def test_strip_takes_every_kind_of_space(spark):
    for code in (9, 10, 11, 12, 13, 28, 31, 32, 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x3000):
        assert one(spark, f"{chr(code)} a b {chr(code)}", ft.strip("raw")) == "a b"
    assert one(spark, "​x", ft.strip("raw")) == "​x"
    assert one(spark, " \t", ft.is_blank("raw")) and one(spark, None, ft.is_blank("raw"))


def test_has_words_counts_like_words(spark):
    for value in ("", "a", "one two", " one, two; three ", "é-è 1 2", "日本語 テスト"):
        for n in (1, 2, 3, 4):
            row = one(spark, value, F.struct(F.size(ft.words("raw")) >= n, ft.has_words("raw", n)))
            assert row[0] == row[1], (value, n)


def test_iso_and_memory_text(spark):
    df = spark.createDataFrame(
        [(datetime(2024, 1, 2, 3, 4, 5), ["a", "b"]), (datetime(2024, 1, 2, 3, 4, 5, 60), [])],
        "ts timestamp, topics array<string>",
    )
    iso = [r[0] for r in df.select(ft.iso_timestamp("ts")).collect()]
    assert iso == ["2024-01-02T03:04:05+00:00", "2024-01-02T03:04:05.000060+00:00"]
    text = [r[0] for r in df.select(
        ft.memory_text(F.lit("decision"), "topics", "ts", F.lit("body"))).collect()]
    assert text == ["[decision] Topics: a, b (2024-01-02)\nbody", "[decision] (2024-01-02)\nbody"]
    bare = df.select(ft.memory_text(F.lit("decision"), "topics", F.lit(None).cast("timestamp"), F.lit("x")))
    assert bare.collect()[1][0] == "[decision]\nx"
