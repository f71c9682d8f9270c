from datetime import datetime

from pyspark.sql import functions as F

from memlake.operators import turns as pick
from memlake.plans import chats
from memlake.plans.capture import entry_id
from memlake.schemas import ENTRIES, TURNS

NOW = datetime(2024, 3, 1)


def turns(spark, chats_):
    rows = [(c, i, role, text) for c, messages in chats_.items() for i, (role, text) in enumerate(messages)]
    return spark.createDataFrame(rows, TURNS)


CHATS = {
    1: [("system", "be kind"), ("user", "hello there")],
    2: [("user", "first"), ("assistant", "reply"), ("user", "second")],
    3: [("user", "asked"), ("assistant", " answer ")],
    4: [("user", " \t ")],
    5: [("assistant", "old"), ("assistant", "  "), ("user", "x")],
    6: [("assistant", "kept"), ("assistant", ""), ("user", None)],
    7: [("user", "alone")],
}


def test_turn_selection(spark):
    table = turns(spark, CHATS)
    assert {(r.conv_id, r.turn) for r in pick.user_turns(table).collect()} == {(1, 1), (2, 2), (5, 2), (7, 0)}
    assert {(r.conv_id, r.turn) for r in pick.assistant_turns(table).collect()} == {(2, 1), (3, 1), (6, 0)}


def test_nested_chats_flatten(spark):
    nested = spark.createDataFrame(
        [(1, [("system", "be kind"), ("user", "hello there")]), (9, [])],
        "conv_id long, messages array<struct<role: string, content: string>>")
    assert [tuple(r) for r in pick.flat(nested).orderBy("turn").collect()] == [
        (1, 0, "system", "be kind"), (1, 1, "user", "hello there")]


def test_capture_turns(spark):
    got = chats.capture_turns(turns(spark, CHATS), NOW, assistant=True).collect()
    assert {(r.request_id, r.source_client) for r in got} == {
        ("1/1", "open_webui_user"), ("2/2", "open_webui_user"), ("5/2", "open_webui_user"), ("7/0", "open_webui_user"),
        ("2/1", "open_webui_assistant"), ("3/1", "open_webui_assistant"), ("6/0", "open_webui_assistant")}
    assert {r.text for r in got if r.request_id == "3/1"} == {" answer "}


def _store(spark):
    own = spark.range(1).select(entry_id(F.lit("7/0"))).first()[0]
    rows = [("e1", "near", [1.0, 0.0], ["a", "b"]), ("e2", "far", [0.0, 1.0], []), ("e3", "mid", [0.3, 0.954], []),
            ("e4", "none", None, []), (own, "alone", [1.0, 0.0], [])]
    return spark.createDataFrame(
        [(i, t, v, "decision", topics, [], [], [], "s", 0.0, NOW) for i, t, v, topics in rows], ENTRIES)


def _vectors(spark):
    return spark.createDataFrame([(c, [1.0, 0.0]) for c in (1, 2, 3, 7)], "conv_id long, embedding array<float>")


def test_memories(spark):
    got = chats.augment_chats(turns(spark, CHATS), _vectors(spark), _store(spark), preamble="P:", divider="\n--\n")
    by = {(r.conv_id, r.turn): r for r in got.collect()}
    block = "[decision] (2024-03-01)\nalone\n\n---\n\n[decision] Topics: a, b (2024-03-01)\nnear\n\n---\n\n[decision] (2024-03-01)\nmid"
    first = by[(1, 0)].text
    assert first in ("be kind\n--\n" + block, "be kind\n--\n" + _swap(block))
    assert by[(2, -1)].role == "system" and by[(2, -1)].text.startswith("P:[decision]")
    assert by[(7, -1)].text.count("---") == 2
    assert (3, -1) not in by and (4, -1) not in by and (5, -1) not in by  # no user turn, or no vector
    assert got.count() == sum(len(m) for m in CHATS.values()) + 2


def _swap(block):
    a, b, c = block.split("\n\n---\n\n")
    return "\n\n---\n\n".join((b, a, c))


def test_own_message_can_be_left_out(spark):
    asks = chats.asking_turns(turns(spark, CHATS), _vectors(spark), include_self=False)
    blocks = {r.conv_id: r for r in chats.memory_blocks(asks, _store(spark)).collect()}
    assert "alone" not in blocks[7].block and "alone" in blocks[2].block and blocks[7].memories == 2
    limited = chats.memory_blocks(chats.asking_turns(turns(spark, CHATS), _vectors(spark)), _store(spark), limit=1)
    assert {r.memories for r in limited.collect()} == {1}


def test_nested_form_equals_flat_form(spark):
    table = turns(spark, CHATS)
    blocks = chats.memory_blocks(chats.asking_turns(table, _vectors(spark)), _store(spark))
    nested = table.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m")
    ).select("conv_id", F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))
    flat = chats.augment_turns(table, blocks).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    want = {r.conv_id: [(m.role, m.text) for m in r.m] for r in flat.collect()}
    got = {r.conv_id: [tuple(m) for m in r.messages] for r in chats.augment_messages(nested, blocks).collect()}
    assert got == want
