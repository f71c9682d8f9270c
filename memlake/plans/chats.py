"""Chat jobs: give chats their memories, and turn chat messages into capture requests."""

from pyspark.sql import DataFrame, functions as F

from memlake.constants import (
    ASSISTANT_TURN_SOURCE, MEMORY_FLOOR, MEMORY_LIMIT, MEMORY_SEPARATOR, USER_TURN_SOURCE,
)
from memlake.functions.text import memory_text
from memlake.functions.windows import as_timestamp
from memlake.operators import turns as pick
from memlake.plans.capture import entry_id
from memlake.plans.search import search_many

PREAMBLE = (
    "Some stored memories of this user may bear on the conversation. Draw on them where they "
    "help, and bring them up only when asked.\n\n"
)
DIVIDER = "\n\n--- Memories ---\n"


def turn_request_id(conv_id="conv_id", turn="turn"):
    return F.concat_ws("/", F.col(conv_id).cast("string"), F.col(turn).cast("string"))


def capture_turns(turns: DataFrame, as_of, user: bool = True, assistant: bool = False) -> DataFrame:
    """Capture requests for the newest user (and assistant) message of each chat."""
    picked = []
    if user:
        picked.append((pick.user_turns(turns), USER_TURN_SOURCE))
    if assistant:
        picked.append((pick.assistant_turns(turns), ASSISTANT_TURN_SOURCE))
    out = None
    for rows, source in picked:
        part = rows.select(
            turn_request_id().alias("request_id"), "text", F.lit(source).alias("source_client"),
            as_timestamp(as_of).cast("timestamp").alias("created_at"),
        )
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("nothing to capture: user and assistant are both off")
    return out


def memory_blocks(
    asks: DataFrame, entries: DataFrame, limit: int = MEMORY_LIMIT, floor: float = MEMORY_FLOOR,
    **options,
) -> DataFrame:
    """(conv_id, block, memories) for asking turns (conv_id, embedding, ...).

    The floor is applied to the 4-decimal score, after the limit, so fewer may remain. At
    most `limit` rows of a chat meet in one group.
    """
    queries = asks.withColumnRenamed("conv_id", "query_id").withColumn("limit", F.lit(limit))
    hits = search_many(entries, queries, **options).where(
        F.bround("similarity_score", 4) >= floor
    )
    text = memory_text("entry_type", "topics", "created_at", "raw_text")
    return hits.groupBy(F.col("query_id").alias("conv_id")).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", text.alias("text")))),
                lambda m: m["text"],
            ),
            MEMORY_SEPARATOR,
        ).alias("block"),
        F.count("*").alias("memories"),
    )


def asking_turns(turns: DataFrame, vectors: DataFrame, include_self: bool = True) -> DataFrame:
    """The user turns that search, with the vectors (conv_id, embedding) of their texts.

    With `include_self=False` a chat does not get back the entry made from its own message.
    """
    asks = pick.user_turns(turns).select("conv_id", "turn").join(vectors, "conv_id")
    if not include_self:
        asks = asks.withColumn("exclude_id", entry_id(turn_request_id()))
    return asks.drop("turn")


def augment_turns(
    turns: DataFrame, blocks: DataFrame, preamble: str = PREAMBLE, divider: str = DIVIDER
) -> DataFrame:
    """Flat chats with their memory block: the leading system message is extended, or a new
    one is put before the first turn. Chats are never gathered into one row."""
    firsts = turns.groupBy("conv_id").agg(F.min(F.struct("turn", "role")).alias("first"))
    edits = blocks.join(firsts, "conv_id").select(
        "conv_id", F.col("first.turn").alias("turn"),
        (F.col("first.role") == "system").alias("extend"), "block",
    )
    extended = turns.join(
        edits.where("extend").select(
            "conv_id", "turn", F.concat(F.lit(divider), "block").alias("suffix")
        ),
        ["conv_id", "turn"], "left",
    ).select(
        "conv_id", "turn", "role",
        F.when(F.col("suffix").isNull(), F.col("text"))
        .otherwise(F.concat(F.coalesce("text", F.lit("")), "suffix")).alias("text"),
    )
    added = edits.where("not extend").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.lit("system").alias("role"),
        F.concat(F.lit(preamble), "block").alias("text"),
    )
    return extended.unionByName(added)


def augment_messages(
    chats: DataFrame, blocks: DataFrame, preamble: str = PREAMBLE, divider: str = DIVIDER
) -> DataFrame:
    """`augment_turns` for nested chats (conv_id, messages array<struct<role, content>>)."""
    messages, head = F.col("messages"), F.col("messages")[0]

    def message(role, content):
        return F.array(F.struct(role.alias("role"), content.alias("content")))

    extended = F.concat(
        message(F.lit("system"),
                F.concat(F.coalesce(head["content"], F.lit("")), F.lit(divider), F.col("block"))),
        F.slice("messages", F.lit(2), F.size("messages")),
    )
    added = F.concat(message(F.lit("system"), F.concat(F.lit(preamble), F.col("block"))), messages)
    return chats.join(blocks.select("conv_id", "block"), "conv_id", "left").withColumn(
        "messages",
        F.when(F.col("block").isNull(), messages)
        .when(head["role"] == "system", extended)
        .otherwise(added),
    ).drop("block")


def augment_chats(
    turns: DataFrame,
    vectors: DataFrame,
    entries: DataFrame,
    limit: int = MEMORY_LIMIT,
    floor: float = MEMORY_FLOOR,
    include_self: bool = True,
    preamble: str = PREAMBLE,
    divider: str = DIVIDER,
    **options,
) -> DataFrame:
    """All turns of all chats, with memories in the chats whose last message asks for them.

    `entries` is the store after the batch's own capture. `vectors` may carry a
    `visible_until` time per chat to restrict it to entries created by then.
    """
    asks = asking_turns(turns, vectors, include_self)
    blocks = memory_blocks(asks, entries, limit, floor, **options)
    return augment_turns(turns, blocks, preamble, divider)
