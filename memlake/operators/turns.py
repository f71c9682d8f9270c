"""Turn selection over flat chats (conv_id, turn, role, text).

A chat's newest message is a partial maximum, so one chat with a third of all turns still
folds on the map side.
"""

from pyspark.sql import DataFrame, functions as F

from memlake.functions.text import is_blank
from memlake.schemas import MESSAGES


def _newest(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(
        F.max(F.struct("turn", "role", "text")).alias("m")
    ).select("conv_id", "m.*")


def user_turns(turns: DataFrame) -> DataFrame:
    """The last message of each chat, where it is a user's and not blank."""
    return _newest(turns).where((F.col("role") == "user") & ~is_blank("text"))


def assistant_turns(turns: DataFrame) -> DataFrame:
    """The newest non-empty assistant message of each chat, where it is not blank.

    A white-space-only newest one means none; an empty one is skipped.
    """
    said = turns.where((F.col("role") == "assistant") & (F.col("text") != ""))
    return _newest(said).where(~is_blank("text"))


def flat(chats: DataFrame) -> DataFrame:
    """Nested chats (conv_id, messages) as turns; the position is the turn."""
    cast = chats.select("conv_id", F.col("messages").cast(MESSAGES).alias("messages"))
    return cast.select("conv_id", F.posexplode("messages").alias("turn", "m")).select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), "m.role",
        F.col("m.content").alias("text"),
    )
