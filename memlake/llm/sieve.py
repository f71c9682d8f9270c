"""A bitmap of fixed size that lets through every key of a set and few others."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType

#: Bits of a bitmap: 2 MB, whatever the number of keys.
BITS = 24


def sieve(keys: DataFrame, column: str, bits: int = BITS):
    """A function from a long column to whether it may be among the keys.

    The bits are combined in Spark; at most 2**bits / 64 words pass the driver. With very many
    keys it lets everything through, which costs the join behind it more and changes no result.
    """
    slot = F.col(column).bitwiseAND((1 << bits) - 1)
    words = keys.select(F.shiftright(slot, 6).cast("int").alias("word"),
                        F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int")).alias("bit"))
    table = np.zeros(1 << (bits - 6), np.int64)
    for word, bit in words.groupBy("word").agg(F.bit_or("bit")).collect():
        table[word] = bit
    table = table.view(np.uint64)

    @F.pandas_udf(BooleanType())
    def may_be(key: pd.Series) -> pd.Series:
        k = key.to_numpy(np.int64)
        at = k & ((1 << bits) - 1)
        return pd.Series((table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0)

    def test(c: str) -> Column:
        return may_be(F.col(c))

    return test


def sifter(keys: DataFrame, column: str, bits: int = BITS):
    """A function (df, column) -> the rows of df whose long column may be among the keys.

    The bitmap is a table of at most 2**bits / 64 words, joined by broadcast. With very many keys
    it lets everything through, which costs the join behind it more and changes no result.
    """
    def slot(c):
        return F.col(c).bitwiseAND((1 << bits) - 1)

    def bit(c):
        return slot(c).bitwiseAND(63).cast("int")

    words = keys.select(
        F.shiftright(slot(column), 6).cast("int").alias("_word"),
        F.call_function("shiftleft", F.lit(1).cast("long"), bit(column)).alias("_bits"),
    ).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))

    def through(df: DataFrame, c: str) -> DataFrame:
        met = df.withColumn("_word", F.shiftright(slot(c), 6).cast("int")).join(F.broadcast(words), "_word")
        hit = F.call_function("shiftright", F.col("_bits"), bit(c)).bitwiseAND(1) == 1
        return met.where(hit).select(*df.columns)

    return through
