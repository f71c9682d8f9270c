"""Exact decimal pricing."""

from pyspark.sql import Column, functions as F


def estimated_cost(prompt_rate, completion_rate, prompt_tokens, completion_tokens) -> Column:
    """Per-1k rates times tokens, rounded to 8 places; null where it overflows the column.

    An absent rate counts as zero.
    """

    def part(rate, tokens):
        priced = F.coalesce(rate, F.lit(0)).try_cast("decimal(24,15)") * F.coalesce(
            tokens, F.lit(0)
        ).cast("decimal(10,0)")
        return priced * F.lit(0.001).cast("decimal(3,3)")

    total = part(F.col(prompt_rate), F.col(prompt_tokens)) + part(
        F.col(completion_rate), F.col(completion_tokens)
    )
    return total.try_cast("decimal(12,8)")
