"""Connected components of undirected edges, by alternating star steps on written tables."""

from pyspark.sql import DataFrame, functions as F

from memlake.sources.scratch import cut


def _hang(edges: DataFrame, above: str, below: str) -> DataFrame:
    """Each edge's upper end joined with the least neighbour of the lower end."""
    least = edges.groupBy(below).agg(F.min(above).alias("least"))
    return edges.join(least, below)


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for every node of edges (a, b). Loops and nulls are skipped.

    Large star: every larger neighbour of u is hung on u's least neighbour. Small star: u and its
    smaller neighbours are hung on the least of them. Rounds grow with the logarithm of a chain.
    """
    edges = cut(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select(
            "u", F.least("u", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(
            F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            # the least node's own edges stay
            edges.join(least, F.col("b") == F.col("u")).where("m = b").select("a", "b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        met = down.join(low, F.col("a") == F.col("u"))
        edges = cut(met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component")))
