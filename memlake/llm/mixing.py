"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Sizes are words. Each source is read as one endless stream: its documents in a fixed shuffled
order, over and over, cut into blocks of equally many words. The schedule has one slot per
block: the golden-ratio point of a slot, mapped through the sources' cumulative targets, names
the source whose next block stands there, so every stretch of the schedule is near the target
shares. The last block of a source is trimmed at its target.

Defined results: null text has size 0; null sources form one source, last in order; a document
of size 0 is never taken; repeated rows are separate documents; an empty table gives no rows.
"""

import math

from pyspark.sql import DataFrame, Window, functions as F

from memlake.sources.scratch import cut

WORD = r"[^\x20\x09-\x0D]+"
GOLDEN = 0.6180339887498949
#: Blocks per window group, and documents per window group at the least.
CHUNK = 4096
#: Cells of [0, 1) by which a point finds its source with an equality join.
CELLS = 1024


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, and the text key that fixes the shuffled order."""
    return docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":mix"))
              .cast("binary")).alias("place"),
    )


def targets(sizes: DataFrame, weights: tuple = (1, 2, 3), cap: int = 3) -> DataFrame:
    """One row per source: source_no, source_size, target, goal (whole words), lo, hi.

    A target is min(cap x size, level x weight) with the one level that spends all words; that
    is where resharing the excess by weight ends. One row per source is all that meets in a task.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("source_no", F.row_number().over(order))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(cycle, (F.col("source_no") - 1) % len(weights) + 1))
    per = per.withColumn("top", cap * F.col("source_size"))
    filling = Window.orderBy(F.col("top") / F.col("weight"), "source_no")
    before = F.coalesce(F.sum("top").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("source_size").over(everything) - before
    level = left / F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    per = per.withColumn("target", F.least(F.col("top").cast("double"), F.col("level") * F.col("weight")))
    in_order = Window.orderBy("source_no")
    share = F.col("target") / F.sum("target").over(everything)
    per = per.withColumn("hi", F.sum(share).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    per = per.withColumn("lo", F.coalesce(F.lag("hi").over(in_order), F.lit(0.0)))
    return per.select("source", "source_no", "source_size", "docs", "target",
                      F.round("target").cast("long").alias("goal"), "lo", "hi")


def schedule(per_source: DataFrame, block: int = 512) -> DataFrame:
    """The slots in order: slot, source_no, block_no. Slot and block_no count from 0.

    Golden-ratio slots beyond a source's goal stay out; the few blocks by which the points of
    a source fall short of its goal (their discrepancy, logarithmic in all slots) stand last.
    """
    spark = per_source.sparkSession
    words = per_source.agg(F.sum("goal")).first()[0] or 0
    slots = math.ceil(words / block)
    cells = per_source.where(F.col("hi") > F.col("lo")).select(
        "source_no", "goal", "lo", "hi",
        F.explode(F.sequence(F.floor(F.col("lo") * CELLS),
                             F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1).cast("long")))).alias("cell"))
    drawn = spark.range(slots).select(
        F.col("id").alias("slot"), F.expr(f"pmod(id * {GOLDEN}D, 1D)").alias("point"))
    drawn = drawn.withColumn("cell", F.floor(F.col("point") * CELLS)).join(cells, "cell").where(
        (F.col("lo") <= F.col("point")) & (F.col("point") < F.col("hi"))
    ).select("slot", "source_no", "goal", F.expr(f"slot div {CHUNK}").alias("chunk"))
    counts = drawn.groupBy("source_no", "chunk").agg(F.count(F.lit(1)).alias("n"))
    by_chunk = Window.partitionBy("source_no").orderBy("chunk")
    earlier = counts.withColumn(
        "earlier", F.sum("n").over(by_chunk.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    inside = Window.partitionBy("source_no", "chunk").orderBy("slot")
    ranked = drawn.withColumn("nth", F.row_number().over(inside)).join(
        earlier.select("source_no", "chunk", "earlier"), ["source_no", "chunk"]
    ).withColumn("block_no", F.col("earlier") + F.col("nth") - 1).where(
        F.col("block_no") * block < F.col("goal")).select("slot", "source_no", "block_no")
    have = counts.groupBy("source_no").agg(F.sum("n").alias("have"))
    need = F.ceil(F.col("goal") / block)
    short = per_source.join(have, "source_no", "left").withColumn("have", F.coalesce("have", F.lit(0))).where(
        need > F.col("have")).select(
        F.explode(F.sequence(F.col("have"), need - 1)).alias("block_no"), "source_no").select(
        (F.lit(slots) + F.col("block_no")).alias("slot"), "source_no", "block_no")
    return ranked.unionByName(short)


def streams(sizes: DataFrame, per_source: DataFrame) -> DataFrame:
    """Every document with its start in its source's shuffled stream.

    Running sums go over pieces of a source, cut by the leading digits of the order key, so a
    source with a third of all rows is many window groups; piece totals are summed above them.
    """
    rows = per_source.agg(F.sum("docs")).first()[0] or 0
    digits = max(0, math.ceil(math.log(max(rows, 1) / CHUNK, 16))) if rows > CHUNK else 0
    d = sizes.join(per_source.drop("docs", "lo", "hi").withColumnRenamed("source", "name"),
                   F.col("source").eqNullSafe(F.col("name"))).drop("name")
    d = d.withColumn("piece", F.substring("place", 1, digits))
    inside = Window.partitionBy("source_no", "piece").orderBy("place", "doc_id", "size")
    d = d.withColumn("start", F.sum("size").over(
        inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    if not digits:
        return d.drop("piece")
    pieces = sizes.groupBy("source", F.substring("place", 1, digits).alias("piece")).agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)
    pieces = pieces.withColumn("offset", F.sum("words").over(before) - F.col("words")).join(
        per_source.select(F.col("source").alias("name"), "source_no"),
        F.col("source").eqNullSafe(F.col("name"))).select("source_no", "piece", "offset")
    return d.join(pieces, ["source_no", "piece"]).withColumn(
        "start", F.col("start") + F.col("offset")).drop("piece", "offset")


def blocks_of(placed: DataFrame, block: int, cap: int = 3) -> DataFrame:
    """The pieces of documents in the blocks up to the goal: with source_no, block_no, words."""
    again = placed.where("size > 0").withColumn(
        "turn", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))))
    again = again.withColumn("lies", F.col("start") + F.col("turn") * F.col("source_size")).where("lies < goal")
    again = again.withColumn("ends", F.least(F.col("lies") + F.col("size"), F.col("goal")))
    first, last = F.expr(f"lies div {block}"), F.expr(f"(ends - 1) div {block}")
    cut_up = again.withColumn("block_no", F.explode(F.sequence(first, last)))
    return cut_up.withColumn(
        "words", F.least(F.col("ends"), (F.col("block_no") + 1) * block)
        - F.greatest(F.col("lies"), F.col("block_no") * block))


def mix(docs: DataFrame, weights: tuple = (1, 2, 3), cap: int = 3, block: int = 512) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, start, goal, taken (words), and where the
    schedule puts it: first_slot, last_slot, blocks (null, null and 0 where nothing is taken)."""
    sizes = cut(sized(docs))
    per_source = cut(targets(sizes, weights, cap))
    placed = cut(streams(sizes, per_source))
    taken = blocks_of(placed, block, cap).join(
        schedule(per_source, block), ["source_no", "block_no"]).groupBy(
        "source_no", "start", "doc_id").agg(
        F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"),
        F.count(F.lit(1)).alias("blocks"))
    full = placed.where("size > 0").alias("p").join(
        taken.alias("t"),
        (F.col("p.source_no") == F.col("t.source_no")) & (F.col("p.start") == F.col("t.start"))
        & F.col("p.doc_id").eqNullSafe(F.col("t.doc_id")), "left",
    ).select("p.*", *[F.coalesce(f"t.{c}", F.lit(0)).cast("long").alias(c) for c in ("taken", "blocks")],
             "t.first_slot", "t.last_slot")
    none = placed.where("size = 0").withColumns(
        {"taken": F.lit(0).cast("long"), "blocks": F.lit(0).cast("long"),
         "first_slot": F.lit(None).cast("long"), "last_slot": F.lit(None).cast("long")})
    return full.unionByName(none).select(
        "doc_id", "source", "size", "source_size", "target", "start", "goal", "taken", "first_slot", "last_slot", "blocks")


def mixed_documents(docs: DataFrame, weights: tuple = (1, 2, 3), cap: int = 3, block: int = 512) -> DataFrame:
    """The rows of docs that the mix takes, whole, in the order in which the schedule comes by them.

    A document is there once for each block of the schedule in which a turn of it has its first
    word, so each source overshoots its goal by less than one document. Rows stand by the slot of
    that block, then by their place in the source's stream.
    """
    rows = docs.withColumn("_row", F.struct(*docs.columns))
    sizes = cut(sized(docs))
    per_source = cut(targets(sizes, weights, cap))
    # rows alike in id, source and size are numbered, so that each meets the plan of one row
    alike = ["doc_id", "source", "size"]
    nth = F.row_number().over(Window.partitionBy(*alike).orderBy(F.desc("start")))
    placed = streams(sizes, per_source).where("size > 0").withColumn("nth", nth)
    begun = placed.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(cap - 1)))).withColumn(
        "lies", F.col("start") + F.col("turn") * F.col("source_size")).where("lies < goal").withColumn(
        "block_no", F.expr(f"lies div {block}"))
    plan = begun.join(schedule(per_source, block), ["source_no", "block_no"]).select(*alike, "nth", "slot", "lies")
    mine = rows.select("_row", "doc_id", "source", F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"))
    mine = mine.withColumn("nth", F.row_number().over(
        Window.partitionBy(*alike).orderBy(F.xxhash64("_row"))))
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"p.{c}")) for c in alike] + [F.col("m.nth") == F.col("p.nth")]
    met = mine.alias("m").join(plan.alias("p"), same)
    return met.select("_row", "slot", "lies").orderBy("slot", "lies").select("_row.*")
