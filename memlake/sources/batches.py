"""Tables of batch folders, `<root>/batch=<label>/...`, and their compaction beside running readers.

A compaction writes the rows of some batches as one batch of its own, and then a record of which
batches it stands for. A reader looks at the records first: recorded batches are left out and
the one that stands for them is taken, so the rows are seen once at any time. `retire` removes the
folders that no reader takes any more. One compaction at a time is assumed; batches may be appended
meanwhile, and an appended batch that runs again keeps its own label as long as it is not recorded.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from memlake.sources.scratch import holds_files, names_in, remove

_RECORDS = "_compactions"


def labels(spark: SparkSession, root: str) -> list[str]:
    """All batches that have a folder, in order of name."""
    return sorted(n.removeprefix("batch=") for n in names_in(spark, root) if n.startswith("batch="))


def records(spark: SparkSession, root: str) -> dict[str, set[str]]:
    """Complete compactions: label -> the batches it stands for."""
    out = {}
    for name in names_in(spark, f"{root}/{_RECORDS}"):
        where = f"{root}/{_RECORDS}/{name}"
        if holds_files(spark, f"{where}/_SUCCESS"):
            out[name] = {r.batch for r in spark.read.schema("batch string").parquet(where).collect()}
    return out


def live(spark: SparkSession, root: str) -> list[str]:
    """The batches that readers take."""
    done = records(spark, root)
    replaced = set().union(*done.values())
    return [b for b in labels(spark, root)
            if b not in replaced and (b in done or not b.startswith("compact-"))]


def paths(spark: SparkSession, root: str, without_batch: str | None = None) -> list[str]:
    return [f"{root}/batch={b}" for b in live(spark, root) if b != without_batch]


def compact(spark: SparkSession, root: str, rows: DataFrame, write, keep: int = 0) -> str | None:
    """Write the live batches but the newest `keep` as one; returns its label.

    `rows` are all rows of the table with their `batch`; `write(rows, label)` writes a batch. A
    compaction that is cut short leaves a batch without a record, which readers pass over.
    """
    before = [b for b in live(spark, root) if b.startswith("compact-")]
    arrived = [b for b in live(spark, root) if not b.startswith("compact-")]
    old = before + (arrived[:-keep] if keep else arrived)
    if len(old) < 2:
        return None
    made = [b for b in labels(spark, root) if b.startswith("compact-")]
    label = f"compact-{1 + max([int(b.split('-')[1]) for b in made], default=0):08d}"
    write(rows.where(F.col("batch").isin(old)).drop("batch"), label)
    spark.createDataFrame([(b,) for b in old], "batch string").coalesce(1).write.mode("overwrite").parquet(
        f"{root}/{_RECORDS}/{label}")
    return label


def retire(spark: SparkSession, root: str) -> int:
    """Remove folders that readers pass over, once readers from before the switch are done."""
    taken = set(live(spark, root))
    gone = [b for b in labels(spark, root) if b not in taken]
    for b in gone:
        remove(spark, f"{root}/batch={b}")
    for name in names_in(spark, f"{root}/{_RECORDS}"):
        if name not in taken:
            remove(spark, f"{root}/{_RECORDS}/{name}")
    return len(gone)
