"""The training-data pipeline: documents to packed token sequences."""

from pyspark.sql import DataFrame, SparkSession

from memlake.llm import stages
from memlake.sources.scratch import cut

STAGES = [
    ("language", stages.identified),
    ("lines", stages.lines_once),
    ("near_duplicates", stages.texts_once),
    ("mixing", stages.mixed),
    ("packing", stages.packed),
]

#: Language and token ids are beyond SQL; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
