"""Operators as pipeline stages: documents in, documents out; the last one packs."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from memlake.llm import jaccard, language, line_dedup, mixing, packing

#: A document whose best language scores less is rejected.
LEAST_SCORE = 0.2


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled rows teach; a null lang is filled in. Without a
    labelled row only texts without a letter are rejected. Null and empty texts go; each row is
    judged for itself, so repeated rows and null ids stay; an empty table stays empty."""
    model = language.fit(language.sample(docs))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    # inside a struct the caller's own columns keep their names
    known = language.identify(docs.select("text", F.struct("*").alias("row")), model).where(
        (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return known.select(F.col("row").withField("lang", F.coalesce("row.lang", "lang_pred")).alias("row")).select("row.*")


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand in an earlier one or earlier in themselves."""
    return line_dedup.without_repeats(docs)


def texts_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return jaccard.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Token pieces of the documents with their sequences."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(docs, vocabulary)
