"""Vector functions as Columns."""

from pyspark.sql import Column, functions as F

from memlake.functions import kernels
from memlake.functions.text import words


def dot(a, b) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda total, x: total + x,
    )


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Cosine similarity of two vector columns; null when either is null or has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def similarity_to(vector, column="embedding") -> Column:
    """Cosine similarity of a column to one vector; only that column is sent to Python."""
    return F.arrow_udf(kernels.similarity_to(list(vector)), "double")(column)


def has_length(embedding) -> Column:
    """True for vectors of finite components, at least one of them not zero."""
    finite = F.forall(embedding, lambda x: F.abs(x) < float("inf"))
    return F.coalesce(F.exists(embedding, lambda x: x != 0) & finite, F.lit(False))


def hashed_vector(text, dim: int = 64) -> Column:
    """Bag-of-words vector of unit length; null for texts without words.

    Texts are cut into words in the JVM; counting is one pass over each Arrow batch.
    """
    return F.arrow_udf(kernels.bucket_counts(dim), "array<float>")(words(text))
