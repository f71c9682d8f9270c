"""Small and awkward documents for the training-data operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, {extra}"
#: Columns of the user's own whose names the operators use inside.
CLASHING = ("size", "key", "node", "score", "lang_pred", "class_id", "_row", "_id", "_gone", "copies",
            "sequence_id", "place", "source_no", "n", "range", "follower", "number")


def words(r: random.Random, n: int, stock: str = "river stone cloud maple ember tiger violet harbor quiet signal") -> str:
    return " ".join(r.choice(stock.split()) for _ in range(n))


def awkward() -> list[tuple]:
    """Null and empty texts, very long ones, repeated rows, ties, rows without an id or a source."""
    r = random.Random(4)
    plain = words(r, 60)
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t\n ", None, None, 5),
        (4, "x" * 60_000, "en", "b", 60_000), (5, "7 " * 20_000, "de", "b", 40_000),
        (6, plain, "en", "a", len(plain)), (6, plain, "en", "a", len(plain)), (7, plain, "en", "a", len(plain)),
        (8, plain + " one more", "fr", "", 0), (None, plain, "en", "a", 1), (None, None, None, None, None),
        (9, "four words are here", "en", "c", 19), (10, "Ünïcödé 𝒳 \u0000 ΟΔΟΣ. \x1c z", "de", "c", 9),
        (-11, "one\n" + plain + "\n" + plain + "\n\none", "es", "c", 9),
    ]
    return rows


def table(spark, rows, clashing: bool = False):
    names = CLASHING if clashing else ()
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(
        f", {c} string" for c in names)
    return spark.createDataFrame([(*row, *("own" for _ in names)) for row in rows], schema)
