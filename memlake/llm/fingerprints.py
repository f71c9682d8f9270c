"""Document fingerprints by content-defined chunking.

A gear hash rolls over the bytes of a text; where its low bits vanish, a chunk ends. Before the
aimed length a harder mask is asked, behind it an easier one, which keeps lengths near the aim.
The fingerprint is the set of chunk digests with their lengths; likeness of two fingerprints is
the length of what they share over the length of the shorter one.

Defined results: null text counts as empty and has the empty fingerprint; two empty fingerprints
are alike (1), an empty and another one are not (0); documents follow each other by descending
doc_id, rows without doc_id last, rows of one doc_id by text; the last is followed by the first,
a single document by itself; the work is linear in a text.
"""

import bisect
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType

from memlake.llm import rows

#: Chunk lengths in bytes: at least, aimed at, at most.
LEAST, AIM, MOST = 12, 32, 128
HARD, EASY = np.uint32(0x7F), np.uint32(0x07)
#: Documents per range of doc_id.
RANGE_ROWS = 4000


def _gear() -> np.ndarray:
    """256 numbers by a multiplicative rule."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def rolling(data: bytes) -> np.ndarray:
    """The gear hash behind each byte: the sum of GEAR over the last 32 bytes, each shifted by its age."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            older = h[:-k] << np.uint32(k)
            h = h.copy()
            h[k:] += older
    return h


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks."""
    # the top bits depend on all 32 bytes
    h = rolling(data) >> np.uint32(16)
    easy = np.flatnonzero((h & EASY) == 0)
    hard = easy[(h[easy] & HARD) == 0].tolist()
    easy = easy.tolist()
    out, start, n = [], 0, len(data)
    while start < n:
        end = min(start + MOST, n)
        i = bisect.bisect_left(hard, start + LEAST - 1)
        if i < len(hard) and hard[i] < start + AIM:
            end = min(end, hard[i] + 1)
        else:
            i = bisect.bisect_left(easy, start + AIM)
            if i < len(easy):
                end = min(end, easy[i] + 1)
        out.append(end)
        start = end
    return out


def chunks(text: str) -> dict[str, int]:
    """Chunk digests of a text with their lengths."""
    data = text.encode("utf-8", "surrogatepass")
    out, start = {}, 0
    for end in boundaries(data):
        out[hashlib.blake2b(data[start:end], digest_size=6).hexdigest()] = end - start
        start = end
    return out


def written(prints: dict[str, int]) -> str:
    return ",".join(f"{k}:{prints[k]}" for k in sorted(prints))


def parsed(fingerprint: str) -> dict[str, int]:
    return {k: int(n) for k, n in (x.split(":") for x in fingerprint.split(","))} if fingerprint else {}


def likeness(a: dict[str, int], b: dict[str, int]) -> float:
    if not a or not b:
        return float(not a and not b)
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    shared = sum(n for k, n in small.items() if k in large)
    return shared / min(sum(a.values()), sum(b.values()))


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the start of the following one."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint per row of docs."""

    def make():
        return lambda cols: {"doc_id": cols["doc_id"],
                             "fingerprint": [written(chunks(t)) for t in rows.texts(cols["text"])]}

    return rows.map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"),
                            "doc_id long, fingerprint string", make)


def in_ranges(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Documents in ranges of descending doc_id, one after another within a partition; each range
    ends with the row that follows it (follower true), which is the first of the next range.

    Only the ranges' bounds and first ids pass the driver: as many as there are partitions.
    """
    spark = docs.sparkSession
    d = docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(cast(text as string), '') text")
    ids = d.select("doc_id")
    count = ids.count()
    parts = max(1, -(-count // range_rows))
    probs = [i / parts for i in range(1, parts)]
    bounds = np.array(sorted(ids.dropna().approxQuantile("doc_id", probs, 0.1 / parts)), dtype=np.float64) if probs else np.zeros(0)

    @F.pandas_udf(LongType())
    def range_of(doc_id: pd.Series) -> pd.Series:
        place = len(bounds) - np.searchsorted(bounds, doc_id.fillna(0).to_numpy(float), side="left")
        return pd.Series(np.where(doc_id.isna(), len(bounds) + 1, place))

    d = d.withColumn("range", range_of("doc_id"))
    tops = sorted((r, top) for r, top in ids.withColumn("range", range_of("doc_id")).groupBy("range").agg(
        F.max("doc_id")).collect())
    heads = [(tops[i - 1][0], top) for i, (_, top) in enumerate(tops)]
    heads = spark.createDataFrame(heads, "range long, top long")
    follow = d.select("doc_id", "text").join(
        F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("top"))).select("doc_id", "text", "range")
    both = d.withColumn("follower", F.lit(False)).unionByName(follow.withColumn("follower", F.lit(True)))
    return both.repartition(parts, "range").sortWithinPartitions(
        "range", "follower", F.col("doc_id").desc_nulls_last(), "text")


def with_edits(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Per document its fingerprint, the edited text's, and their likeness."""
    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
              "edited_fingerprint string, near_edited double, near_next double")

    def row(one, prints, following, next_prints):
        new = edited(one, following)
        new_prints = chunks(new)
        return (len(one), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), written(prints),
                written(new_prints), likeness(prints, new_prints), likeness(prints, next_prints))

    def run(batches):
        last = None  # (range, doc_id, text, prints), waiting for what follows it
        for batch in batches:
            for at in range(0, batch.num_rows, rows.SLICE):
                part = batch.slice(at, rows.SLICE).to_pydict()
                out = []
                for doc_id, text, where, follower in zip(part["doc_id"], part["text"], part["range"], part["follower"]):
                    if last is None and follower:
                        continue
                    prints = chunks(text)
                    if last is not None:
                        out.append((last[1], *row(last[2], last[3], text, prints)))
                    last = None if follower else (where, doc_id, text, prints)
                if out:
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [c.split()[0] for c in schema.split(", ")]
    return in_ranges(docs, range_rows).mapInArrow(run, schema)
