"""Ranked lexical search over bit-sliced Bloom signatures.

A document's signature is a Bloom filter of its terms. For a term that occurs often it also holds the
levels of its count that are reached, so that a signature bounds counts from above, not only presence.
Documents with signatures of one width lie in blocks, bit by bit: a slice is a bitmap over the block's
documents. The slices of a term's bits, and-ed, overestimate which documents have it, and at which
level. Weighted sums over these bitmaps, with each document's own length, bound every score from above.

A search reads the blocks twice. First it takes the documents with the largest bounds for each item
and scores them exactly on their texts; the k-th best of those is the item's floor. Then every
document whose bound is not provably behind the floor is scored exactly and ranked. The result is
that of scoring all documents.

The score depends on the text alone, so of equal texts only the k least ids can be among the k best,
and one of them is scored. Items are asked in parts of bounded size; a part's terms, weights and
floors are all that tasks are sent, and the ids of what is to be scored are joined by Spark.

Defined results: null and empty texts have no term and are never found; documents without doc_id
count in the statistics and are never found; items without item_id or without a term ask nothing; a
repeated item asks once, an item_id with two texts asks with both and both are ranked together as
one; repeated documents are found each for itself; terms no document holds are left out.
"""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from memlake.llm import rows
from memlake.llm.shingles import mixed
from memlake.sources.scratch import cut

#: Bits of a signature per element it holds at most, bits set per element, bits of a block.
WIDTH, HASHES, BLOCK = 16, 5, 1 << 21
#: Elements of the narrowest signatures; each class holds twice as many. Bits of the widest, which
#: longer texts crowd: their bounds are wider then.
NARROWEST, WIDEST = 64, 1 << 22
#: Most documents in a block.
MOST = 2048
#: Counts from which on a further element is set: each up to 4, then two per doubling.
LEVELS = np.array([1, 2, 3, 4] + [x << i for i in range(1, 28) for x in (3, 4)], np.int64)
#: Documents per item whose exact scores give the floor, and items and characters per part.
FIRST, PART_ITEMS, PART_CHARS = 24, 1024, 1 << 22
#: Terms times documents whose bounds are held at a time.
CELLS = 1 << 22

# a byte of a term, in lower case, or a space
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text: runs of ASCII letters and digits and of all characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM).split()


def digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def bits(codes: np.ndarray, level: np.ndarray, width: int) -> np.ndarray:
    """Bits (elements, HASHES) of terms, given by code, at a level of their count."""
    x = mixed(codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + level.astype(np.uint64))
    one, two = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
    at = one[:, None] + two[:, None] * np.arange(HASHES, dtype=np.uint64)
    return (at & np.uint64(width - 1)).astype(np.int64)


def codes(words) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words))


class Shelf:
    """Signatures of one width, gathered until they fill a block."""

    def __init__(self, width: int):
        self.width = width
        self.room = max(8, min(MOST, BLOCK // width))
        self.clear()

    def clear(self):
        self.ids, self.hashes, self.lengths, self.bits, self.owners = [], [], [], [], []

    def add(self, doc_id: int, text_hash: bytes, length: int, at: np.ndarray) -> bool:
        self.bits.append(at)
        self.owners.append(np.full(len(at), len(self.ids), np.int32))
        self.ids.append(doc_id)
        self.hashes.append(text_hash)
        self.lengths.append(length)
        return len(self.ids) == self.room

    def block(self) -> tuple:
        """(width, ids, text hashes, lengths, slices); of the slices only those with a bit."""
        n = -(-len(self.ids) // 8) * 8
        grid = np.zeros((self.width, n), np.uint8)
        grid[np.concatenate(self.bits), np.concatenate(self.owners)] = 1
        out = (self.width, np.array(self.ids, np.int64).tobytes(), b"".join(self.hashes),
               np.array(self.lengths, np.int64).tobytes(), np.packbits(grid, axis=1).tobytes())
        self.clear()
        return out


def index(docs: DataFrame) -> DataFrame:
    """Blocks (width, ids, hashes, lengths, slices) of all documents with an id and a term, and one
    row a task with n_docs and n_terms, its documents with a term and their terms."""
    kind = _parse_datatype_string(
        "width long, ids binary, hashes binary, lengths binary, slices binary, n_docs long, n_terms long")
    arrow = to_arrow_schema(kind)

    def row(*values):
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, arrow)], schema=arrow)

    def run(batches):
        shelves, n_docs, n_terms = {}, 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, rows.SLICE):
                part = batch.slice(at, rows.SLICE).to_pydict()
                for doc_id, text in zip(part["doc_id"], part["text"]):
                    found = terms(text)
                    if not found:
                        continue
                    n_docs, n_terms = n_docs + 1, n_terms + len(found)
                    if doc_id is None:
                        continue
                    counts = Counter(found)
                    code, times = codes(counts), np.fromiter(counts.values(), np.int64, len(counts))
                    up, all_, level = np.arange(len(code)), [code], [np.zeros(len(code), np.int64)]
                    for l in range(1, len(LEVELS)):
                        up = up[times[up] >= LEVELS[l]]
                        if not len(up):
                            break
                        all_.append(code[up])
                        level.append(np.full(len(up), l))
                    level = np.concatenate(level)
                    width = min(WIDEST, WIDTH * max(NARROWEST, 1 << (len(level) - 1).bit_length()))
                    shelf = shelves.setdefault(width, Shelf(width))
                    set_ = np.unique(bits(np.concatenate(all_), level, width)).astype(np.int32)
                    if shelf.add(doc_id, digest(text), len(found), set_):
                        yield row(*shelf.block(), None, None)
        for shelf in shelves.values():
            if shelf.ids:
                yield row(*shelf.block(), None, None)
        if n_docs:
            yield row(None, None, None, None, None, n_docs, n_terms)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, kind)


def holding(docs: DataFrame, wanted: list[bytes]) -> dict[bytes, int]:
    """How many documents hold each wanted term, of those that some hold; a row a term from each task."""
    kind = _parse_datatype_string("term binary, n long")
    arrow = to_arrow_schema(kind)
    known = set(wanted)

    def run(batches):
        n = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, rows.SLICE):
                for text in batch.slice(at, rows.SLICE).column(0).to_pylist():
                    n.update(known.intersection(terms(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], schema=arrow)

    found = docs.selectExpr("cast(text as string) text").mapInArrow(run, kind).groupBy("term").agg(F.sum("n"))
    return {bytes(r[0]): r[1] for r in found.collect()}


class Asked:
    """Items with weighted terms, and the corpus figures that scores need."""

    def __init__(self, items: list[tuple[int, list[bytes]]], held: dict[bytes, int], n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for t, df in held.items()}
        self.terms = sorted(t for t, w in weight.items() if w > 0)
        at = {t: i for i, t in enumerate(self.terms)}
        self.names, self.at, self.weights = [], [], []
        for name, words in items:
            counts = Counter(w for w in words if w in at)
            if counts:
                self.names.append(name)
                self.at.append(np.array([at[t] for t in counts], np.int64))
                self.weights.append(np.array([n * weight[t] for t, n in counts.items()], np.int64))
        self.codes = codes(self.terms)

    def unit(self, n):
        """m of documents with so many terms."""
        return 75 + 25 * np.asarray(n, np.int64) * self.n_docs // self.n_terms

    def exact(self, text: str, items: list[int]) -> list[int]:
        """Scores of a text for the numbered items."""
        found = terms(text)
        counts = Counter(found)
        share = 12 * int(self.unit(len(found)))
        out = []
        for i in items:
            times = [counts.get(self.terms[t], 0) for t in self.at[i]]
            out.append(sum(int(w) * (10 ** 9 * n // (1000 * n + share)) for w, n in zip(self.weights[i], times) if n))
        return out

    def bounds(self, block: dict):
        """(item number, first document, bounds of some documents from there) for all of a block;
        items none of whose terms these documents can have are left out."""
        width = block["width"]
        lengths = np.frombuffer(block["lengths"], np.int64)
        slices = np.frombuffer(block["slices"], np.uint8).reshape(width, -1)
        step = max(1, CELLS // max(1, len(self.terms)) // 8)
        for byte in range(0, slices.shape[1], step):
            n = lengths[byte * 8:(byte + step) * 8]
            level = self._levels(slices[:, byte:byte + step], width)[:, :len(n)]
            # a count is below the next level, and never above the document's length
            most = np.minimum(np.concatenate([[0], LEVELS[1:] - 1, [1 << 40]])[:, None], n)
            share = 10 ** 9 * most // (1000 * most + 12 * self.unit(n))
            there = level.any(1)
            part, place = share[level[there], np.arange(len(n))], np.cumsum(there) - 1
            for i, at in enumerate(self.at):
                mine = there[at]
                if mine.any():
                    yield i, byte * 8, self.weights[i][mine] @ part[place[at[mine]]]

    def _levels(self, slices: np.ndarray, width: int) -> np.ndarray:
        """Per term and document, how many levels of its count are set, one after another."""
        out = np.zeros((len(self.terms), slices.shape[1] * 8), np.uint8)
        some, held = np.arange(len(self.terms)), None
        for l in range(len(LEVELS)):
            at = bits(self.codes[some], np.full(len(some), l), width)
            here = slices[at[:, 0]]
            for h in range(1, HASHES):
                here = here & slices[at[:, h]]
            held = here if held is None else held & here
            seen = held.any(1)
            some, held = some[seen], held[seen]
            if not len(some):
                break
            out[some] += np.unpackbits(held, axis=1)
        return out


def _kept(score: np.ndarray, ids: np.ndarray, hashes: np.ndarray, k: int) -> np.ndarray:
    """Positions without those that have the text of k others with smaller ids; best score first."""
    order = np.lexsort((ids, hashes, -score))
    h = hashes[order]
    new = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    nth = np.arange(len(h)) - np.repeat(new, np.diff(np.append(new, len(h))))
    return order[nth < k]


_FOUND = "item int, doc_id long, hash binary, bound long"


def _from_blocks(blocks: DataFrame, asked: Asked, k: int, pick) -> DataFrame:
    """Rows _FOUND of what pick(item, bounds, ids) selects, at most k of a text from each block.
    pick also says how many rows of an item a task returns at most, or None for all."""
    kind = _parse_datatype_string(_FOUND)
    arrow = to_arrow_schema(kind)

    def made(found):
        cols = [np.concatenate(c) for c in zip(*found)]
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int32()), pa.array(cols[1]), pa.array([h.tobytes() for h in cols[2]], pa.binary()),
             pa.array(cols[3])], schema=arrow)

    def run(batches):
        best = defaultdict(lambda: None)
        for batch in batches:
            for at in range(batch.num_rows):
                block = batch.slice(at, 1).to_pylist()[0]
                ids = np.frombuffer(block["ids"], np.int64)
                hashes = np.frombuffer(block["hashes"], "V16")
                found = []
                for i, first, bound in asked.bounds(block):
                    here_ids, here_hashes = ids[first:first + len(bound)], hashes[first:first + len(bound)]
                    some = pick.rows(i, bound, here_ids, best[i] if pick.most else None)
                    if not len(some):
                        continue
                    some = some[_kept(bound[some], here_ids[some], here_hashes[some].view("S16"), k)]
                    here = (np.full(len(some), i), here_ids[some], here_hashes[some], bound[some])
                    if not pick.most:
                        found.append(here)
                        continue
                    if best[i] is not None:
                        here = tuple(np.concatenate(c) for c in zip(best[i], here))
                    top = np.lexsort((here[1], -here[3]))[:pick.most]
                    best[i] = tuple(c[top] for c in here)
                if found:
                    yield made(found)
        found = [b for b in best.values() if b is not None]
        if found:
            yield made(found)

    return blocks.mapInArrow(run, kind)


class Largest:
    """Picks the documents with the largest bounds of each item."""

    def __init__(self, most: int):
        self.most = most

    def rows(self, item, bound, ids, best):
        if best is not None and len(best[3]) >= self.most:
            return np.flatnonzero(bound > best[3][-1])
        return np.flatnonzero(bound > 0)


class Open:
    """Picks the documents that are not provably behind an item's floor (score, id)."""

    most = None

    def __init__(self, floors: dict[int, tuple[int, int]]):
        self.floors = floors

    def rows(self, item, bound, ids, best):
        if item not in self.floors:
            return np.flatnonzero(bound > 0)
        score, doc_id = self.floors[item]
        return np.flatnonzero((bound > score) | ((bound == score) & (ids <= doc_id)))


def _scored(docs: DataFrame, found: DataFrame, asked: Asked, k: int) -> DataFrame:
    """item, doc_id, score of found rows (item, doc_id, hash), scored exactly on one text of each hash."""
    of_text = found.groupBy("hash").agg(F.min("doc_id").alias("rep"), F.collect_set("item").alias("items"))
    texts = docs.selectExpr("cast(doc_id as long) rep", "cast(text as string) text").join(cut(of_text), "rep")
    kind = "item int, hash binary, score long"

    def make():
        def work(cols):
            out = {"item": [], "hash": [], "score": []}
            for text, want, asks in zip(*(cols[c].to_pylist() for c in ("text", "hash", "items"))):
                if digest(text or "") == want:  # an id can stand at several texts
                    for i, s in zip(asks, asked.exact(text, asks)):
                        for name, v in zip(out, (i, want, s)):
                            out[name].append(v)
            return out

        return work

    exact = rows.map_batches(texts.select("text", "hash", "items"), kind, make).where("score > 0").distinct()
    best = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.select("item", "doc_id", "hash").join(exact, ["item", "hash"]).withColumn(
        "rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def _parts(items: DataFrame) -> list[DataFrame]:
    """Items in parts by hash, of bounded size on average; one part where they are few."""
    n, chars = items.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    parts = max(1, -(-n // PART_ITEMS), -(-(chars or 0) // PART_CHARS))
    if parts == 1:
        return [items]
    items = cut(items)
    return [items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == p) for p in range(parts)]


def search(docs: DataFrame, items: DataFrame, k: int = 20, first: int = FIRST, report: list | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item with a score above 0.

    `report` gets, per part, how many pairs were scored for the floors and in the end.
    """
    spark = docs.sparkSession
    built = cut(index(docs))
    blocks = built.where("width is not null").drop("n_docs", "n_terms")
    n_docs, n_terms = built.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    items = items.selectExpr("cast(item_id as long) item_id", "cast(text as string) text").where(
        "item_id is not null and text is not null").distinct()
    out = None
    for part in _parts(items) if n_docs else []:
        words = defaultdict(list)
        for item_id, text in sorted((r.item_id, r.text) for r in part.collect()):  # a bounded part
            words[item_id] += terms(text)
        wanted = {t for w in words.values() for t in w}
        if not wanted:
            continue
        asked = Asked(sorted(words.items()), holding(docs, list(wanted)), n_docs, n_terms)
        near = Window.partitionBy("item").orderBy(F.desc("bound"), "doc_id")
        some = _from_blocks(blocks, asked, k, Largest(first)).withColumn("n", F.row_number().over(near))
        some = cut(some.where(F.col("n") <= first).drop("n"))
        floors = {r.item: (r.score, r.doc_id) for r in _scored(docs, some, asked, k).where(F.col("rank") == k).collect()}
        open_ = cut(_from_blocks(blocks, asked, k, Open(floors)))
        if report is not None:
            report.append((some.count(), open_.count()))
        names = spark.createDataFrame(list(enumerate(asked.names)), "item int, item_id long")
        found = _scored(docs, open_, asked, k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out
