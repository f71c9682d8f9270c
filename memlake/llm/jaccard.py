"""Near-duplicate join: Jaccard similarity of word shingles, candidates from a MinHash LSH forest.

Each tree of the forest sorts documents by a sequence of MinHash values; documents under one prefix
are candidates. Prefixes are shortened from their full depth until the chance that a pair at the
least similarity meets in some tree reaches the target recall. Candidates are verified exactly on
their shingle sets (64-bit hashes).

Documents with the same shingle set are folded to one first. A pair is counted in the first tree
where it meets, which each task can tell from the two documents' prefixes. Prefixes whose members
another tree has too are visited once. Members of a common prefix are dealt into blocks of bounded
size and compared block by block; a task returns one count and one edge per document, never pairs.

Defined results: text without a word, and null, has no shingles, is in a class of its own and has
no links; fewer words than a shingle are one shingle; repeated rows are copies of each other; rows
without doc_id have no class and no links. doc_id names a document: rows that repeat one with
another text share its class.
"""

import hashlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from memlake.llm import rows, shingles
from memlake.llm.components import components
from memlake.sources.scratch import cut

#: Trees, full depth, least similarity as a fraction, and the least chance to find a pair at it.
TREES, DEPTH, LEAST, RECALL = 16, 10, (4, 5), 0.9995
#: Documents and shingles in a block of a common prefix, about.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 1 << 20


def depth_for(trees: int, full: int, least: tuple[int, int], recall: float) -> int:
    """The longest prefix, shortened from the full depth, at which the recall is reached."""
    s = least[0] / least[1]
    for d in range(full, 0, -1):
        if 1 - (1 - s ** d) ** trees >= recall:
            return d
    raise ValueError("no prefix reaches the recall: more trees are needed")


class Forest:
    """Prefix keys of a shingle set, one per tree."""

    def __init__(self, trees: int, depth: int):
        r = np.random.default_rng(2)
        self.trees, self.depth = trees, depth
        self.a = r.integers(0, 1 << 63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = r.integers(0, 1 << 63, trees * depth, dtype=np.uint64)

    def keys(self, found: np.ndarray) -> list[int]:
        least = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(found), 1024):
            part = found[at:at + 1024, None]
            least = np.minimum(least, ((part * self.a + self.b) >> np.uint64(1)).min(0))
        key = np.arange(self.trees, dtype=np.uint64) + np.uint64(1)
        for level in least.reshape(self.trees, self.depth).T:  # down the trie
            key = shingles.mixed(key * np.uint64(0x9E3779B97F4A7C15) + level)
        return key.view(np.int64).tolist()


def signatures(docs: DataFrame, trees: int, depth: int, words: int) -> DataFrame:
    """doc_id, text_hash, set_hash (null without shingles), size, keys per row of docs."""

    def make():
        forest = Forest(trees, depth)

        def work(cols):
            found = [shingles.shingle_hashes(t, words) for t in rows.texts(cols["text"])]
            return {"doc_id": cols["doc_id"], "text_hash": cols["text_hash"],
                    "set_hash": [hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None for h in found],
                    "size": [len(h) for h in found],
                    "keys": [forest.keys(h) if len(h) else [] for h in found]}

        return work

    return rows.map_batches(docs.select("doc_id", "text_hash", "text"), "doc_id long, text_hash long, "
                            "set_hash binary, size long, keys array<long>", make)


def _linked(found: list[np.ndarray], one: np.ndarray, two: np.ndarray, least: tuple[int, int]) -> np.ndarray:
    """Which of the given pairs (positions in found) reach the least similarity."""
    size = np.array([len(h) for h in found])
    up, down = least
    shared = np.zeros(len(one), np.int64)
    if len(found) <= 8:
        for i, (a, b) in enumerate(zip(one, two)):
            if min(size[a], size[b]) * down >= max(size[a], size[b]) * up:
                shared[i] = len(np.intersect1d(found[a], found[b], assume_unique=True))
    else:
        flat, owner = np.concatenate(found), np.repeat(np.arange(len(found)), size)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        new = np.concatenate(([True], flat[1:] != flat[:-1]))
        word = np.cumsum(new) - 1
        common = np.bincount(word)[word] > 1  # only shingles of several documents can be shared
        owner, word = owner[common], word[common]
        word = np.cumsum(np.concatenate(([True], word[1:] != word[:-1]))) - 1 if len(word) else word
        both = np.zeros((len(found), len(found)), np.float32)
        for at in range(0, int(word[-1]) + 1 if len(word) else 0, 4096):
            a, b = np.searchsorted(word, (at, at + 4096))
            has = np.zeros((len(found), min(4096, int(word[-1]) + 1 - at)), np.float32)
            has[owner[a:b], word[a:b] - at] = 1
            both += has @ has.T
        shared = both[one, two].astype(np.int64)
    return shared * down >= (size[one] + size[two] - shared) * up


def verify(group: dict, words: int, least: tuple[int, int]) -> list[tuple]:
    """(node, links, root) for each document of a block pair that has a link first met here."""
    n, tree = len(group["node"]), group["tree"][0]
    if n < 2:
        return []
    keys, block = np.array(group["keys"], np.int64), np.array(group["block"])
    one, two = np.triu_indices(n, 1)
    wanted = np.ones(len(one), bool)
    for t in range(tree):  # one tree at a time, or all pairs would hold the keys of all trees at once
        wanted &= keys[one, t] != keys[two, t]
    if group["row"][0] != group["col"][0]:
        wanted &= block[one] != block[two]
    one, two = one[wanted], two[wanted]
    if not len(one):
        return []
    found = [shingles.shingle_hashes(t, words) for t in group["text"]]
    good = _linked(found, one, two, least)
    one, two = one[good], two[good]
    copies = np.array(group["copies"])
    links = np.zeros(n, np.int64)
    np.add.at(links, one, copies[two])
    np.add.at(links, two, copies[one])
    root = np.arange(n)  # nodes come sorted
    while True:  # the least node of each local component
        low = np.minimum(root[one], root[two])
        before = root.copy()
        np.minimum.at(root, one, low)
        np.minimum.at(root, two, low)
        if (before == root).all():
            break
    return [(group["node"][i], int(links[i]), group["node"][root[i]]) for i in np.flatnonzero(links)]


def near_duplicates(docs: DataFrame, words: int = 5, least: tuple[int, int] = LEAST, recall: float = RECALL,
                    trees: int = TREES, full_depth: int = DEPTH) -> DataFrame:
    """doc_id, class_id (least doc_id of its class), n_links (rows at least so similar), per row."""
    depth = depth_for(trees, full_depth, least, recall)
    d = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", "xxhash64(cast(text as string)) text_hash")
    signed = cut(signatures(d, trees, depth, words))
    usable = signed.where("set_hash is not null and doc_id is not null")
    folded = cut(usable.groupBy(F.col("set_hash").alias("node")).agg(
        F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count(F.lit(1)).alias("copies"),
        F.min("size").alias("size"), F.min("keys").alias("keys")).select(
        "node", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash"),
        "copies", "size", "keys"))
    spread = folded.select("node", "size", F.posexplode("keys").alias("tree", "key"))
    prefixes = spread.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"), F.min("tree").alias("tree"),
        F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("members")).where("n > 1")
    # prefixes with the same members: the first tree's stays
    once = prefixes.groupBy("n", "members").agg(F.min(F.struct("tree", "key", "shingles")).alias("p"))
    once = cut(once.select("p.key", F.ceil(F.greatest(
        F.col("n") / BLOCK_DOCS, F.col("p.shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks")))
    member = cut(spread.select("node", "tree", "key").join(once, "key"))
    wanted = member.select("node").distinct().join(
        folded.select("node", "first_id", "first_hash", "copies", "keys"), "node")
    texts = d.join(wanted, (F.col("doc_id") == F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))).select(
        "node", "copies", "keys", "text").dropDuplicates(["node"])
    dealt = member.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "node", "tree", "key", "block", F.least("block", "other").alias("row"), F.greatest("block", "other").alias("col"))
    found = cut(rows.map_groups(
        dealt.join(texts, "node"), ["key", "row", "col"], ["node"],
        "node binary, links long, root binary", lambda g: verify(g, words, least)))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    # the sets of a repeated doc_id are of one class, linked or not
    shared = usable.groupBy("doc_id").agg(F.min("set_hash").alias("a"), F.max("set_hash").alias("z")).where("a <> z")
    same = usable.select("doc_id", F.col("set_hash").alias("b")).join(shared.select("doc_id", "a"), "doc_id")
    parts = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(same.select("a", "b")))
    classed = cut(folded.select("node", "first_id", "copies").join(parts, "node", "left").withColumn(
        "component", F.coalesce("component", "node")))
    least_id = classed.groupBy("component").agg(F.min("first_id").alias("class"))
    known = classed.join(least_id, "component").join(links, "node", "left").select(
        F.col("node").alias("set_hash"), "class", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"))
    return signed.join(known, "set_hash", "left").select(
        "doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id")).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that are the least of their class; of repeated ids the least text stays.
    Rows without doc_id stay."""
    classes = near_duplicates(docs, **options).select(F.col("doc_id").alias("_id"), F.col("class_id").alias("_class")).distinct()
    kept = classes.where("_id = _class").select("_id")
    mine = docs.withColumn("_row", F.struct(*docs.columns)).select("_row", F.col("doc_id").cast("long").alias("_id"))
    same = mine.where("_id is not null").join(kept, "_id")
    # an id that stands once, as it should, never brings its text to an aggregate
    repeated = same.groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    single = same.join(repeated, "_id", "left_anti").select("_row.*")
    least = same.join(repeated.select("_id"), "_id").groupBy("_id").agg(
        F.min_by("_row", F.xxhash64("_row")).alias("_row")).select("_row.*")
    return single.unionByName(least).unionByName(mine.where("_id is null").select("_row.*"))
