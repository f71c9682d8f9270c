"""Line deduplication by a segment-partition edit join.

Lines within a few edits of each other are linked, and linked lines form a class. A line of the
least length or more is cut into threshold + 1 segments: a line within the threshold has one of
them unchanged, near its place. Every line probes the segments that lines of its length, or up to
threshold shorter, can have, at the places that a match can leave to it. Lines that meet are
verified by a banded bit-parallel edit distance. Shorter lines are linked only if equal.

Equal lines are one node (64-bit hash). Keys of segments that only one line has are dropped by an
aggregate before any text moves; texts are fetched for the lines that are left. Lines under a
common key are dealt into blocks of bounded size and compared block by block; a pair is counted
under the first key it shares, and a task returns one count and one edge per line, never pairs.

Defined results: null text has no lines; empty and blank lines belong to no class and stay; the
first line of a class, by doc_id and line number, stays and its other lines go, also within one
document; repeated rows are one document; rows without doc_id are left as they are.
"""

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from memlake.llm import rows
from memlake.llm.components import components
from memlake.llm.sieve import sifter
from memlake.sources.scratch import cut

#: Most edits between linked lines, and least length of lines that may differ.
EDITS, LEAST = 2, 24
#: Lines in a block of a common key, about.
BLOCK = 256


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """Start and length of the segments of a line of this length; the last ones are the longer."""
    base, longer = divmod(length, edits + 1)
    out, at = [], 0
    for i in range(edits + 1):
        n = base + (i >= edits + 1 - longer)
        out.append((at, n))
        at += n
    return out


def probes(edits: int) -> list[tuple[int, int, int]]:
    """(shorter by, segment, shift) of the places where a line is probed, in the order of counting."""
    out = []
    for less in range(edits + 1):
        for i in range(edits + 1):
            low, high = max(-i, less - (edits - i)), min(i, less + (edits - i))
            out += [(less, i, shift) for shift in range(low, high + 1)]
    return out


def within(a: str, b: str, k: int) -> bool:
    """Whether two texts are at most k edits apart: equal ends go, then a band of 2k + 1 bits
    slides along the rest and stops once the distance cannot come back to k."""
    if len(a) > len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if n - m > k:
        return False
    start, step = 0, 64
    while start < m and a[start:start + step] == b[start:start + step] and start + step <= m:
        start += step
    while start < m and a[start] == b[start]:
        start += 1
    while m > start and a[m - 1] == b[n - 1]:
        m, n = m - 1, n - 1
    a, b = a[start:m], b[start:n]
    m, n = len(a), len(b)
    if m <= k:  # at most k replaced and n - m inserted; a short table settles it
        row = list(range(m + 1))
        for j, c in enumerate(b, 1):
            last, row[0] = row[0], j
            for i in range(1, m + 1):
                last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (a[i - 1] != c))
        return row[m] <= k
    width = 2 * k + 1
    full = (1 << width) - 1
    up, down = full & ~((1 << k) - 1), 0
    far, limit, along = k, 2 * k + n - m, 1 << (width - 2)
    edge = 1 << (width - 1)
    for j, c in enumerate(b):
        low = j - k
        same, bit = 0, 1 << max(0, -low)
        for i in range(max(0, low), min(m, j + k + 1)):
            if a[i] == c:
                same |= bit
            bit <<= 1
        diagonal = ((((same & up) + up) ^ up) | same | down) & full
        plus, minus = (down | ~(diagonal | up)) & full, diagonal & up
        if j < m - k:
            far += not diagonal & edge
        else:
            far += bool(plus & along) - bool(minus & along)
            along >>= 1
        if far > limit:
            return False
        up = (minus | ~((diagonal >> 1) | plus)) & full
        down = (diagonal >> 1) & plus
    return far <= k


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line, node, length of every line that is not blank."""
    cut_up = docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return cut_up.where(F.trim("line", F.lit(" \t\r\x0b\x0c")) != "").select(
        "doc_id", "line_no", "line", F.xxhash64("line").alias("node"), F.length("line").alias("length"))


def asked(edits: int) -> list[int]:
    """The probes, as places in probes(), that are not the line's own segments."""
    return [nth for nth, (less, _, shift) in enumerate(probes(edits)) if less or shift]


def keyed(lines: DataFrame, edits: int, least: int) -> DataFrame:
    """doc_id, line_no, node, keys of every line: its edits + 1 segments, which are probes of lines of
    its length too, then the other probes, as in asked(); keys is null for a line below the least length."""
    # four bytes a character, so that a place in the line is one in the bytes
    wide = lines.select("doc_id", "line_no", "node", "length",
                        F.when(F.col("length") >= least, F.encode("line", "UTF-32")).alias("line"))
    count = edits + 1

    def key(less, i, shift):
        length = F.col("length") - less
        base, longer = F.floor(length / count), length % count
        n = base + F.when(F.lit(i) >= count - longer, 1).otherwise(0)
        start = i * base + F.greatest(F.lit(0), F.lit(i) - (count - longer))
        text = F.substring(F.col("line"), (4 * (start + shift) + 1).cast("int"), (4 * n).cast("int"))
        return F.when(length >= least, F.xxhash64(text, length.cast("int"), F.lit(i)))

    places = probes(edits)
    keys = [key(0, i, 0) for i in range(count)] + [key(*places[nth]) for nth in asked(edits)]
    return wide.select("doc_id", "line_no", "node",
                       F.when(F.col("line").isNotNull(), F.array(*keys)).alias("keys"))


def verify(group: dict, edits: int) -> list[tuple]:
    """(node, links, root) for each line of a block pair that has a link first met under this key."""
    node, text, copies, block = group["node"], group["line"], group["copies"], group["block"]
    crossing = group["row"][0] != group["col"][0]
    places, count, others = probes(edits), edits + 1, asked(edits)
    home = {i: nth for nth, (less, i, shift) in enumerate(places) if not less and not shift}
    size = [len(t) for t in text]
    own, asking = {}, []
    for x, tags in enumerate(group["tags"]):
        for t in tags:
            if t < count:
                own.setdefault((t, size[x]), []).append(x)
            nth = home[t] if t < count else others[t - count]
            asking.append((x, places[nth], nth))
    links, root = [0] * len(node), list(node)
    met = []
    for y, (less, i, _), nth in asking:
        b = text[y]
        for x in own.get((i, size[y] - less), ()):
            a = text[x]
            if node[x] == node[y] or (less == 0 and node[x] > node[y]):
                continue
            if crossing and block[x] == block[y]:
                continue
            cut_up = segments(len(a), edits)
            if any(b[cut_up[j][0] + s:cut_up[j][0] + s + cut_up[j][1]] == a[cut_up[j][0]:sum(cut_up[j])]
                   for d, j, s in places[:nth] if d == less):
                continue  # counted under an earlier key
            start, n = cut_up[i]
            if b[start + places[nth][2]:start + places[nth][2] + n] != a[start:start + n]:
                continue  # only the hashes agree
            if within(a, b, edits):
                met.append((x, y))
                links[x] += copies[y]
                links[y] += copies[x]
    changed = True
    while changed:
        changed = False
        for x, y in met:
            low = min(root[x], root[y])
            if root[x] != low or root[y] != low:
                root[x] = root[y] = low
                changed = True
    return [(node[x], links[x], root[x]) for x in range(len(node)) if links[x]]


def classes(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """doc_id, line_no, class_doc_id, class_line_no, n_links, kept for every line that is not blank."""
    lines = lines_of(docs)
    base = cut(keyed(lines, edits, least))
    seen = cut(base.select("doc_id", "line_no", "node").distinct())
    folded = cut(seen.groupBy("node").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count(F.lit(1)).alias("copies")))
    shared = cut(base.select("node", F.explode("keys").alias("key")).where("key is not null").groupBy("key").agg(
        F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key"))
    may_share = sifter(shared, "key")
    member = cut(may_share(base.select("node", F.posexplode("keys").alias("tag", "key")), "key").join(shared, "key")
                 .groupBy("key", "node").agg(F.collect_set("tag").alias("tags")))
    sizes = member.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    nodes = cut(member.select("node").distinct())
    may_meet = sifter(nodes, "node")
    texts = may_meet(lines.select("node", "line"), "node").join(nodes, "node").dropDuplicates(["node"]).join(
        folded.select("node", "copies"), "node")
    dealt = member.join(sizes, "key").withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", "node", "tags", "block", F.least("block", "other").alias("row"), F.greatest("block", "other").alias("col"))
    found = cut(rows.map_groups(dealt.join(texts, "node"), ["key", "row", "col"], ["node"],
                                "node long, links long, root long", lambda g: verify(g, edits)))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    # first line and links of every node that is repeated or linked; the others are their own class
    known = folded.join(links, "node", "left").join(parts, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    first = known.join(parts.select("component").distinct(), "component").groupBy("component").agg(F.min("first").alias("leader"))
    known = known.join(first, "component", "left").select(
        "node", F.coalesce("leader", "first").alias("leader"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return seen.join(known, "node").select(
        "doc_id", "line_no", F.col("leader.doc_id").alias("class_doc_id"), F.col("leader.line_no").alias("class_line_no"),
        "n_links", F.col("leader").eqNullSafe(F.struct("doc_id", "line_no")).alias("kept"))


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """docs with the repeated lines taken out of text (and n_chars set anew, if there); a document
    all of whose lines went is dropped. Documents without a repeated line are as they were."""
    names = docs.columns
    own = "_gone" + "_" * max(map(len, names))  # longer than any name of docs, so not one of them
    gone = classes(docs, **options).where("not kept").groupBy("doc_id").agg(F.collect_set("line_no").alias(own))
    joined = docs.join(gone, docs.doc_id.cast("long") == gone.doc_id, "left").drop(gone.doc_id)

    def make():
        def work(cols):
            text, keep = [], []
            for t, lost in zip(cols["text"].to_pylist(), cols[own].to_pylist()):
                if lost:
                    lost = set(lost)
                    left = [line for i, line in enumerate(t.split("\n")) if i not in lost]
                    text.append("\n".join(left))
                    keep.append(any(line.strip(" \t\r\x0b\x0c") for line in left))
                else:
                    text.append(t)
                    keep.append(True)
            out = {n: cols[n] for n in names} | {"text": pa.array(text, pa.string())}
            if "n_chars" in out:
                new = [n if not g else len(t) for n, g, t in zip(
                    cols["n_chars"].to_pylist(), cols[own].to_pylist(), text)]
                out["n_chars"] = pa.array(new, cols["n_chars"].type)
            mask = pa.array(keep)
            return {n: c.filter(mask) for n, c in out.items()}

        return work

    return rows.map_batches(joined, docs.schema, make)
