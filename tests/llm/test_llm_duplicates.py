"""Near-duplicate join, line dedup, components and fingerprints."""

import hashlib
import os
import random
import sys
import tracemalloc
from collections import Counter

sys.path.insert(0, os.path.dirname(__file__))

from fixtures import awkward, table, words  # noqa: E402

from memlake.llm import fingerprints, jaccard, line_dedup, shingles  # noqa: E402
from memlake.llm.components import components  # noqa: E402


class Sets:
    """Union by least member."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(200, 260)] + [(5, 5)]
    edges += [(r.randint(300, 400), r.randint(300, 400)) for _ in range(70)]
    sets = Sets()
    for a, b in edges:
        sets.join(a, b)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: sets.find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_shingles(t, n=5):
    w = (t or "").split()
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def plain_jaccard(rows):
    sets, links = Sets(), Counter()
    s = [plain_shingles(t) for _, t in rows]
    for i, (a, _) in enumerate(rows):
        if a is None:
            continue
        sets.find(a)
        for j in range(i):
            b = rows[j][0]
            if b is not None and s[i] and s[j] and 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j]):
                links[i] += 1
                links[j] += 1
                sets.join(a, b)
    return sorted(((a, sets.find(a) if a is not None else None, links[i]) for i, (a, _) in enumerate(rows)), key=str)


def near_copies(r, groups=6, size=25):
    out, doc_id = [], 100
    for _ in range(groups):
        base = words(r, r.randint(60, 150), "ab cd ef gh ij kl mn op qr st uv wx yz aa bb cc dd").split()
        for _ in range(size):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                w[r.randrange(len(w))] = f"n{r.randint(0, 9)}"
            out.append((doc_id, " ".join(w)))
            doc_id += 1
    return out


def test_shingle_hashes_are_the_sets():
    r = random.Random(2)
    for _ in range(200):
        t = "".join(r.choice("ab é\n\t") for _ in range(r.randint(0, 60)))
        assert len(shingles.shingle_hashes(t)) == len(plain_shingles(t))
    assert (shingles.shingle_hashes("a b  c") == shingles.shingle_hashes(" a b\nc ")).all()


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(3)
    rows = near_copies(r) + [(d, t) for d, t, *_ in awkward()]
    docs = table(spark, [(d, t, "en", "s", 1) for d, t in rows], True)
    got = sorted(map(tuple, jaccard.near_duplicates(docs).collect()), key=str)
    assert got == plain_jaccard(rows)
    assert jaccard.near_duplicates(table(spark, [])).count() == 0


def test_repeated_ids_with_other_texts(spark):
    r = random.Random(6)
    rows = near_copies(r, 3, 8)
    rows += [(100, words(r, 80)), (100, rows[9][1]), (101, words(r, 70)), (108, rows[17][1]), (900, words(r, 70)), (900, words(r, 60))]
    docs = table(spark, [(d, t, "en", "s", 1) for d, t in rows])
    assert sorted(map(tuple, jaccard.near_duplicates(docs).collect()), key=str) == plain_jaccard(rows)


def test_blocks_of_a_hot_prefix_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 7)
    rows = near_copies(random.Random(4), groups=2, size=60)
    docs = table(spark, [(d, t, "en", "s", 1) for d, t in rows])
    assert sorted(map(tuple, jaccard.near_duplicates(docs).collect()), key=str) == plain_jaccard(rows)


def test_prefix_depth_reaches_the_recall():
    for recall in (0.9, 0.99, 0.9995):
        d = jaccard.depth_for(16, 10, (4, 5), recall)
        assert 1 - (1 - 0.8 ** d) ** 16 >= recall > 1 - (1 - 0.8 ** (d + 1)) ** 16


def test_one_of_each(spark):
    rows = [(d, t, "en", "s", 1) for d, t in near_copies(random.Random(5), 3, 5)] + awkward()
    kept = jaccard.one_of_each(table(spark, rows, True))
    assert kept.columns == table(spark, rows, True).columns
    want = {c for _, c, _ in plain_jaccard([(d, t) for d, t, *_ in rows])} - {None}
    got = [x.doc_id for x in kept.collect()]
    assert sorted(g for g in got if g is not None) == sorted(want)
    assert got.count(None) == sum(d is None for d, *_ in rows)


def plain_lines(rows, edits=2, least=24):
    seen = {}
    for d, t in sorted(((d, t) for d, t in set(rows) if d is not None and t), key=lambda x: x):
        for i, line in enumerate(t.split("\n")):
            if line.strip(" \t\r\x0b\x0c"):
                seen.setdefault(line, []).append((d, i))
    sets, links, names = Sets(), Counter(), list(seen)
    first = {line: min(seen[line]) for line in names}
    for line in names:
        sets.find(first[line])
    for i, a in enumerate(names):
        for b in names[:i]:
            # texts are at least as many edits apart as their lengths differ
            if min(len(a), len(b)) >= least and abs(len(a) - len(b)) <= edits and plain_distance(a, b) <= edits:
                links[a] += len(seen[b])
                links[b] += len(seen[a])
                sets.join(first[a], first[b])
    return {(d, i): (*sets.find(first[line]), links[line] + len(seen[line]) - 1)
            for line in names for d, i in seen[line]}


def plain_distance(a, b):
    row = list(range(len(a) + 1))
    for j, c in enumerate(b, 1):
        last, row[0] = row[0], j
        for i in range(1, len(a) + 1):
            last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (a[i - 1] != c))
    return row[-1]


def edited_lines(r, n=80, stock=24):
    base = ["".join(r.choice("abcdef é") for _ in range(r.randint(20, 50))) for _ in range(stock)]
    out = []
    for d in range(n):
        lines = []
        for _ in range(3):
            b = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                p, how = r.randrange(len(b)), r.randrange(3)
                if how == 0:
                    b[p] = "x"
                elif how == 1:
                    b.insert(p, "y")
                else:
                    del b[p]
            lines.append("".join(b))
        out.append((d + 1000, "\n".join(lines)))
    return out


def test_banded_distance():
    r = random.Random(6)
    for _ in range(4000):
        k = r.choice([1, 2, 3])
        a = "".join(r.choice("abc") for _ in range(r.randint(0, 14)))
        b = "".join(c for c in a if r.random() > 0.1) + "".join(r.choice("abc") for _ in range(r.randint(0, 2)))
        assert line_dedup.within(a, b, k) == (plain_distance(a, b) <= k)


def test_line_classes_against_brute_force(spark, monkeypatch):
    rows = edited_lines(random.Random(7)) + [(d, t) for d, t, *_ in awkward()]
    docs = table(spark, [(d, t, "en", "s", 1) for d, t in rows], True)
    want = plain_lines(rows)
    for block in (256, 5):
        monkeypatch.setattr(line_dedup, "BLOCK", block)
        got = line_dedup.classes(docs).collect()
        assert {(x.doc_id, x.line_no): (x.class_doc_id, x.class_line_no, x.n_links) for x in got} == want
        assert all(x.kept == ((x.doc_id, x.line_no) == (x.class_doc_id, x.class_line_no)) for x in got)
    assert line_dedup.classes(table(spark, [])).count() == 0


def test_without_repeats(spark):
    rows = awkward() + [(d, t, "en", "s", len(t)) for d, t in edited_lines(random.Random(8), 20, 6)]
    docs = table(spark, rows, True)
    left = line_dedup.without_repeats(docs)
    assert left.columns == docs.columns
    want, classes = [], plain_lines([(d, t) for d, t, *_ in rows])
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        gone = {i for i in range(len(lines)) if (d, i) in classes and classes[d, i][:2] != (d, i)}
        kept = [line for i, line in enumerate(lines) if i not in gone]
        if not gone:
            want.append((d, t))
        elif any(line.strip() for line in kept):
            want.append((d, "\n".join(kept)))
    assert sorted(((x.doc_id, x.text) for x in left.collect()), key=str) == sorted(want, key=str)


def plain_chunks(data: bytes) -> list[int]:
    ends, start = [], 0
    while start < len(data):
        end = min(start + fingerprints.MOST, len(data))
        for i in range(start + fingerprints.LEAST - 1, end):
            h = sum(int(fingerprints.GEAR[data[i - k]]) << k for k in range(32) if i - k >= 0) % 2 ** 32 >> 16
            mask = fingerprints.HARD if i < start + fingerprints.AIM else fingerprints.EASY
            if h & int(mask) == 0:
                end = i + 1
                break
        ends.append(end)
        start = end
    return ends


def test_chunk_boundaries_against_a_plain_roll():
    r = random.Random(9)
    for n in (0, 1, 11, 12, 40, 500):
        data = "".join(r.choice("abcdeé ") for _ in range(n)).encode()
        assert fingerprints.boundaries(data) == plain_chunks(data)


def test_fingerprints_follow_the_next_document(spark):
    rows = [(i * 3 % 101, words(random.Random(i), 40 + i), "en", "s", 1) for i in range(101)]
    docs = table(spark, rows, True)
    for size in (7, 4000):
        got = {x.doc_id: x for x in fingerprints.with_edits(docs, size).collect()}
        texts = {d: t for d, t, *_ in rows}
        order = sorted(texts, reverse=True)
        assert len(got) == len(texts)
        for d, following in zip(order, order[1:] + order[:1]):
            n = len(texts[d]) // 3
            new = texts[d][:len(texts[d]) - n] + texts[following][:n]
            x = got[d]
            assert x.edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and x.n_chars == len(texts[d])
            assert x.fingerprint == fingerprints.written(fingerprints.chunks(texts[d]))
            a, b = fingerprints.parsed(x.fingerprint), fingerprints.parsed(x.edited_fingerprint)
            assert x.near_edited == fingerprints.likeness(a, b)
            assert x.near_next == fingerprints.likeness(a, fingerprints.parsed(got[following].fingerprint))
        assert sum(x.near_edited for x in got.values()) / len(got) > 0.5


def test_fingerprints_awkward(spark):
    rows = awkward()
    for size in (3, 4000):
        got = fingerprints.with_edits(table(spark, rows, True), size).collect()
        assert sorted(str(x.doc_id) for x in got) == sorted(str(d) for d, *_ in rows)
        prints = {x.doc_id: x.fingerprint for x in got}
        assert prints[1] == prints[2] == "" and prints[6] == prints[7] != ""
    assert fingerprints.with_edits(table(spark, [])).count() == 0
    one = fingerprints.with_edits(table(spark, [(5, "abc def", "en", "s", 1)])).collect()
    assert one[0].near_next == 1.0
    assert fingerprints.likeness({}, {}) == 1.0 and fingerprints.likeness({}, {"a": 1}) == 0.0


def test_a_block_pair_does_not_hold_the_keys_of_all_trees_for_all_pairs():
    r, n, tree = random.Random(7), 600, 15
    texts = [words(r, 12) for _ in range(n - 1)]
    group = {"node": [i.to_bytes(2, "big") for i in range(n)], "tree": [tree] * n, "block": [0] * n, "row": [0] * n,
             "col": [0] * n, "copies": [1] * n, "keys": [[r.getrandbits(60) for _ in range(16)] for _ in range(n)],
             "text": [*texts, texts[3]]}
    group["keys"][-2] = group["keys"][5]  # met in an earlier tree
    tracemalloc.start()
    found = jaccard.verify(group, 5, (4, 5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(int.from_bytes(a, "big"), k, int.from_bytes(b, "big")) for a, k, b in found] == [(3, 1, 3), (n - 1, 1, 3)]
    assert peak < 30e6, peak
