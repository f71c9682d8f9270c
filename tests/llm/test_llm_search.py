"""Ranked search over bit-sliced signatures."""

import math
import os
import random
import re
import sys
from collections import Counter

import numpy as np

sys.path.insert(0, os.path.dirname(__file__))

from fixtures import awkward, table, words  # noqa: E402

from memlake.llm import bit_search as bs  # noqa: E402

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_search(docs, items, k=20):
    found = [Counter(plain_terms(t)) for _, t in docs]
    n_docs, n_terms = sum(map(bool, found)), sum(c.total() for c in found)
    df = Counter(t for c in found for t in c)
    asks = {}
    for item, text in sorted({(i, t) for i, t in items if i is not None and t is not None}):
        asks[item] = asks.get(item, []) + plain_terms(text)
    out = []
    for item, wanted in asks.items():
        scores = []
        for (doc_id, _), c in zip(docs, found):
            m = 75 + (25 * c.total() * n_docs) // n_terms if n_terms else 75
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m))
                    for t in wanted if c[t])
            if s > 0 and doc_id is not None:
                scores.append((-s, doc_id))
        out += [(item, n + 1, d, -s) for n, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def made(r, n=220):
    stock = " ".join(f"w{int(r.paretovariate(0.6))}" for _ in range(400))
    docs = [(i, words(r, int(2 ** r.uniform(0, 9)), stock)) for i in range(n)]
    docs += [(1000 + i, docs[3][1]) for i in range(60)]  # copies
    docs += [(2000 + i, docs[4][1] + f" extra{i}") for i in range(40)]  # near copies
    docs += [(d, t) for d, t, *_ in awkward()] + [(5, "w1 w1 w2"), (3000, "ÉCOLE École éCOLE Straße x")]
    items = [(i, words(r, r.randint(1, 30), stock)) for i in range(12)]
    items += [(50, docs[3][1]), (51, docs[4][1]), (52, "nothing here"), (53, ""), (54, None), (None, "w1"), (55, "w1 w1 W1"),
              (55, "w1 w1 W1"), (55, "w2"), (56, "école straße x x"), (57, "7 river 𝒳")]
    return docs, items


def frames(spark, docs, items):
    return (table(spark, [(d, t, "en", "s", 1) for d, t in docs], True).repartition(5),
            spark.createDataFrame([(*x, "own", 1) for x in items], "item_id long, text string, term string, rank int"))


def test_terms_are_the_stated_ones():
    r = random.Random(1)
    chars = [chr(c) for c in range(128)] + list("éÉßΣ𝒳  ")
    for _ in range(300):
        t = "".join(r.choice(chars) for _ in range(r.randint(0, 40)))
        assert [x.decode() for x in bs.terms(t)] == plain_terms(t)
    assert bs.terms(None) == []


def test_same_as_scoring_everything(spark):
    docs, items = made(random.Random(2))
    report = []
    got = bs.search(*frames(spark, docs, items), report=report)
    assert sorted(map(tuple, got.collect())) == plain_search(docs, items)
    first, open_ = report[0]
    assert open_ < len(docs) * 20 / 3  # most pairs are excluded by their bounds


def test_bounds_hold_with_crowded_signatures(spark, monkeypatch):
    monkeypatch.setattr(bs, "WIDTH", 1)  # nearly every bit is set
    monkeypatch.setattr(bs, "MOST", 8)
    monkeypatch.setattr(bs, "CELLS", 500)
    monkeypatch.setattr(bs, "PART_ITEMS", 5)
    docs, items = made(random.Random(3), 60)
    got = bs.search(*frames(spark, docs, items), k=3, first=4)
    assert sorted(map(tuple, got.collect())) == plain_search(docs, items, 3)


def test_bounds_are_never_below_scores():
    r = random.Random(4)
    texts = [words(r, r.randint(1, 300), "a b c d e f g h i j k l m n o p q r s t u v") for _ in range(50)]
    items = [(i, bs.terms(words(r, 9, "a b c d e f g h zz"))) for i in range(5)]
    found = [bs.terms(t) for t in texts]
    df = Counter(t for f in found for t in set(f))
    asked = bs.Asked(items, df, len(texts), sum(map(len, found)))
    shelf = bs.Shelf(1024)
    for i, (t, f) in enumerate(zip(texts, found)):
        counts = Counter(f)
        code, times = bs.codes(counts), np.array(list(counts.values()))
        at = [bs.bits(code[times >= x], np.full((times >= x).sum(), l), 1024) for l, x in enumerate(bs.LEVELS) if (times >= x).any()]
        shelf.add(i, bs.digest(t), len(f), np.unique(np.concatenate(at)))
    block = dict(zip(("width", "ids", "hashes", "lengths", "slices"), shelf.block()))
    seen = {i: bound for i, _, bound in asked.bounds(block)}
    for i in range(len(asked.names)):
        exact = [asked.exact(t, [i])[0] for t in texts]
        assert (seen[i] >= exact).all() and (seen[i] > exact).mean() < 1


def test_empty_tables(spark):
    docs, items = frames(spark, *made(random.Random(5), 5))
    assert bs.search(docs.limit(0), items).count() == 0
    assert bs.search(docs, items.limit(0)).count() == 0
    assert bs.search(docs.where("text is null or text = ''"), items).count() == 0
