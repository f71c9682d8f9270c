"""Mixing, packing, nearest neighbours and the pipeline."""

import os
import random
import re
import sys
import tracemalloc
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))

from fixtures import awkward, table, words  # noqa: E402

from memlake.llm import curves, mixing, packing, queries, sieve  # noqa: E402

P = pytest.importorskip("public_tokenizers")
TOKENIZER = "word_bpe_49k.json"


def mix_rows():
    r = random.Random(1)
    return awkward() + [(100 + i, words(r, r.randint(1, 60)), "en", ("a", "b", "Z", "é", None, "hot", "hot", "hot")[i % 8], 0)
                        for i in range(300)]


def plain_targets(sizes):
    """Sources share all words by weight; who is above three times its size stops there, again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        target = fixed | {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if target[s] > 3 * sizes[s]]
        if not over:
            return target
        fixed |= {s: 3 * sizes[s] for s in over}


def test_mix_targets_and_words_taken(spark, monkeypatch):
    rows = mix_rows()
    docs = table(spark, rows, True)
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    target, before = plain_targets(sizes), None
    for chunk in (4096, 16):
        monkeypatch.setattr(mixing, "CHUNK", chunk)
        got = mixing.mix(docs, block=32).collect()
        assert len(got) == len(rows)
        taken = Counter()
        for x in got:
            taken[x.source] += x.taken
            assert 0 <= x.taken <= 3 * x.size and x.source_size == sizes[x.source]
            assert abs(x.target - target[x.source]) < 1e-6
        assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
        now = sorted(((x.doc_id, x.size, x.taken) for x in got), key=str)
        assert before in (None, now)
        before = now


def test_mix_equals_its_sql(spark):
    rows = [r for r in mix_rows() if r[0] is not None]
    docs = table(spark, rows)
    got = mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "last_slot", "blocks").collect()
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toPandas())
    want = con.execute(queries.OP9).fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_schedule_keeps_shares_everywhere(spark):
    docs = table(spark, [(i, words(random.Random(i), 50), "en", "abc"[i % 3], 0) for i in range(300)])
    per = mixing.targets(mixing.sized(docs))
    slots = sorted(mixing.schedule(per, 16).collect())
    assert [s.slot for s in slots] == sorted({s.slot for s in slots})
    share = {r.source_no: r.target / 15000 for r in per.collect()}
    for at in range(0, 900, 100):
        here = Counter(s.source_no for s in slots if at <= s.slot < at + 100)
        assert all(abs(here[k] - 100 * share[k]) <= 4 for k in share)
    by = defaultdict(list)
    for s in slots:
        by[s.source_no].append(s.block_no)
    assert all(b == list(range(len(b))) for b in by.values())


def test_mixed_documents_and_empty(spark):
    docs = table(spark, mix_rows(), True)
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    plan = {(x.doc_id, x.size): x for x in mixing.mix(docs).collect()}
    seen = Counter((x.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", x.text or ""))) for x in got.collect())
    for key, x in plan.items():
        assert (seen[key] > 0) == (x.taken > 0)
    empty = table(spark, [])
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_mixed_documents_stand_by_the_schedule(spark):
    docs = table(spark, [(i, words(random.Random(i), 50), "en", "abc"[i % 3], 0) for i in range(300)])
    got = [x.doc_id for x in mixing.mixed_documents(docs, block=16).collect()]
    per = mixing.targets(mixing.sized(docs))
    slots = {(x.source_no, x.block_no): x.slot for x in mixing.schedule(per, 16).collect()}
    want = []
    for x in mixing.streams(mixing.sized(docs), per).collect():
        lies = [x.start + t * x.source_size for t in range(3)]
        want += [(slots[x.source_no, at // 16], at, x.doc_id) for at in lies if at < x.goal]
    assert got == [doc for _, _, doc in sorted(want)]
    # so every stretch is near the target shares
    share = {r.source: r.target / 15000 for r in per.collect()}
    for at in range(0, len(got) - 60, 60):
        here = Counter("abc"[i % 3] for i in got[at:at + 60])
        assert all(abs(here[k] - 60 * share[k]) <= 4 for k in share)


def test_word_ids_equal_the_tokenizer():
    ids = packing.WordIds(P.path(TOKENIZER), most=400)
    odd = ["", " ", "a\x1cb c", "ΟΔΟΣ. ΟΔΟΣ Σ,", "İstanbul, İ. x", "don't it's we'LL", "<|endoftext|> a<|endoftext|>b",
           "12,345.67 x²", "한국어 가.", "Å. Å,", "a b　c d\x85e", "ﬁ. ǅ", "‘quoted’", "..", ".,", "a.,b", "é. ́x"]
    r = random.Random(2)
    texts = odd + ["".join(r.choice("abcdé.,' AΣ\n1") for _ in range(r.randint(0, 200))) for _ in range(200)]
    for at in range(0, len(texts), 20):
        some = texts[at:at + 20]
        want = [e.ids for e in ids.tokenizer.encode_batch(some, add_special_tokens=False)]
        assert [list(x) for x in ids.encode(some)] == want


def test_a_kept_word_takes_little_memory():
    ids = packing.WordIds(P.path(TOKENIZER))
    r = random.Random(5)
    stock = sorted({"".join(r.choice("abcdefgh") for _ in range(8)) for _ in range(30_000)})
    text = " ".join(stock)
    tracemalloc.start()
    ids.encode([text])
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(ids.known) == len(stock)
    assert kept / len(stock) < 170, kept / len(stock)


def test_new_words_reach_the_tokenizer_in_bounded_calls(monkeypatch):
    calls, encode = [], packing.WordIds._encode
    monkeypatch.setattr(packing.WordIds, "_encode", staticmethod(lambda t, words: calls.append(
        sum(len(w.split()) for w in words)) or encode(t, words)))
    ids = packing.WordIds(P.path(TOKENIZER))
    r = random.Random(6)
    text = " ".join("".join(r.choice("abcdefgh1") for _ in range(8)) for _ in range(40_000))
    assert list(ids.encode([text])[0]) == ids.tokenizer.encode(text, add_special_tokens=False).ids
    assert max(calls) <= 8192


def test_best_two_fit():
    bins = packing.best_two_fit({6: 1, 5: 1, 2: 1, 3: 2}, 10)
    assert all(sum(b) <= 10 for b, _ in bins)
    r = random.Random(3)
    for _ in range(40):
        counts = Counter(r.randint(1, 100) for _ in range(r.randint(0, 300)))
        bins = packing.best_two_fit(counts, 100)
        used = Counter()
        for b, k in bins:
            assert sum(b) <= 100
            for n in b:
                used[n] += k
        assert used == counts
        gaps = []  # first fit decreasing
        for n in sorted(counts.elements(), reverse=True):
            at = next((i for i, g in enumerate(gaps) if g >= n), None)
            gaps[len(gaps) if at is None else at:] = [100 - n] if at is None else [gaps[at] - n, *gaps[at + 1:]]
        assert sum(k for _, k in bins) <= len(gaps) + 1


def test_packing_round_trip(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 40)
    rows = mix_rows()
    got = packing.pack_documents(table(spark, rows, True), P.path(TOKENIZER), 64).collect()
    tokenizer = packing.WordIds(P.path(TOKENIZER)).tokenizer
    want = Counter()
    for d, t, *_ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 64):
            part = np.array(ids[k:k + 64], "<u4")
            want[d, k // 64, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == want
    places = defaultdict(list)
    for x in got:
        places[x.sequence_id].append((x.offset, x.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 64
    assert len(places) <= -(-sum(x.length for x in got) // 64) * 1.05 + 1
    assert packing.pack_documents(table(spark, []), P.path(TOKENIZER)).count() == 0


def plain_nearest(rows, k):
    good = {(i, tuple(v)) for i, v in rows
            if i is not None and v and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in good:
        if q % 20 == 0:
            best = {}
            for i, w in good:
                if i != q:
                    s = float((np.array(v) * np.array(w)).sum())
                    best[i] = max(s, best.get(i, s))
            out[q] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def test_nearest_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(curves, "BLOCK", 40)
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=4).tolist()) for i in range(300)] + [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(300, 360)]
    rows += [(400, None), (420, []), (440, [0.0] * 4), (460, [1.0, None, 0.0, 0.0]), (480, [float("nan")] * 4),
             (500, [float("inf"), 1.0, 1.0, 1.0]), (520, [1.0, 2.0]), (None, [1.0, 1.0, 1.0, 1.0]), (0, rows[0][1])]
    docs = spark.createDataFrame([(i, v, "own") for i, v in rows], "vec_id long, embedding array<double>, score string")
    want = plain_nearest(rows, 20)
    for window in (None, 99):
        got = defaultdict(list)
        for x in curves.nearest(docs, 20, window=window).orderBy("query_id", "rank").collect():
            got[x.query_id].append((x.vec_id, x.score))
            assert len(got[x.query_id]) == x.rank
        assert set(got) == set(want)
        hits = sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items())
        assert hits / sum(map(len, want.values())) >= (0.9 if window is None else 1.0)
        if window:
            assert {q: [i for i, _ in g] for q, g in got.items()} == {q: [i for i, _ in w] for q, w in want.items()}
    assert curves.nearest(docs.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(x.vec_id, x.score) for x in curves.nearest(few).orderBy("rank").collect()] == [(2, 1.0), (1, 0.0)]


def test_nearest_breaks_ties_by_id(spark, monkeypatch):
    monkeypatch.setattr(curves, "BLOCK", 60)
    r = np.random.default_rng(5)
    rows = [(i, r.integers(-1, 2, 6).astype(float).tolist()) for i in range(600)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    at, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    got = defaultdict(list)
    for row in curves.nearest(docs, 20, window=99).orderBy("query_id", "rank").collect():
        got[row.query_id].append(row.vec_id)
    for i, v in rows:
        if i % 20 == 0 and any(v):
            score = x @ v
            some = [k for k in np.lexsort((at, -score)) if at[k] != i and x[k].any()][:20]
            assert got[i] == at[some].tolist()


def test_hilbert_steps_are_single():
    side = 8
    points = np.array([(a, b, c) for a in range(side) for b in range(side) for c in range(side)])
    key = curves.hilbert(points, 3)
    assert sorted(key.tolist()) == list(range(side ** 3))
    walk = points[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_sieve_lets_every_key_through(spark):
    keys = spark.range(0, 1000, 7).selectExpr("xxhash64(id) key")
    asked = spark.range(1000).selectExpr("id", "xxhash64(id) key")
    may = sieve.sieve(keys, "key")
    passed = {x.id for x in asked.where(may("key")).collect()}
    assert set(range(0, 1000, 7)) <= passed and len(passed) < 200


def test_pipeline_against_its_parts(spark, tmp_path):
    import corpus_pipeline
    from memlake.llm import jaccard, language, line_dedup

    r = random.Random(6)
    rows = [(i, "\n".join(words(r, 12, ("the and of river stone", "der die und haus wasser")[i % 2]) for _ in range(3)),
             ("en", "de")[i % 2], "abc"[i % 3], 0) for i in range(80)]
    rows += [(200 + i, rows[i][1], "en", "a", 0) for i in range(10)] + [(300, "123 456", None, "a", 0), (301, None, "en", None, None)]
    docs = table(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    state = docs
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        before, state = state, stage(spark, state, str(tmp_path))
        path = f"{tmp_path}/{name}"
        state.write.parquet(path)
        state = spark.read.parquet(path)
        counts.append(state.count())
        if name == "language":
            model = language.fit(language.sample(before))
            want = [x.doc_id for x in language.identify(before, model).collect() if x.lang_pred != "und" and x.score >= 0.2]
            assert sorted(x.doc_id for x in state.collect()) == sorted(want) and 300 not in want and 301 not in want
        if name == "lines":
            left = line_dedup.classes(state)
            assert left.where("not kept").count() == 0 and state.where("doc_id between 200 and 209").count() == 0
        if name == "near_duplicates":
            assert jaccard.near_duplicates(state).where("n_links > 0").count() == 0
        if name != "packing":
            assert state.columns == docs.columns
    own = table(spark, rows, True)
    kept = corpus_pipeline.STAGES[0][1](spark, own, str(tmp_path))
    assert kept.columns == own.columns and {x.score for x in kept.collect()} == {"own"}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda d: sorted((x.doc_id, x.piece, x.ids_crc32, x.sequence_id, x.offset) for x in d.collect())
    assert key(whole) == key(state)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "mixing", "packing"]
