from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.functions.vectors import cosine, hashed_vector, similarity_to
from memlake.operators.search import ann_top_k, build_lists, top_k_many
from memlake.plans.search import as_json, json_safe, recent, search, search_many
from memlake.sources import list_index
from memlake.sources.scratch import new_path

TYPES = ("decision", "reference")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((120, 6)).astype(np.float32)
    vectors[50:90] = vectors[7]  # a third of all rows tie
    rows = [
        (f"e{i:03d}", f"text {i}", [float(x) for x in v] if i % 13 else None, TYPES[i % 2],
         ["p1", "p2"] if i % 3 == 0 else [], datetime(2024, 1, 1 + i % 20))
        for i, v in enumerate(vectors)
    ]
    df = spark.createDataFrame(
        rows, "id string, raw_text string, embedding array<float>, entry_type string, "
        "projects array<string>, created_at timestamp")
    return df.repartition(5).cache(), rows


def brute(rows, query, k, keep=lambda r: True):
    q = np.array(query, dtype=float)
    q /= np.linalg.norm(q)
    scored = []
    for r in rows:
        if keep(r):
            v = None if r[2] is None else np.array(r[2])
            s = None if v is None else round(float(v @ q / np.linalg.norm(v)), 12)
            scored.append((s is None, -(s or 0), r[0]))
    return [i for _, _, i in sorted(scored)[:k]]


def test_one_query(data):
    df, rows = data
    for query in (rows[1][2], rows[7][2], rows[60][2]):
        assert [r.id for r in search(df, query, 50).collect()] == brute(rows, query, 50)
    got = [r.id for r in search(df, rows[1][2], 8, "decision", "p2").collect()]
    assert got == brute(rows, rows[1][2], 8, lambda r: r[3] == "decision" and "p2" in r[4])
    assert search(df, rows[1][2], 5, "", "").count() == 5
    assert search(df, rows[1][2], 500).count() == 50
    assert search(df, rows[1][2], 0).count() == 0
    assert "embedding" not in search(df, rows[1][2]).columns


def test_null_vectors_come_last_with_null_score(data):
    df, rows = data
    few = df.where("id < 'e015'")
    got = search(few, rows[1][2], 50).collect()
    assert [r.similarity_score is None for r in got] == [False] * 13 + [True] * 2
    asks = few.where("id = 'e001'").select(F.lit(1).alias("query_id"), "embedding", F.lit(50).alias("limit"))
    many = {r.id: r.similarity_score for r in search_many(few, asks).collect()}
    assert {i for i, s in many.items() if s is None} == {"e000", "e013"}


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 200])
def test_many_queries(data, broadcast_bytes):
    df, rows = data
    asks = df.where("embedding is not null").select(
        F.col("id").alias("query_id"), "embedding", F.lit(7).alias("limit"), "entry_type",
        F.when(F.substring("id", 4, 1) > "4", "p1").alias("project"),
    )
    got = {}
    for r in top_k_many(df, asks, broadcast_bytes=broadcast_bytes).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    by_id = {r[0]: r for r in rows}
    assert len(got) == asks.count()
    for query, ranks in got.items():
        me = by_id[query]
        want = brute(rows, me[2], 7, lambda r: r[3] == me[3] and (query[3] <= "4" or "p1" in r[4]))
        assert [ranks[i + 1] for i in range(len(want))] == want and len(ranks) == len(want)


@pytest.mark.parametrize("cells", [1, 3, 11])
def test_tiles_equal_the_broadcast(spark, data, cells):
    df, _ = data
    asks = df.select(
        F.col("id").alias("query_id"), "embedding", F.when(F.col("id") > "e100", 60).otherwise(4).alias("limit"),
        F.when(F.col("id") < "e030", F.col("entry_type")).alias("entry_type"),
        F.when(F.col("id") > "e110", F.lit("p2")).alias("project"), F.col("id").alias("exclude_id"),
        F.when(F.col("id") > "e060", F.col("created_at")).alias("visible_until"))
    rows = lambda d: sorted((r.query_id, r["rank"], r.id, repr(r.similarity_score)) for r in d.collect())
    want = rows(top_k_many(df, asks))
    assert rows(top_k_many(df, asks, broadcast_bytes=1, cells=cells, tile_rows=16)) == want
    assert len(want) > 400
    nothing = df.where("id < ''")
    assert top_k_many(nothing, asks, broadcast_bytes=1).count() == 0
    assert rows(top_k_many(df.where("embedding is null"), asks, broadcast_bytes=1, cells=2)) == rows(
        top_k_many(df.where("embedding is null"), asks))


def test_floors_leave_far_cells_out(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((12, 16)) * 4
    vectors = centres[rng.integers(12, size=900)] + rng.standard_normal((900, 16)) * 0.4
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id bigint, embedding array<float>")
    asks = df.select(F.col("id").alias("query_id"), "embedding", F.lit(5).alias("limit"))
    report = []
    tiled = top_k_many(df, asks, broadcast_bytes=1, cells=24, report=report)
    plain = top_k_many(df, asks)
    assert tiled.exceptAll(plain).count() == 0 and tiled.count() == plain.count() == 4500
    assert report[0] == 900 and sum(report) < 900 * 24 / 2


def test_visible_until_and_exclude(data, spark):
    df, rows = data
    until = datetime(2024, 1, 9)
    asks = spark.createDataFrame(
        [("q", rows[7][2], 4, until, "e007"), ("r", rows[7][2], 4, None, None)],
        "query_id string, embedding array<float>, limit int, visible_until timestamp, exclude_id string")
    got = top_k_many(df, asks).orderBy("rank").collect()
    want = brute(rows, rows[7][2], 4, lambda r: r[5] <= until and r[0] != "e007")
    assert [r.id for r in got if r.query_id == "q"] == want
    assert [r.id for r in got if r.query_id == "r"] == brute(rows, rows[7][2], 4)


def test_limits_are_per_query_and_capped(data):
    df, rows = data
    asks = df.where("id in ('e001', 'e002')").select(
        F.col("id").alias("query_id"), "embedding", F.when(F.col("id") == "e001", 0).otherwise(99).alias("limit"))
    got = search_many(df, asks).groupBy("query_id").count().collect()
    assert [(r.query_id, r["count"]) for r in got] == [("e002", 50)]


def test_lists(spark, data):
    df, rows = data
    path = new_path(spark, "lists")
    build_lists(df, path, lists=6)
    asks = df.where("embedding is not null").select(F.col("id").alias("query_id"), "embedding", F.lit(5).alias("limit"))
    exact = {(r.query_id, r["rank"]): r.id for r in top_k_many(df.where("embedding is not null"), asks).collect()}
    full = {(r.query_id, r["rank"]): r.id for r in ann_top_k(path, asks, probes=6, tile_rows=16).collect()}
    assert full == exact
    few = {(r.query_id, r["rank"]): r.id for r in ann_top_k(path, asks, probes=2).collect()}
    exact_hits = {(q, i) for (q, _), i in exact.items()}
    assert len({(q, i) for (q, _), i in few.items()} & exact_hits) / len(exact_hits) > 0.6
    typed = ann_top_k(path, asks.withColumn("entry_type", F.lit("decision")), probes=6)
    assert set(r.id for r in typed.collect()) <= {r[0] for r in rows if r[3] == "decision"}


def test_lists_take_new_entries_split_and_forget(spark, data):
    df, _ = data
    usable = df.where("embedding is not null")
    root = new_path(spark, "lists")
    list_index.create(list_index.train(df, 4), root)
    asks = usable.select(F.col("id").alias("query_id"), "embedding", F.lit(5).alias("limit"))
    assert ann_top_k(root, asks, 4).count() == 0  # lists without entries
    list_index.append(df.where("id < 'e060'"), root, "a")
    list_index.append(df.where("id >= 'e060'"), root, "b")
    list_index.append(df.where("id >= 'e060'"), root, "b")
    best = lambda d: {(r.query_id, r["rank"]): r.id for r in d.collect()}
    exact = best(top_k_many(usable, asks))
    assert best(ann_top_k(root, asks, 4)) == exact
    old_ids, _ = list_index.centroids(spark, root)
    before = {r.list_id: r.rows for r in list_index.sizes(spark, root).collect()}
    count = list_index.split(spark, root, 30)
    assert count == sum(n > 30 for n in before.values()) > 0
    new_ids, _ = list_index.centroids(spark, root)
    assert len(new_ids) == len(old_ids) + count and not set(new_ids) - set(old_ids) & set(range(len(old_ids)))
    assert sum(r.rows for r in list_index.sizes(spark, root).collect()) == usable.count()
    assert best(ann_top_k(root, asks, len(new_ids), tile_rows=16)) == exact
    # a reader of the former version still finds its lists
    assert list_index.read(spark, root, list(old_ids)).count() == usable.count()
    for _ in range(9):  # the third of equal rows stays in one list
        if not list_index.split(spark, root, 12):
            break
    sizes = [r.rows for r in list_index.sizes(spark, root).collect()]
    assert sum(n > 12 for n in sizes) <= 1 and max(sizes) >= 37
    assert list_index.vacuum(spark, root) > 0 and list_index.vacuum(spark, root) == 0
    assert len(list_index.versions(spark, root)) == 1
    ids, _ = list_index.centroids(spark, root)
    assert best(ann_top_k(root, asks, len(ids))) == exact


def test_lists_obey_filters(spark, data):
    df, _ = data
    usable = df.where("embedding is not null")
    root = new_path(spark, "lists")
    build_lists(df, root, lists=5)
    asks = usable.select(
        F.col("id").alias("query_id"), "embedding", F.lit(7).alias("limit"), F.col("id").alias("exclude_id"),
        F.when(F.col("id") > "e040", F.col("created_at")).alias("visible_until"),
        F.when(F.col("id") < "e080", F.col("entry_type")).alias("entry_type"),
        F.when(F.col("id") < "e020", F.lit("p1")).alias("project"))
    best = lambda d: sorted((r.query_id, r["rank"], r.id, r.similarity_score) for r in d.collect())
    assert best(ann_top_k(root, asks, 5)) == best(top_k_many(usable, asks))


def test_arrow_and_column_similarity_agree(data):
    df, rows = data
    q = [float(x) for x in rows[3][2]]
    both = df.select(
        similarity_to(q).alias("a"), cosine("embedding", F.array(*[F.lit(x) for x in q])).alias("b")).collect()
    for r in both:
        assert (r.a is None) == (r.b is None) and (r.a is None or abs(r.a - r.b) < 1e-9)


def test_recent(spark, data):
    df, _ = data
    got = [(r.created_at, r.id) for r in recent(df, datetime(2024, 1, 18), 3, limit=200).collect()]
    assert min(t for t, _ in got) == datetime(2024, 1, 15) and max(t for t, _ in got) == datetime(2024, 1, 20)
    assert got == sorted(got, key=lambda x: (-x[0].timestamp(), x[1]))
    assert recent(df, datetime(2024, 1, 20), 0).count() == recent(df, datetime(2024, 1, 20), 1).count()
    assert recent(df, datetime(2024, 1, 20)).count() == 48


def test_json_safe(data):
    df, rows = data
    out = json_safe(search(df, rows[1][2], 1)).first()
    assert out.id == "e001" and out.similarity_score == 1.0
    assert out.created_at == "2024-01-02T00:00:00+00:00"
    assert as_json(search(df, rows[1][2], 1)).first()[0].startswith('{"id":"e001","raw_text":"text 1"')


def test_hashed_vectors_put_similar_texts_closer(spark):
    texts = ["Spark is a fine engine for data work", "Spark is a great engine for data jobs",
             "The weather in the far north stays cold", "...", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    v = [r[0] for r in df.select(hashed_vector("t", 128)).collect()]
    assert v[3] is None and v[4] is None
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    assert dot(v[0], v[1]) > dot(v[0], v[2]) and abs(dot(v[0], v[0]) - 1) < 1e-6


def test_non_finite_vectors_take_no_part(spark):
    from memlake.operators.duplicates import admit
    from memlake.operators.search import top_k, top_k_many
    from memlake.sources import store

    inf, nan = float("inf"), float("nan")
    vectors = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [inf, 1.0, 0.0], [1e200, 1e200, 0.0], [nan, 1.0, 1.0], [1.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    rows = spark.createDataFrame(list(enumerate(vectors)), "id bigint, embedding array<double>")
    asks = spark.createDataFrame([(1, [1.0, 0.1, 0.0], 3), (2, [inf, 0.0, 0.0], 3)], "query_id bigint, embedding array<double>, limit int")
    got = [r.id for r in top_k_many(rows, asks).where("query_id = 1").orderBy("rank").collect()]
    assert got == [0, 5, 1]
    assert [r.id for r in top_k(rows, [1.0, 0.1, 0.0], 3).collect()] == [0, 5, 1]
    assert {r.id for r in admit(rows.withColumn("position", rows.id)).collect() if r.admitted} >= {0, 1, 5, 6}
    entries = rows.selectExpr("cast(id as string) id", "'t' raw_text", "embedding")
    _, bad = store.checked(store.with_defaults(entries, "2024-01-01 00:00:00"))
    assert {(r.id, r.fault) for r in bad.select("id", "fault").collect()} == {("2", "infinite vector"), ("4", "vector with gaps")} | (
        {("3", "infinite vector")} if bad.where("id = '3'").count() else set())


def test_copies_in_tiles_grow_no_faster_than_rows(spark):
    from memlake.operators import vector_blocks as vb

    schema = vb.schema_of(spark.range(1), "homes bigint, probes bigint")[0]

    def sizes(homes, probes):
        import pyarrow as pa

        return pa.table({"homes": [homes.num_rows], "probes": [probes.num_rows]})

    def met(n, row_bytes):
        rows = spark.range(n).select("id", F.lit(0).cast("bigint").alias("cell"))
        return vb.tile_join(rows, rows, sizes, schema, 16, row_bytes).collect()

    for n in (600, 2400):
        found = met(n, 512)
        assert sum(r.homes * r.probes for r in found) == n * n  # each pair once
        assert sum(r.homes + r.probes for r in found) <= 2 * vb.TILE_PARTS * n
    # a side that holds no more gets more tiles again
    assert max(r.homes for r in met(600, vb.TILE_BYTES // 32)) < 64


def test_a_scan_holds_small_blocks_of_scores(spark):
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa
    from memlake.functions import kernels

    rng = np.random.default_rng(3)
    asks, rows = rng.standard_normal((6000, 8)), rng.standard_normal((4000, 8))
    asks /= np.linalg.norm(asks, axis=1)[:, None]
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("s", pa.float64()), ("limit", pa.int32())])
    shared = SimpleNamespace(value={
        "matrix": asks, "usable": np.ones(6000, bool), "query_id": np.arange(6000), "limits": np.full(6000, 3)})
    batch = pa.RecordBatch.from_pydict({"id": np.arange(4000), "embedding": [list(r) for r in rows]})
    tracemalloc.start()
    (got,) = kernels.scan_top_k(shared, schema)(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    want = np.argsort(-(asks @ (rows / np.linalg.norm(rows, axis=1)[:, None]).T), axis=1, kind="stable")[:, :3]
    assert got.column("id").to_numpy().reshape(-1, 3).tolist() == want.tolist()
