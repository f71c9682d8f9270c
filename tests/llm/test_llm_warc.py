"""WARC archives: round trip, layout, determinism and lost attempts."""

import gzip
import hashlib
import io
import os
import random

import pytest

from memlake.llm import warc
from memlake.sources.scratch import new_path

SCHEMA = "page_id long, url string, html string, kind string, shard int"


def made(n=120):
    r = random.Random(13)
    long_ = ["<p>" + " ".join(r.choice("river stone é 𝒳 cloud".split()) for _ in range(r.randint(150, 900))) for _ in range(20)]
    rows = [(i, f"http://h{i % 7}.example.org/{i}", r.choice(long_) if i % 3 else f"<p>{r.random()}" * 40) for i in range(n)]
    rows += [(500 + i, "http://hot.example.org/same", long_[0]) for i in range(60)]
    rows += [(700, "http://a b\r\nX-Evil: 1/é", "short"), (701, "http://x/", "short"), (702, None, long_[1]), (703, "http://x/n", None),
             (704, "http://x/e", ""), (None, "http://x/i", long_[2]), (None, None, None), (705, "http://x/r", long_[3]),
             (705, "http://x/r", long_[3]), (705, "http://x/r2", long_[3]), (-7, "http://x/crlf", "\r\n\r\nWARC/1.1\r\n" * 200),
             (-8, "http://x/crlf", "\r\n\r\nWARC/1.1\r\n" * 200), (706, "http://x/long", "y" * 300_000), (707, "http://x/1000", "z" * 1000),
             (708, "http://x/999", "z" * 999), (709, "http://x/999b", "z" * 999), (710, "http://x/1000b", "z" * 1000)]
    return rows


def plain(rows):
    best = {}
    for page_id, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000 and page_id is not None:
            best[data] = max(page_id, best.get(data, page_id))
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        again = data in best and page_id != best[data]
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", best[data] if again else None))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*x, "own", 1) for x in rows], SCHEMA)


def files(root):
    return {f: open(f"{root}/{f}", "rb").read() for f in os.listdir(root) if f.endswith(".warc.gz")}


def test_round_trip(spark):
    rows = made()
    got = warc.archived(table(spark, rows).repartition(5), new_path(spark, "warc"))
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


def test_layout_is_the_same_however_rows_are_dealt(spark):
    rows, roots = made(), []
    for parts in (1, 7):
        roots.append(new_path(spark, "warc"))
        mixed = random.Random(parts).sample(rows, len(rows))
        listed = warc.write(table(spark, mixed).repartition(parts), roots[-1], shard_bytes=20_000, file_bytes=2_000)
    one, two = map(files, roots)
    assert one == two and len(one) > 20
    assert {r.name: (r.bytes, r.sha1) for r in listed.collect()} == {
        n: (len(d), hashlib.sha1(d).hexdigest()) for n, d in two.items()}
    assert sum(r.records for r in listed.collect()) == len(rows)
    assert max(r.shard for r in listed.collect()) > 3 and max(r.number for r in listed.collect()) > 0
    keys = []
    for name in sorted(one):
        info, *pages = [warc.parsed(m)[0] for m in warc.members(io.BytesIO(one[name]))]
        assert info["warc-type"] == "warcinfo" and info["warc-filename"] == name
        keys += [(h["warc-target-uri"], int(h["x-page-id"])) for h in pages if h.get("warc-target-uri", "").startswith("http://h")]
    assert keys == sorted(keys) and len(keys) == 180
    got = warc.read(spark, roots[0]).collect()
    assert sorted(map(tuple, warc.read(spark, roots[1]).collect()), key=repr) == sorted(map(tuple, got), key=repr)


def test_records_hold_their_pages(spark):
    rows = made()
    root = new_path(spark, "warc")
    warc.write(table(spark, rows), root, shard_bytes=50_000, file_bytes=5_000)
    got = warc.read(spark, root).collect()
    ids = {x.record_id: x for x in got}
    assert len(ids) == len(rows)
    want = {(i, u): (h or "").encode() for i, u, h in rows}
    shown = {(i, None if u is None else warc.target(u)): data for (i, u), data in want.items()}
    for x in got:
        data = shown[x.page_id, x.target_uri]
        if x.record_type == "response":
            assert bytes(x.payload) == data
        else:
            kept = ids[x.refers_to_id]
            assert x.payload is None and kept.record_type == "response"
            assert kept.page_id == x.refers_to and bytes(kept.payload) == data
    assert not any("\r" in (x.target_uri or "") or " " in (x.target_uri or "") for x in got)


def test_files_of_lost_attempts_are_not_seen(spark):
    rows = made(20)
    root = new_path(spark, "warc")
    os.makedirs(f"{root}/_temporary/lost")
    open(f"{root}/_temporary/lost/pages-000000-00000.warc.gz", "wb").write(b"half")
    open(f"{root}/pages-000099-00000.warc.gz", "wb").write(b"half")
    got = warc.archived(table(spark, rows), root)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)
    assert not os.path.exists(f"{root}/_temporary")
    with pytest.raises(ValueError):
        warc.write(table(spark, rows), root)
    listed = warc.manifest(spark, root)
    moved = listed.withColumn("folder", listed.name)  # moved before: moving again changes nothing
    assert warc._published(moved, root).count() == listed.count()


def test_damage_is_noticed():
    data = gzip.decompress(warc.page_record("http://x/", 1, b"abc", 0, None, warc.DATE))
    headers, block = warc.parsed(data)
    assert headers["x-page-id"] == "1" and block.endswith(b"\r\n\r\nabc")
    for broken in (data.replace(b"abc", b"abd"), data[:-1], data.replace(b"WARC/1.1", b"WARC/9.9", 1)):
        with pytest.raises(ValueError):
            warc.parsed(broken)


def test_empty_table(spark):
    root = new_path(spark, "warc")
    assert warc.archived(table(spark, []), root).count() == 0 and warc.manifest(spark, root).count() == 0
