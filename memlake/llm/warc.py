"""WARC archives of web pages, written in deterministic shards and read back.

Records are sorted by (url, page_id, payload digest). Shards are ranges of that order with about
equally many payload bytes: a first pass over keys and sizes alone finds the key each shard starts
with, from running sums, so the cuts depend on the rows and not on how Spark deals them. Then pages
move once, to their shard's task, which writes them in order and starts a new file whenever the
compressed size is reached. The same rows give the same bytes in the same files.

Every record is a gzip member of its own. Headers, record ids and the digests of payload and block are
made anew from the row. Of equal payloads of some length the page with the largest id keeps the payload;
the others become revisits of it, which keep the HTTP header and refer to its record. Which those are
comes from an aggregate over digests; the notes about them travel to the shards beside the pages.

A task writes under a temporary name that belongs to its attempt, and returns what it has written.
Only files of attempts that Spark has accepted are then moved to their names, and the manifest is
written last: a reader trusts the manifest alone, so files of lost attempts are never seen.

Defined results: a null html is an empty payload; a null url or page_id leaves its header out, sorts
first, and a row without page_id is never referred to; rows that repeat url, page_id and html are
records of their own, in one shard; a row is a revisit only if its page_id differs from the largest;
characters that a header line cannot hold are percent-encoded in the target URI; an empty table gives
an empty manifest. A root that has a manifest is complete and is not written again.
"""

import base64
import bisect
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from memlake.sources import scratch
from memlake.sources.scratch import cut

#: Payload bytes from which equal payloads are stored once.
LEAST = 1000
#: Payload bytes per shard, about, and the most shards; beyond, shards grow and hold several files.
SHARD_BYTES, MOST_SHARDS = 32 << 20, 16384
#: Compressed bytes at which a file is full, and compression level.
FILE_BYTES, LEVEL = 128 << 20, 6
#: A record's headers, about.
HEAD = 512
#: The date of all records, as pages carry none.
DATE = "2024-01-01T00:00:00Z"

_SAME = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_KEY = ["url", "page_id", "digest"]
_MANIFEST = "name string, shard int, number int, records long, bytes long, sha1 string"


def sha1(data: bytes) -> str:
    """Digest in the form WARC headers use."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(url: str | None, page_id: int | None, digest: bytes, copy: int = 0) -> str:
    name = hashlib.sha1(repr((url, page_id, digest.hex(), copy)).encode("utf-8", "surrogatepass")).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=name[:16], version=5)}>"


def target(url: str) -> str:
    """A URL without blanks, controls and characters beyond ASCII."""
    return "".join(chr(b) if 32 < b < 127 else f"%{b:02X}" for b in url.encode("utf-8", "surrogatepass"))


def member(headers: list[tuple[str, object]], block: bytes, level: int = LEVEL) -> bytes:
    """One record as a gzip member; headers without a value are left out."""
    lines = [f"{k}: {v}" for k, v in [*headers, ("WARC-Block-Digest", sha1(block)), ("Content-Length", len(block))] if v is not None]
    data = "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n\r\n"
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def page_record(url, page_id, payload: bytes, copy: int, refers: tuple | None, date: str, level: int = LEVEL) -> bytes:
    """A response, or a revisit of refers (url, page_id), as a gzip member."""
    digest = hashlib.sha1(payload).digest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", record_id(url, page_id, digest, copy)),
               ("WARC-Date", date), ("WARC-Target-URI", None if url is None else target(url)), ("X-Page-Id", page_id),
               ("WARC-Payload-Digest", sha1(payload))]
    if refers:
        headers += [("WARC-Profile", _SAME), ("WARC-Refers-To", record_id(*refers, digest)),
                    ("WARC-Refers-To-Target-URI", None if refers[0] is None else target(refers[0])),
                    ("WARC-Refers-To-Date", date), ("X-Refers-To-Page-Id", refers[1])]
    headers.append(("Content-Type", "application/http;msgtype=response"))
    return member(headers, http if refers else http + payload, level)


def info_record(name: str, date: str, level: int = LEVEL) -> bytes:
    headers = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name, None, b"")), ("WARC-Date", date),
               ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
    return member(headers, b"format: WARC File Format 1.1\r\n", level)


class Files:
    """The files of one task attempt: opened under temporary names, rolled by compressed size."""

    def __init__(self, folder: str, date: str, file_bytes: int, level: int):
        self.system, self.folder = fs.FileSystem.from_uri(folder)
        self.folder += f"/{uuid.uuid4().hex}"
        self.date, self.file_bytes, self.level = date, file_bytes, level
        self.out, self.shard, self.closed = None, None, []

    def _open(self):
        if not self.folder_made():
            self.system.create_dir(self.folder, recursive=True)
        self.name = f"pages-{self.shard:06d}-{self.number:05d}.warc.gz"
        self.out = self.system.open_output_stream(f"{self.folder}/{self.name}", compression=None)
        self.records, self.bytes, self.hash = 0, 0, hashlib.sha1()
        self._put(info_record(self.name, self.date, self.level))

    def folder_made(self) -> bool:
        return self.system.get_file_info(self.folder).type == fs.FileType.Directory

    def _put(self, data: bytes):
        self.out.write(data)
        self.hash.update(data)
        self.bytes += len(data)

    def add(self, shard: int, data: bytes):
        if shard != self.shard:
            self.close()
            self.shard, self.number = shard, 0
        if self.out is None:
            self._open()
        self._put(data)
        self.records += 1
        if self.bytes >= self.file_bytes:
            self.close()

    def close(self):
        if self.out is not None:
            self.out.close()
            self.out = None
            self.closed.append((self.name, self.shard, self.number, self.records, self.bytes, self.hash.hexdigest(), self.folder))
            self.number += 1


def keyed(pages: DataFrame) -> DataFrame:
    """url, page_id, digest, size, html of every page."""
    return pages.select(
        F.col("url").cast("string").alias("url"), F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).select(
        "url", "page_id", F.unhex(F.sha1(F.col("html").cast("binary"))).alias("digest"),
        F.octet_length("html").cast("long").alias("size"), "html")


def _order(row) -> tuple:
    """A key that sorts in Python as its columns do in Spark."""
    return tuple((v is not None, v.encode("utf-8", "surrogatepass") if isinstance(v, str) else 0 if v is None else v) for v in row)


def shard_starts(keys: DataFrame, shard_bytes: int, most: int) -> list[tuple]:
    """The key each shard starts with, at most one per shard; sizes are summed in key order."""
    placed = cut(keys.repartitionByRange(*_KEY).withColumn("part", F.spark_partition_id()))
    sums = sorted(placed.groupBy("part").agg(F.sum(F.col("size") + HEAD)).collect())  # a row a partition
    total, before = 0, []
    for part, size in sums:
        before.append((part, total))
        total += size
    if not total:
        return []
    each = -(-total // max(1, min(most, -(-total // shard_bytes))))
    offsets = keys.sparkSession.createDataFrame(before, "part int, before long")
    run = Window.partitionBy("part").orderBy(*_KEY).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("size") + HEAD).over(run), F.lit(0)) + F.col("before")
    first = placed.join(F.broadcast(offsets), "part").withColumn("shard", F.floor(start / F.lit(each))).groupBy("shard").agg(
        F.min(F.struct(*_KEY)).alias("key"))
    return sorted(_order((r.key.url, r.key.page_id, bytes(r.key.digest))) for r in first.collect())


def revisits(keys: DataFrame, least: int) -> DataFrame:
    """url, page_id, digest of pages whose payload another page keeps, and that page's url and id."""
    kept = keys.where((F.col("size") >= least)).groupBy("digest", "size").agg(
        F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("kept"),
        F.count(F.lit(1)).alias("n")).where("n > 1 and kept is not null")
    return keys.join(kept, ["digest", "size"]).where("page_id is null or page_id <> kept.page_id").select(
        *_KEY, F.col("kept.url").alias("kept_url"), F.col("kept.page_id").alias("kept_id"))


def write(pages: DataFrame, root: str, *, least: int = LEAST, shard_bytes: int = SHARD_BYTES,
          most_shards: int = MOST_SHARDS, file_bytes: int = FILE_BYTES, level: int = LEVEL, date: str = DATE) -> DataFrame:
    """Write all pages (page_id, url, html) below root and return the manifest."""
    spark = pages.sparkSession
    if scratch.holds_files(spark, f"{root}/manifest"):
        raise ValueError(f"{root} is complete")
    rows = keyed(pages)
    keys = cut(rows.select(*_KEY, "size"))
    starts = shard_starts(keys, shard_bytes, most_shards)
    temporary = f"{root}/_temporary"

    @F.arrow_udf("int")
    def shard_of(url: pa.Array, page_id: pa.Array, digest: pa.Array) -> pa.Array:
        found = zip(url.to_pylist(), page_id.to_pylist(), digest.to_pylist())
        return pa.array([bisect.bisect_right(starts, _order(k)) - 1 for k in found], pa.int32())

    shard = shard_of(*_KEY).alias("shard")
    notes = revisits(keys, least).select(
        shard, *_KEY, F.lit(0).alias("kind"), F.lit(None).cast("string").alias("html"), "kept_url", "kept_id")
    records = rows.select(
        shard, *_KEY, F.lit(1).alias("kind"), "html", F.lit(None).cast("string").alias("kept_url"),
        F.lit(None).cast("long").alias("kept_id"))
    dealt = records.unionByName(notes).repartitionById(max(1, len(starts)), F.col("shard")).sortWithinPartitions(
        "shard", *_KEY, "kind")
    kind = _parse_datatype_string(_MANIFEST + ", folder string")
    arrow = to_arrow_schema(kind)

    def run(batches):
        files = Files(temporary, date, file_bytes, level)
        noted, refers, last, copy = None, None, None, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64).to_pydict()
                for shard, url, page_id, digest, kind_, html, kept_url, kept_id in zip(*part.values()):
                    key = (url, page_id, digest)
                    if kind_ == 0:
                        noted, refers = key, (kept_url, kept_id)
                        continue
                    copy = copy + 1 if key == last else 0
                    last = key
                    files.add(shard, page_record(url, page_id, html.encode("utf-8", "surrogatepass"), copy,
                                                 refers if key == noted else None, date, level))
        files.close()
        if files.closed:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*files.closed), arrow)], schema=arrow)

    written = cut(dealt.mapInArrow(run, kind))
    _published(written, root).write.mode("overwrite").parquet(f"{root}/manifest")
    scratch.remove(spark, temporary)
    return manifest(spark, root)


def _published(written: DataFrame, root: str) -> DataFrame:
    """Manifest rows, their files moved to the names they keep. A move that is done stays done."""
    kind = _parse_datatype_string(_MANIFEST)
    arrow = to_arrow_schema(kind)

    def run(batches):
        system, where = fs.FileSystem.from_uri(root)
        for batch in batches:
            for name, folder in zip(batch.column("name").to_pylist(), batch.column("folder").to_pylist()):
                try:
                    system.move(f"{folder}/{name}", f"{where}/{name}")
                except FileNotFoundError:
                    if system.get_file_info(f"{where}/{name}").type != fs.FileType.File:
                        raise
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in arrow.names], schema=arrow)

    return written.mapInArrow(run, kind)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """name, shard, number, records, bytes, sha1 of every file of a complete root."""
    return spark.read.schema(_MANIFEST).parquet(f"{root}/manifest")


def members(stream, size: int = 1 << 20):
    """The decompressed gzip members of a stream, one after another."""
    left = b""
    while True:
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof:
            left = left or stream.read(size)
            if not left:
                if out:
                    raise ValueError("archive ends within a record")
                return
            out.append(unpack.decompress(left))
            left = unpack.unused_data
        yield b"".join(out)


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of a record; its length and block digest are checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    block = rest[:int(headers["content-length"])]
    if first != "WARC/1.1" or rest[len(block):] != b"\r\n\r\n" or headers["warc-block-digest"] != sha1(block):
        raise ValueError(f"damaged record {headers.get('warc-record-id')}")
    return headers, block


def read(spark: SparkSession, root: str, payloads: bool = True) -> DataFrame:
    """All page records of a complete root: file, record_id, record_type, target_uri, page_id, date,
    payload_digest (hex), payload_bytes, refers_to_id, refers_to (page id), payload (null for revisits
    and on demand). Every block digest and every payload that is there is checked."""
    schema = ("file string, record_id string, record_type string, target_uri string, page_id long, date string, "
              "payload_digest string, payload_bytes long, refers_to_id string, refers_to long, payload binary")
    kind = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def rows_of(name, system, where):
        with system.open_input_stream(f"{where}/{name}", compression=None) as stream:
            for data in members(stream):
                h, block = parsed(data)
                if h["warc-type"] == "warcinfo":
                    continue
                http, _, payload = block.partition(b"\r\n\r\n")
                n = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                whole = h["warc-type"] == "response"
                if whole and (sha1(payload) != h["warc-payload-digest"] or len(payload) != n):
                    raise ValueError(f"damaged payload of {h['warc-record-id']}")
                number = lambda k: int(h[k]) if k in h else None
                yield (name, h["warc-record-id"], h["warc-type"], h.get("warc-target-uri"), number("x-page-id"), h["warc-date"],
                       base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex(), n, h.get("warc-refers-to"),
                       number("x-refers-to-page-id"), payload if payloads and whole else None)

    def run(batches):
        system, where = fs.FileSystem.from_uri(root)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                held, size = [], 0
                for row in rows_of(name, system, where):
                    held.append(row)
                    size += 200 + len(row[-1] or b"")
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)

    files = manifest(spark, root).select("name")
    return files.repartition(max(1, min(4096, files.count()))).mapInArrow(run, kind)


def archived(pages: DataFrame, root: str, **options) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all records, read back from
    the archives that were written."""
    write(pages, root, **options)
    return read(pages.sparkSession, root, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
