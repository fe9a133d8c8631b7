"""WARC archives: a deterministic sharded writer and a reader.

Rows are dealt to shards by ranges of page_id (bounds come from a hash-chosen sample, so the same rows give the same
shards) and sorted within them. A shard's task writes one gzip member per record, starts a new file when the
compressed size passes the limit, and works out all headers and digests anew. Files are written under temporary names
and renamed when they are whole; the manifest, a Parquet table written last, names every file with its size and
digest, and only files in the manifest count. A task that runs again writes the same bytes to the same names.

Records with equal payloads of at least DEDUP_BYTES: the one with the smallest page_id is the response, the others
are revisits of it. Verdicts travel as small rows of their own next to the pages, so that the payloads are shuffled
once.

Defined cases: a null html is an empty payload; a null page_id sorts first and never stands for others unless all are
null; rows that repeat a page_id with the same payload get the same record type; an empty table gives an empty
manifest; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.llm.common import new_path, small_batches

DEDUP_BYTES = 100
ROLL_BYTES = 64 << 20
SAMPLE = 20_000
#: Bytes that the reader takes at once: what a member leaves of them is copied, so they are few.
READ_BYTES = 1 << 16
_DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, roll int, file string, records long, file_bytes long, file_sha256 string"


def record_bytes(page_id: int | None, url: str | None, digest: str, refers_to: int | None, revisit: bool, payload: bytes, size: int) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Shard:
    """The files of one shard, one after another."""

    def __init__(self, out: str, shard: int, limit: int):
        self.fs, self.root = pafs.FileSystem.from_uri(out)
        self.shard, self.limit, self.roll, self.file = shard, limit, 0, None

    def add(self, record: bytes) -> dict | None:
        if self.file is None:
            self.fs.create_dir(f"{self.root}/_temporary", recursive=True)
            self.temp = f"{self.root}/_temporary/{self.shard:05d}-{self.roll:05d}-{uuid.uuid4().hex}"
            self.file, self.sha, self.size, self.records = self.fs.open_output_stream(self.temp), hashlib.sha256(), 0, 0
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        data = packer.compress(record) + packer.flush()
        self.file.write(data)
        self.sha.update(data)
        self.size += len(data)
        self.records += 1
        return self.close() if self.size >= self.limit else None

    def close(self) -> dict | None:
        if self.file is None:
            return None
        self.file.close()
        self.file = None
        name = f"records-{self.shard:05d}-{self.roll:05d}.warc.gz"
        self.fs.move(self.temp, f"{self.root}/{name}")
        done = {"shard": self.shard, "roll": self.roll, "file": name, "records": self.records, "file_bytes": self.size, "file_sha256": self.sha.hexdigest()}
        self.roll += 1
        return done


def shard_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at or below key: a balanced tree of comparisons; null is in shard 0."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < bounds[mid], tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(key.isNull(), 0).otherwise(tree(0, len(bounds))).cast("int")


def shard_bounds(pages: DataFrame, shards: int) -> list[int]:
    """At most shards - 1 page_ids, from a sample of about SAMPLE rows that the ids' own hashes choose."""
    n = pages.count()
    every = max(1, n // SAMPLE)
    found = sorted(r[0] for r in pages.where(F.pmod(F.xxhash64("page_id"), F.lit(every)) == 0).select("page_id").dropna().distinct().collect())
    return sorted({found[len(found) * k // shards] for k in range(1, shards)}) if found else []


def write_warc(pages: DataFrame, out: str, shards: int | None = None, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as WARC files under out; returns the manifest."""
    spark = pages.sparkSession
    small_batches(spark)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    ids = rows.select("page_id", "digest", F.octet_length("payload").alias("size"))
    groups = ids.where(F.col("size") >= DEDUP_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    verdicts = ids.join(groups, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "digest", "first").distinct()
    none = lambda kind: F.lit(None).cast(kind)
    stream = rows.select("page_id", "digest", F.lit(1).alias("kind"), none("long").alias("first"), "url", "payload").unionByName(
        verdicts.select("page_id", "digest", F.lit(0).alias("kind"), "first", none("string").alias("url"), none("binary").alias("payload"))
    )
    bounds = shard_bounds(ids.select("page_id"), shards)
    stream = stream.withColumn("shard", shard_of(F.col("page_id"), bounds))
    stream = stream.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", "kind", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, verdict, done = None, (None, None, None), []
        for batch in batches:
            for r in zip(*(batch.column(c) for c in ("shard", "page_id", "digest", "kind", "first", "url", "payload"))):
                shard, page_id, digest, kind, first, url = (x.as_py() for x in r[:6])
                if kind == 0:
                    verdict = (page_id, digest, first)
                    continue
                if writer is None or writer.shard != shard:
                    done.append(writer.close() if writer else None)
                    writer = _Shard(out, shard, roll_bytes)
                revisit = verdict[:2] == (page_id, digest)
                payload = r[6].as_py()
                done.append(writer.add(record_bytes(page_id, url, digest, verdict[2], revisit, payload, len(payload))))
        done.append(writer.close() if writer else None)
        yield pa.RecordBatch.from_pylist([d for d in done if d], names)

    names = pa.schema([("shard", pa.int32()), ("roll", pa.int32()), ("file", pa.string()), ("records", pa.int64()), ("file_bytes", pa.int64()), ("file_sha256", pa.string())])
    stream.mapInArrow(run, MANIFEST).write.parquet(f"{out}/_manifest")
    return spark.read.schema(MANIFEST).parquet(f"{out}/_manifest")


def _members(f) -> Iterator[bytes]:
    """The gzip members of an open file, one at a time."""
    rest = b""
    while True:
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not rest:
                rest = f.read(READ_BYTES)
                if not rest:
                    if parts:
                        raise ValueError("the file ends within a record")
                    return
            parts.append(unpacker.decompress(rest))
            rest = unpacker.unused_data
        yield b"".join(parts)


def parse_record(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    h = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    block = rest[: int(h["Content-Length"])]
    if "sha256:" + hashlib.sha256(block).hexdigest() != h["WARC-Block-Digest"]:
        raise ValueError(f"block digest of {h['WARC-Record-ID']} differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
    page = lambda s: int(s[10:-1]) if s and len(s) > 11 else None
    kind = h["WARC-Type"]
    if kind == "response":
        digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
        if "sha256:" + digest != h["WARC-Payload-Digest"]:
            raise ValueError(f"payload digest of {h['WARC-Record-ID']} differs")
    return {"page_id": page(h["WARC-Record-ID"]), "url": h.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": page(h.get("WARC-Refers-To")), "payload": payload if kind == "response" else None}


def read_warc(spark: SparkSession, out: str) -> DataFrame:
    """All records of the files in the manifest: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""
    files = spark.read.schema(MANIFEST).parquet(f"{out}/_manifest").select("file", "records")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(out)
        for batch in batches:
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held, size, n = [], 0, 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    for data in _members(f):
                        held.append(parse_record(data))
                        size, n = size + len(data), n + 1
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                if n != records:
                    raise ValueError(f"{name} has {n} records, not {records}")
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n).mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), out)
    return read_warc(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
