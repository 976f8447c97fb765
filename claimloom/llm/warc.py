"""Deterministic sharded WARC writer and reader.

Records are sorted by (page id, digest) and dealt to shards by ranges of that key. The bounds come from the input alone: of the
rows whose hash falls under a threshold, about PER_SHARD to a shard, the running sum of sizes is cut at every
shard_bytes; so an outlying id moves nothing, and rows that repeat an id, or have none, can lie in several shards. Every
shard is a partition of its own, addressed by its number. Within a shard, records in order become gzip members with their headers, dates and
digests made anew from id and payload, and a file is closed when its compressed size passes a limit. The
files' bytes therefore do not depend on the number of executors, on task order or on retries.

A response's block is an HTTP response, so that payload and block digests differ; a revisit's block is that response's head
alone, and it names the record that it refers to.

Payloads that occur more than once are found on digests alone (a small aggregate and equi-join, in which
a hot payload is a row or a split of rows), and only payloads of response records are written. The one
shuffle that moves payloads is the one to shards.

Files are written by Spark's text writer, so any store that Spark reaches will do: a row is a gzip member
without its last byte, and the line end is that byte. It is the zero that ends the member's length field;
a record of 16 MiB or more, whose length field may end otherwise, is followed by an empty member.
Output goes to a folder with a temporary name, a manifest (file, bytes) is
written beside it, and both are renamed, the manifest last: readers take only files that it lists.

Defined results: a null html or URL is empty; rows that repeat a page id are records of their own, and all
rows with the smallest id of a payload are responses; a null id has no place in the order and its rows
come first; an empty table gives an empty manifest. Other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import common

LEAST_SHARED = 100  # bytes from which on equal payloads are written once
#: Of a compressed file; of a shard's payload, which is several files for any text that compresses by less than four.
FILE_BYTES, SHARD_BYTES = 32 << 20, 128 << 20
#: Sampled rows to a shard; bytes of a record beside its payload; bytes that the reader unpacks at a time.
PER_SHARD, RECORD_BYTES, STEP = 64, 600, 8 << 10
#: Shards of an archive: beyond 1 TB of payload they grow, so that the sample (about PER_SHARD keys to each) and the bounds stay within the driver.
MOST_SHARDS = 8192
#: Stands for a null id in the order of records.
NO_ID = -(1 << 63)
RENAMES = 16  # at a time
_EMPTY_MEMBER = bytes.fromhex("1f8b08000000000002ff0300") + bytes(8)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, kind: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {kind} {digest}')}>"


def record(page_id: int | None, url: str, digest: str, size: int, payload: bytes, refers_to: int | None) -> bytes:
    """A WARC/1.1 record, with all headers made from its contents; size is that of the full payload."""
    kind = "response" if refers_to is None else "revisit"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, kind, digest)}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Page-ID: {'' if page_id is None else page_id}", "WARC-Target-URI: " + " ".join(url.split()),
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, 'response', digest)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member (no name, no time) that ends with a zero byte."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = pack.compress(data) + pack.flush()
    return out if out[-1] == 0 else out + _EMPTY_MEMBER


def records_of(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload (what follows the HTTP head) of every record of an archive file, in time linear in its size."""
    view, at = memoryview(archive), 0
    while at < len(view):
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if at >= len(view):
                raise ValueError("the archive ends within a record")
            block = view[at : at + STEP]
            parts.append(unpack.decompress(block))
            at += len(block) - len(unpack.unused_data)
        if text := b"".join(parts):
            head, _, rest = text.partition(b"\r\n\r\n")
            headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            yield headers, rest[: int(headers["Content-Length"])].partition(b"\r\n\r\n")[2]


def shard_bounds(small: DataFrame, shard_bytes: int) -> list[tuple[int, str]]:
    """The least key (id, digest) of every shard but the first, from a sample that the rows' hashes choose."""
    total = small.agg(F.count("*").alias("rows"), F.sum(F.col("size") + RECORD_BYTES).alias("bytes")).first()
    shard_bytes = max(shard_bytes, -(-(total.bytes or 0) // MOST_SHARDS))
    shards = (total.bytes or 0) // shard_bytes + 1
    share = max(1, total.rows // (shards * PER_SHARD))
    sample = small.where(F.pmod(F.xxhash64("page_id", "digest"), F.lit(share)) == 0)  # about PER_SHARD rows to a shard
    # rows of one key have one hash: a key with a third of all rows is one row here
    keys = sample.groupBy("page_id", "digest").agg(F.sum(F.col("size") + RECORD_BYTES).alias("bytes"))
    bounds, held = [], 0
    for r in sorted((r.page_id, r.digest, r.bytes) for r in keys.collect()):
        if held * share >= shard_bytes and (not bounds or bounds[-1] < r[:2]):
            bounds.append(r[:2])
            held = 0
        held += r[2]
    return bounds


def shard_of(bounds: list[tuple[int, str]]):
    """A column function: the shard of (id, digest)."""
    ids = np.array([b[0] for b in bounds], np.int64)

    @F.arrow_udf("int")
    def place(page_id: pa.Array, digest: pa.Array) -> pa.Array:
        keys = page_id.to_numpy(zero_copy_only=False)
        out, last = np.searchsorted(ids, keys, "left"), np.searchsorted(ids, keys, "right")
        for i in np.flatnonzero(out != last):  # the id is a bound's
            out[i] = bisect.bisect_right(bounds, (int(keys[i]), digest[int(i)].as_py()), int(out[i]), int(last[i]))
        return pa.array(out.astype(np.int32))

    return place


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def write(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES, shard_bytes: int = SHARD_BYTES) -> None:
    """Write pages (page_id, url, html) as archives under path, with a manifest."""
    spark = pages.sparkSession
    base = pages.select(
        F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"),
    )
    # digests once, for all that need no payload
    small = common.cut(base.select("page_id", F.sha2("payload", 256).alias("digest"), F.length("payload").cast("long").alias("size")))
    firsts = small.where((F.col("size") >= LEAST_SHARED) & (F.col("page_id") != NO_ID)).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("digest", "first")
    revisits = small.where(F.col("size") >= LEAST_SHARED).join(firsts, "digest").where("page_id > first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    bounds = shard_bounds(small, shard_bytes)
    # one row a revisit beside the payload rows; the writer, which gets them next to one another, joins them
    rows = base.withColumns({"digest": F.sha2("payload", 256), "refers_to": F.lit(None).cast("long")})
    marks = revisits.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "refers_to")
    dealt = rows.unionByName(marks).withColumn("shard", shard_of(bounds)("page_id", "digest") if bounds else F.lit(0))
    dealt = dealt.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", "page_id", "digest", F.col("refers_to").desc_nulls_last(), "url")

    def pack(batches: Iterator) -> Iterator:
        shard = file = filled = seq = 0
        mark: tuple | None = None
        now = None
        for whole in batches:
            for b in common.slices([whole], "payload"):
                out: dict[str, list] = {"file": [], "seq": [], "page_id": [], "size": [], "row": []}
                for row in b.to_pylist():
                    if row["payload"] is None:
                        mark = (row["page_id"], row["digest"], row["refers_to"])
                        continue
                    if now != row["shard"]:
                        now, shard, file, filled, seq = row["shard"], row["shard"], 0, 0, 0
                    refers = mark[2] if mark and mark[:2] == (row["page_id"], row["digest"]) else None
                    known_id = None if row["page_id"] == NO_ID else row["page_id"]
                    data = member(record(known_id, row["url"], row["digest"], len(row["payload"]), b"" if refers is not None else row["payload"], refers))
                    if filled and filled + len(data) > file_bytes:
                        file, filled, seq = file + 1, 0, 0
                    filled += len(data)
                    for k, v in zip(out, (f"{shard:06d}-{file:04d}", seq, row["page_id"], len(data), data[:-1])):
                        out[k].append(v)
                    seq += 1
                types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

    packed = dealt.mapInArrow(pack, "file string, seq long, page_id long, size long, row binary")
    attempt = f"{path}/_attempt-{uuid.uuid4().hex}"
    (packed.sortWithinPartitions("file", "seq").select("file", F.col("row").cast("string").alias("value"))
        .write.partitionBy("file").option("lineSep", "\u0000").text(attempt))
    fs, at = _files(spark, path)

    def publish(folder) -> tuple[str, int]:
        parts = [p for p in fs.listStatus(folder) if p.getPath().getName().startswith("part-")]
        assert len(parts) == 1, "a shard lies in one partition"
        final = at(f"{path}/part-{folder.getName()[5:]}.warc.gz")
        fs.delete(final, False)
        fs.rename(parts[0].getPath(), final)
        return final.getName(), parts[0].getLen()

    folders = [f.getPath() for f in fs.listStatus(at(attempt)) if f.getPath().getName().startswith("file=")]
    with ThreadPoolExecutor(RENAMES) as pool:  # calls to the file system, which wait on it
        listed = list(pool.map(publish, folders))
    manifest = spark.createDataFrame(sorted(listed), "file string, bytes long").coalesce(1)
    manifest.write.json(f"{attempt}/manifest")
    fs.delete(at(f"{path}/manifest"), True)
    fs.rename(at(f"{attempt}/manifest"), at(f"{path}/manifest"))
    fs.delete(at(attempt), True)


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_digest (of a response: of the payload as read), header_digest, payload_bytes (of a response), payload."""
    files = spark.read.schema("file string, bytes long").json(f"{path}/manifest")
    names = [f"{path}/{r.file}" for r in files.toLocalIterator()]
    schema = "page_id long, url string, record_type string, refers_to long, payload_digest string, header_digest string, payload_bytes long, payload binary"
    if not names:
        return spark.createDataFrame([], schema)

    def unpack(batches: Iterator) -> Iterator:
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "header_digest", "payload_bytes", "payload"]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for b in batches:
            for content in b.column("content"):
                rows, held = [], 0
                for h, payload in records_of(content.as_py()):
                    first = h["WARC-Type"] == "response"
                    rows.append((
                        int(h["WARC-Page-ID"]) if h["WARC-Page-ID"] else None, h["WARC-Target-URI"], h["WARC-Type"], None if first else int(h["WARC-Refers-To-Page-ID"]),
                        hashlib.sha256(payload).hexdigest() if first else None, h["WARC-Payload-Digest"].removeprefix("sha256:"), len(payload) if first else None, payload if first else None,
                    ))
                    held += len(payload)
                    if held > 8 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    return spark.read.format("binaryFile").load(names).select("content").mapInArrow(unpack, schema)


def resolved(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: revisits take length and digest from the response that they refer to."""
    found = common.cut(found.drop("payload", "url"))
    # of the responses, only those that something refers to can be joined; there is one row for each
    source = found.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("header_digest")).agg(F.max("payload_bytes").alias("n"))
    back = found.where("record_type = 'revisit'").select("page_id", "refers_to", "header_digest").join(source, ["refers_to", "header_digest"], "left")
    return found.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").unionByName(
        back.select("page_id", F.col("n").alias("payload_bytes"), F.when(F.col("n").isNotNull(), F.col("header_digest")).alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to")
    )


def op7_warc_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{common.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(common.table(spark, sf_dir, "pages"), path)
    return resolved(read(spark, path))


ORACLE_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by payload_digest)
select p.page_id, p.payload_bytes, p.payload_digest, case when p.page_id > f.first then 'revisit' else 'response' end as record_type,
  case when p.page_id > f.first then f.first end as refers_to
from p left join f on f.payload_digest = p.payload_digest and p.payload_bytes >= 100
"""
