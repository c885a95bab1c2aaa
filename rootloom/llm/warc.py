"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page id, then payload digest: the keys are cut into ranges of about equal bytes (see
common.ranges: outliers, clumps and repeated ids make no range heavy), at boundaries that depend on the data alone;
every range is one shard, and a shard is one task.  A shard is a stream of gzip members, one a record, in files that
begin with a `warcinfo` record and are rolled once they reach `roll` compressed bytes.  Record ids and dates are derived
from the content, so a rerun gives the same bytes.  A task writes under a temporary name of its own attempt; the list of
whole files is a table, which Spark commits for the attempts that succeed only; a second job then gives each listed file
its name (a repeated attempt finds it done, or replaces a file left by an earlier write) and its rows are the manifest,
written last.  So a lost executor or a second attempt leaves no half file that a reader sees: it opens only what the
manifest lists.  Headers (lengths, block and payload digests) are always made anew from the payload.

Of equal payloads of at least `least` bytes the record with the greatest id is the response and others are revisits of
it, which carry headers only.  The greatest id is found by partial aggregation on the digest; the few facts about a
payload travel to the shard as rows of their own beside the record, so the html is shuffled once and no hot payload
meets in one task.

Files are written with Arrow's file systems: local, HDFS (needs libhdfs on the executors), S3 (also as s3a://) and GCS.

Cases: null html is an empty payload; null urls are written as an empty target; of repeated rows all with the greatest
id are responses; null ids sort first and, if all equal payloads lack an id, are responses; ids may be any long; a record
of any length is written, in memory once; an empty table gives an empty manifest; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranges, scratch, slices, stored

LEAST, ROLL, SHARD_BYTES, LEVEL = 1000, 64 << 20, 128 << 20, 6
#: Least and most shards (tasks) of a write; beyond, shards grow and files are still rolled.
SHARDS = (16, 50_000)
#: Bytes of a record beside its payload, about.
HEADERS = 800
DATE = "1970-01-01T00:00:00Z"

def _fs(uri: str):
    """(file system, path): any that Arrow knows (local, HDFS, S3, GCS)."""
    from pyarrow import fs

    for own in ("s3a://", "s3n://"):  # Spark's names for S3
        if uri.startswith(own):
            uri = "s3://" + uri[len(own) :]
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


def _digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(*parts: bytes) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(b''.join(parts)).digest()[:16], version=4)}>"


def _record_id(page_id: int | None, url: str | None, payload: bytes) -> str:
    return _name(f"{page_id}\n{url}\n".encode("utf-8", "surrogatepass"), payload)


def _target(url: str | None) -> str:
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def _framed(lines: list[str], block: bytes) -> bytes:
    head = ["WARC/1.1", *lines, f"WARC-Block-Digest: {_digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def info(file: str) -> bytes:
    """The warcinfo record that begins a file."""
    block = b"software: rootloom\r\nformat: WARC File Format 1.1\r\n"
    return _framed(["WARC-Type: warcinfo", f"WARC-Record-ID: {_name(file.encode())}", f"WARC-Date: {DATE}", f"WARC-Filename: {file}", "Content-Type: application/warc-fields"], block)


def record(page_id: int | None, url: str | None, payload: bytes, refers: tuple[int, str | None] | None = None) -> bytes:
    """One WARC record; with refers, (id, url) of the response with this payload, a revisit, whose block is the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = [f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {_record_id(page_id, url, payload)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_target(url)}"]
    lines += [f"WARC-Payload-Digest: {_digest(payload)}", "Content-Type: application/http; msgtype=response", f"X-Payload-Length: {len(payload)}"]
    lines += [] if page_id is None else [f"X-Page-ID: {page_id}"]
    if refers:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(*refers, payload)}"]
        lines += [f"WARC-Refers-To-Target-URI: {_target(refers[1])}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page: {refers[0]}"]
    return _framed(lines, head if refers else head + payload)


class Roller:
    """Files of one shard, under temporary names of one attempt."""

    def __init__(self, out: str, shard: int, roll: int, attempt: str):
        self.fs, self.root = _fs(out)
        self.shard, self.roll, self.attempt, self.n, self.open = shard, roll, attempt, 0, None

    def _write(self, data: bytes) -> None:
        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        member = z.compress(data) + z.flush()
        self.open.write(member)
        self.sha.update(member)
        self.size += len(member)

    def add(self, data: bytes) -> list[tuple]:
        if self.open is None:
            self.file = f"shard-{self.shard:06d}-{self.n:05d}.warc.gz"
            self.temp = f"{self.attempt}-{self.file}"
            self.open, self.sha, self.size, self.count = self.fs.open_output_stream(f"{self.root}/_temporary/{self.temp}", compression=None), hashlib.sha256(), 0, 0
            self._write(info(self.file))
        self._write(data)
        self.count += 1
        return self.close() if self.size >= self.roll else []

    def close(self) -> list[tuple]:
        if self.open is None:
            return []
        self.open.close()
        self.open = None
        self.n += 1
        return [(self.temp, self.file, self.shard, self.count, self.size, self.sha.hexdigest())]


def write(pages: DataFrame, out: str, roll: int = ROLL, shards: int | None = None, shard_bytes: int = SHARD_BYTES, least: int = LEAST) -> DataFrame:
    """Write pages(page_id, url, html) under the folder out; the manifest (file, shard, records, bytes, sha256) is returned and stored there."""
    data = F.coalesce("html", F.lit(""))
    facts = pages.select("page_id", "url", F.sha1(data.cast("binary")).alias("digest"), F.octet_length(data).cast("long").alias("bytes"))
    facts = stored(facts, "payload-facts")
    key = F.coalesce("page_id", F.lit(-(1 << 63)))
    sizes = facts.select(key.alias("k"), (F.col("bytes") + HEADERS).alias("w"))
    total = sizes.agg(F.sum("w")).first()[0] or 0
    cuts = ranges(sizes, shards or min(SHARDS[1], max(SHARDS[0], -(-total // shard_bytes))))
    shard = cuts.column(key, F.shiftleft(F.conv(F.substring("digest", 1, 15), 16, 10).cast("long"), 4))
    long_ = facts.filter(F.col("bytes") >= least)
    groups = long_.groupBy("digest", "bytes").agg(F.max(F.struct("page_id", "url")).alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1 and top.page_id is not null").drop("n")
    revisits = long_.select("page_id", "digest", "bytes").distinct().join(groups, ["digest", "bytes"]).filter(~F.col("page_id").eqNullSafe(F.col("top.page_id")))
    none = F.lit(None).cast("string")
    notes = revisits.select("page_id", "digest", F.lit(0).alias("kind"), F.col("top.url").alias("url"), none.alias("html"), F.col("top.page_id").alias("top"))
    rows = pages.select("page_id", F.sha1(data.cast("binary")).alias("digest"), F.lit(1).alias("kind"), "url", data.alias("html"), F.lit(None).cast("long").alias("top"))
    # a record's note comes just before it
    dealt = notes.unionByName(rows).withColumn("shard", shard).repartitionById(len(cuts), "shard").sortWithinPartitions("shard", "page_id", "digest", "kind", "url")
    names = ("shard", "page_id", "digest", "kind", "url", "html", "top")
    schema = "temp string, file string, shard int, records long, bytes long, sha256 string"

    def run(batches):
        task = TaskContext.get()
        attempt = f"{task.stageId()}-{task.partitionId()}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}" if task else uuid.uuid4().hex
        now, note, noted = None, None, None
        done: list[tuple] = []
        for batch in batches:
            for part in slices(batch):
                for s, page_id, digest, kind, url, html, top in zip(*(part.column(c).to_pylist() for c in names), strict=True):
                    if kind == 0:
                        note, noted = (top, url), (s, page_id, digest)
                        continue
                    if now is None or now.shard != s:
                        done += now.close() if now else []
                        now = Roller(out, s, roll, attempt)
                    done += now.add(record(page_id, url, html.encode("utf-8", "surrogatepass"), note if noted == (s, page_id, digest) else None))
        done += now.close() if now else []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)], schema.replace(",", "").split()[::2])

    def name(batches):
        fs, root = _fs(out)
        there = lambda path: fs.get_file_info(path).is_file
        for batch in batches:
            for temp, file in zip(batch.column("temp").to_pylist(), batch.column("file").to_pylist(), strict=True):
                at, to = f"{root}/_temporary/{temp}", f"{root}/{file}"
                if there(at):
                    if there(to):  # of an earlier write; some file systems do not move onto a file
                        fs.delete_file(to)
                    fs.move(at, to)
                elif not there(to):
                    raise FileNotFoundError(at)
            yield batch.select(["file", "shard", "records", "bytes", "sha256"])

    fs, root = _fs(out)
    fs.create_dir(f"{root}/_temporary", recursive=True)
    files = stored(dealt.mapInArrow(run, schema), "warc-files")
    manifest = files.mapInArrow(name, "file string, shard int, records long, bytes long, sha256 string")
    manifest.write.mode("overwrite").parquet(f"{out}/manifest")
    fs.delete_dir(f"{root}/_temporary")
    return pages.sparkSession.read.schema(manifest.schema).parquet(f"{out}/manifest")


def parse(stream) -> list:
    """Yields (headers with lower-case names, block) of each record of an uncompressed stream."""
    while True:
        line = stream.readline()
        while line == b"\r\n":
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode("utf-8", "surrogatepass").partition(":")
            headers[k.strip().lower()] = v.strip()
        n = int(headers["content-length"])
        block = stream.read(n)
        if len(block) < n:
            raise ValueError("record cut off")
        yield headers, block


def read(manifest: DataFrame, out: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, html) of every record that the manifest lists.

    Block and payload digests are checked against the bytes; html is null for a revisit.
    """

    def run(batches):
        fs, root = _fs(out)
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw)) as f:
                    for h, block in parse(f):
                        if _digest(block) != h["warc-block-digest"]:
                            raise ValueError(f"{name}: block digest of {h['warc-record-id']}")
                        if h["warc-type"] == "warcinfo":
                            continue
                        payload, revisit = block.partition(b"\r\n\r\n")[2], h["warc-type"] == "revisit"
                        if not revisit and (_digest(payload) != h["warc-payload-digest"] or len(payload) != int(h["x-payload-length"])):
                            raise ValueError(f"{name}: payload digest of {h['warc-record-id']}")
                        page = h.get("x-page-id")
                        digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                        rows.append((int(page) if page else None, h["warc-target-uri"], int(h["x-payload-length"]), digest, h["warc-type"], int(h["x-refers-to-page"]) if revisit else None, None if revisit else payload.decode("utf-8", "replace")))
                        held += len(payload)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    files = manifest.select("file")
    n = max(1, min(files.count(), 10_000))
    return files.repartition(n).mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")


def query(pages: DataFrame) -> DataFrame:
    out = f"{scratch(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    manifest = write(pages, out)
    return read(manifest, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
