"""Deterministic sharded WARC archives, written and read by tasks.

Pages are range-partitioned and sorted by page_id; each range is one shard.
Records are gzip members of their own, with headers and digests made anew from
the payload, and a shard goes on in a next file once ``roll_bytes`` of
compressed bytes are in it. A task writes to temporary names of its attempt and
returns a row per file; the rows of attempts that succeeded form the pending
manifest. A second job moves exactly those files to their final names and
writes the manifest that readers go by, so files of lost or repeated attempts
never count.

Of records with equal payloads of at least ``revisit_bytes``, that with the
largest page_id is a response and the others revisit it. Which page revisits
which is found on digests alone and joins the pages in the shuffle that sorts
them, as marker rows; page bodies are shuffled once.

Defined cases: null html is an empty payload; a null url gives a urn of the
page; rows that repeat a page_id and payload hold one response, the others
revisit it; a null page_id is archived first and is a response only where no
row of its group has an id; extra columns are left out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from vecspark.llm.common import forget, small_batches

ROLL_BYTES, REVISIT_BYTES = 1 << 30, 1000
DATE = "2000-01-01T00:00:00Z"
MANIFEST = "shard int, part int, temporary string, name string, records long, bytes long, sha256 string"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def revisit_marks(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, key, refers_to) of pages whose payload another row holds too."""
    keyed = (pages.select("page_id", F.coalesce("html", F.lit("")).alias("html"))
             .where(F.octet_length("html") >= revisit_bytes).select("page_id", F.sha2("html", 256).alias("key")))
    groups = (keyed.groupBy("key").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
              .where("n > 1").select("key", "refers_to"))
    return keyed.join(groups, "key").select("page_id", "key", "refers_to").distinct()


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id, digest: str, nth: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}/{nth}')}>"


def _member(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), *fields, ("WARC-Block-Digest", _sha1(block)), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(text.encode() + block + b"\r\n\r\n") + pack.flush()


def page_record(page_id, url: str | None, payload: bytes, nth: int, refers_to) -> bytes:
    """One compressed record; ``refers_to`` None makes it a response."""
    digest = _sha1(payload)
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    fields = [("WARC-Record-ID", _record_id(page_id, digest, nth)), ("WARC-Date", DATE), ("WARC-Target-URI", target),
              ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        return _member("response", fields, http + payload)
    fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _record_id(refers_to, digest, 0)),
               ("X-Refers-To-Page-ID", str(refers_to))]
    return _member("revisit", fields, http)


class _Shard:
    """The files of one range, under temporary names of this attempt."""

    def __init__(self, out: str, shard: int, roll_bytes: int):
        self.fs, self.root = pafs.FileSystem.from_uri(out)
        self.shard, self.roll, self.part, self.file = shard, roll_bytes, -1, None
        self.folder = f"{self.root}/_temporary/{uuid.uuid4().hex}"

    def add(self, member: bytes):
        if self.file is None:
            self.part += 1
            self.name = f"shard-{self.shard:06d}-{self.part:05d}.warc.gz"
            self.fs.create_dir(self.folder, recursive=True)
            self.file, self.sum, self.records, self.size = self.fs.open_output_stream(
                f"{self.folder}/{self.name}", compression=None), hashlib.sha256(), 0, 0
            self._put(_member("warcinfo", [("WARC-Record-ID", _record_id("file", self.name, 0)), ("WARC-Date", DATE),
                                           ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")],
                              b"format: WARC File Format 1.1\r\n"))
        self._put(member)
        self.records += 1

    def _put(self, member: bytes):
        self.file.write(member)
        self.sum.update(member)
        self.size += len(member)

    def roll_over(self, last: bool = False):
        """The manifest row of the file, if it is full or the last one."""
        if self.file is None or not last and self.size < self.roll:
            return []
        self.file.close()
        self.file = None
        return [(self.shard, self.part, f"{self.folder}/{self.name}", self.name, self.records, self.size, self.sum.hexdigest())]


def _manifest_batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
        zip(*rows), (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()))],
        names=["shard", "part", "temporary", "name", "records", "bytes", "sha256"])


def write_archives(pages: DataFrame, out: str, roll_bytes: int = ROLL_BYTES, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Archives all pages in the shared folder ``out``, which must be new."""
    spark = pages.sparkSession
    small_batches(spark, 500)
    marks = revisit_marks(pages, revisit_bytes).select(
        "page_id", F.lit(0).alias("row"), "key", "refers_to", F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("string").alias("html"))
    rows = pages.select("page_id", F.lit(1).alias("row"), F.lit(None).cast("string").alias("key"),
                        F.lit(None).cast("long").alias("refers_to"), "url", "html")
    order = [F.col("page_id").asc_nulls_first(), "row", "url", F.xxhash64("html")]

    def write(batches):
        shard, at = _Shard(out, TaskContext.get().partitionId(), roll_bytes), object()
        marked, nths = {}, {}
        for batch in batches:
            done = []
            for page_id, row, key, refers_to, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                if page_id != at:
                    at, marked, nths = page_id, {}, {}
                if row == 0:
                    marked[key] = refers_to
                    continue
                payload = (html or "").encode()
                key = hashlib.sha256(payload).hexdigest()
                nth = nths[key] = nths.get(key, -1) + 1
                refers = marked.get(key)
                shard.add(page_record(page_id, url, payload, nth, None if refers == page_id and nth == 0 else refers))
                done += shard.roll_over()
            if done:
                yield _manifest_batch(done)
        if done := shard.roll_over(last=True):
            yield _manifest_batch(done)

    pending = f"{out}/_pending"
    rows.unionByName(marks).repartitionByRange(F.col("page_id").asc_nulls_first()).sortWithinPartitions(*order).mapInArrow(
        write, MANIFEST).write.parquet(pending)

    def move(batches):
        files, root = pafs.FileSystem.from_uri(out)
        for batch in batches:
            for row in batch.to_pylist():
                target = f"{root}/{row['name']}"
                # a repeated task finds its files moved
                if files.get_file_info(target).type == pafs.FileType.NotFound:
                    files.move(row["temporary"], target)
                if files.get_file_info(target).size != row["bytes"]:
                    raise OSError(f"{target} is not the file of its manifest row")
            yield batch

    spark.read.schema(MANIFEST).parquet(pending).mapInArrow(move, MANIFEST).write.parquet(f"{out}/_manifest")
    forget(spark, pending, f"{out}/_temporary")


def manifest(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{out}/_manifest")


def records(stream):
    """(fields, block) of every record of a decompressed archive."""
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"not a record: {line[:60]!r}")
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(": ")
            fields[name] = value
        block = stream.read(int(fields["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n" or _sha1(block) != fields["WARC-Block-Digest"]:
            raise ValueError(f"broken record {fields.get('WARC-Record-ID')}")
        yield fields, block


def read_archives(spark: SparkSession, out: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page record of the manifest's files."""
    files = manifest(spark, out).select("name")

    def read(batches):
        found, root = pafs.FileSystem.from_uri(out)
        names = [n for b in batches for n in b.column(0).to_pylist()]
        for name in names:
            rows = []
            with found.open_input_stream(f"{root}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as plain:
                for fields, block in records(io.BufferedReader(plain, 1 << 20)):
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"Content-Length: (\d+)", head)[1])
                    digest = fields["WARC-Payload-Digest"]
                    if fields["WARC-Type"] == "response" and (_sha1(payload) != digest or len(payload) != size):
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} is broken")
                    page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
                    rows.append((int(page) if page else None, size, base64.b32decode(digest[5:]).hex(), fields["WARC-Type"],
                                 int(refers) if refers else None))
                    if len(rows) == 10_000:
                        yield _record_batch(rows)
                        rows = []
            if rows:
                yield _record_batch(rows)

    # a task for each file; the folder's listing is never asked for
    return files.repartitionByRange(max(1, files.count()), "name").mapInArrow(read, RECORD)


def _record_batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
        zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))],
        names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
