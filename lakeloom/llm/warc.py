"""WARC archives with a Zstandard dictionary.

Each task writes its records to archives in a shared folder: a skippable frame (0x184D2A5D) with a dictionary that is
built from the first records of that archive, then one frame for each record. Of equal payloads the smallest page is a
response, the others are revisits that refer to it. Files are named by task attempt and listed in a saved manifest, so a
task that runs again leaves no file that is read. Payloads stay where they are read: only their hashes are shuffled, and
what repeats is sent to them, unless that is too much to broadcast. Each archive is read in a task of its own.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import own_dir, saved, table

SKIPPABLE = 0x184D2A5D
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MANIFEST = "path string, records long, bytes long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    head = {"WARC-Type": kind, **fields, "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id, url, payload: bytes, first, date: str) -> bytes:
    sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    name = lambda i: f"<urn:x-page:{i}>"
    target = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or f"urn:x-page:{page_id}")
    fields = {"WARC-Record-ID": name("" if page_id is None else page_id), "WARC-Date": date, "WARC-Target-URI": target, "WARC-Payload-Digest": f"sha1:{sha}", "X-Payload-Bytes": str(len(payload)), "Content-Type": "application/http;msgtype=response"}
    if url is None:
        fields["X-No-URL"] = "1"
    if first is None or first == page_id:
        return record("response", fields, HTTP + payload)
    return record("revisit", fields | {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": name(first)}, HTTP)


def dictionary(samples: list[bytes], size: int) -> zstandard.ZstdCompressionDict | None:
    """Trained on the samples; the samples' own bytes where they are too few to train on."""
    total = sum(map(len, samples))
    if total < 1024:
        return None
    if len(samples) >= 16 and total >= 8 * size:
        try:
            return zstandard.train_dictionary(size, samples)
        except zstandard.ZstdError:
            pass
    return zstandard.ZstdCompressionDict(b"".join(samples)[-min(size, total) :], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def filesystem(uri: str):
    """(file system, path) of a folder that Spark names by Hadoop's schemes, where Arrow knows the store by another name."""
    scheme, _, rest = uri.partition(":")
    if "/" in scheme or not rest:
        return pyarrow.fs.LocalFileSystem(), uri
    if scheme == "dbfs":  # mounted on all machines
        return pyarrow.fs.LocalFileSystem(), "/dbfs/" + rest.lstrip("/")
    if scheme in ("wasb", "wasbs"):
        scheme, rest = scheme.replace("wasb", "abfs"), rest.replace(".blob.", ".dfs.", 1)
    if scheme == "file" and not rest.startswith("//"):  # as Hadoop writes local paths
        return pyarrow.fs.LocalFileSystem(), rest
    scheme = {"s3a": "s3", "s3n": "s3", "gcs": "gs"}.get(scheme, scheme)
    return pyarrow.fs.FileSystem.from_uri(f"{scheme}:{rest}")


class Archive:
    """Keeps the first records until there is enough to build the dictionary from, then writes as they come."""

    def __init__(self, fs, path: str, dict_bytes: int, sample_bytes: int, date: str):
        self.fs, self.path, self.dict_bytes, self.sample_bytes = fs, path, dict_bytes, sample_bytes
        self.held, self.held_bytes, self.out, self.records, self.bytes = [], 0, None, 0, 0
        self.add(record("warcinfo", {"WARC-Record-ID": "<urn:x-archive>", "WARC-Date": date, "Content-Type": "application/warc-fields"}, b"software: lakeloom\r\nformat: WARC File Format 1.1\r\n"))

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.out is None:
            self.held.append(data)
            self.held_bytes += len(data)
            if self.held_bytes >= self.sample_bytes:
                self._open()
        else:
            self._write(self.zstd.compress(data))

    def _open(self) -> None:
        self.out = self.fs.open_output_stream(self.path)
        trained = dictionary([x[: self.sample_bytes // 16] for x in self.held], self.dict_bytes)
        self.zstd = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True)
        if trained:
            raw = trained.as_bytes()
            self._write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
        for x in self.held:
            self._write(self.zstd.compress(x))
        self.held = []

    def close(self) -> tuple[str, int, int]:
        if self.out is None:
            self._open()
        self.out.close()
        return self.path, self.records, self.bytes


def write(pages: DataFrame, folder: str, *, min_bytes: int = 0, dict_bytes: int = 65_536, sample_bytes: int = 2 << 20, archive_bytes: int = 64 << 20, date: str = "2024-01-01T00:00:00Z", most: int = 500_000) -> DataFrame:
    """pages (page_id, url, html) -> a saved manifest of the archives written under `folder`; other columns are not read.

    A null html is an empty payload. Payloads under min_bytes and rows without a page_id are responses and referred to by
    none; rows that repeat the smallest page_id are each a response. An empty table makes no archive. Payloads of any
    length are written whole. most: repeated payloads whose hashes are broadcast; beyond, hashes are joined first and
    their pages, which no hash can crowd, after that.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    named = (F.octet_length("payload") >= min_bytes) & F.col("page_id").isNotNull()
    hashes = rows.where(named).select("sha", "page_id")
    again = saved(hashes.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    if again.count() <= most:
        joined = rows.join(F.broadcast(again), "sha", "left").withColumn("first", F.when(named, F.col("first")))
    else:
        refers = hashes.join(again, "sha").where("page_id <> first").distinct()
        joined = rows.withColumn("ours", named).join(refers.withColumn("ours", F.lit(True)), ["page_id", "sha", "ours"], "left")
    joined = joined.select("page_id", "url", "payload", "first")

    def put(batches):
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        task, n, at, done = TaskContext.get(), 0, None, []
        for batch in batches:
            for page_id, url, payload, first in zip(*(batch.column(c) for c in range(4))):
                if at is None:
                    at = Archive(fs, f"{base}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{n:04d}.warc.zst", dict_bytes, sample_bytes, date)
                at.add(page_record(page_id.as_py(), url.as_py(), payload.as_py(), first.as_py(), date))
                if at.bytes >= archive_bytes:
                    done.append(at.close())
                    at, n = None, n + 1
        if at is not None:
            done.append(at.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return saved(joined.mapInArrow(put, MANIFEST))


def records_of(stream):
    """(fields, block) of each record of a dictionary-compressed archive, one at a time."""
    head, trained = stream.read(8), None
    if len(head) == 8 and (size := struct.unpack("<II", head))[0] == SKIPPABLE:
        trained = zstandard.ZstdCompressionDict(stream.read(size[1]))
        head = b""
    text = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=trained).stream_reader(_Joined(head, stream), read_across_frames=True), 1 << 16)
    while line := text.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"not a record: {line[:40]!r}")
        fields = {}
        while (line := text.readline()).strip():
            k, _, v = line.decode().partition(":")
            fields[k] = v.strip()
        block = text.read(int(fields["Content-Length"]))
        if len(block) != int(fields["Content-Length"]) or text.read(4) != b"\r\n\r\n":
            raise ValueError(f"a record is cut short: {fields.get('WARC-Record-ID')}")
        yield fields, block


class _Joined:
    def __init__(self, head: bytes, rest):
        self.head, self.rest = head, rest

    def read(self, n: int = -1) -> bytes:
        if self.head:
            out, self.head = self.head, b""
            return out
        return self.rest.read(n)


def read(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """manifest (path) -> a row for each page record, digests taken anew from the responses' payloads. Each archive is a
    task of its own; a path that the manifest repeats is read as often."""

    def get(batches):
        fs, _ = filesystem(folder)
        number = lambda x: int(m) if x and (m := x.rpartition(":")[2].rstrip(">")) else None
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                out, held = [], 0
                with fs.open_input_stream(path) as stream:
                    for f, block in records_of(stream):
                        if f["WARC-Type"] == "warcinfo":
                            continue
                        url = None if "X-No-URL" in f else f["WARC-Target-URI"]
                        sha, size, body = f["WARC-Payload-Digest"].partition(":")[2], int(f["X-Payload-Bytes"]), None
                        if f["WARC-Type"] == "response":
                            body = block[block.index(b"\r\n\r\n") + 4 :]
                            got = base64.b32encode(hashlib.sha1(body).digest()).decode()
                            if got != sha or len(body) != size:
                                raise ValueError(f"payload of {f['WARC-Record-ID']} differs from its digest")
                        out.append((number(f["WARC-Record-ID"]), url, f["WARC-Type"], number(f.get("WARC-Refers-To")), sha, size, body if payloads else None))
                        held += len(body or b"") if payloads else 0
                        if len(out) >= 4096 or held >= 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)
                            out, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)

    return manifest.select("path").repartitionByRange(max(1, manifest.count()), "path").mapInArrow(get, RECORDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = own_dir(spark, "warc")
    manifest = write(table(spark, sf_dir, "pages"), folder)
    return read(manifest, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (
  SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, hex, min(page_id) OVER (PARTITION BY hex) AS first_id,
         array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', substr(hex, i::INT, 1)) - 1)::INT + 1, 4)), '') AS b
  FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (16 * substr(b, 5 * i::INT + 1, 1)::INT + 8 * substr(b, 5 * i::INT + 2, 1)::INT + 4 * substr(b, 5 * i::INT + 3, 1)::INT + 2 * substr(b, 5 * i::INT + 4, 1)::INT + substr(b, 5 * i::INT + 5, 1)::INT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM bits
"""
