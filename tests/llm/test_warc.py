import base64
import hashlib
import struct
import types

import pyarrow.fs
import pytest

from lakeloom.llm import warc
from lakeloom.llm.common import own_dir

ROWS = [(1, "http://a.example.com/", "<p>one</p>"), (2, None, "<p>two</p>"), (3, "http://a b\r\nc", "<p>one</p>"), (4, "http://d", None), (5, "http://e", ""), (6, "u", "long " * 300_000), (6, "u", "long " * 300_000), (None, "n", "<p>one</p>"), (7, "é", "ünï\r\n\r\n"), (0, "z", "long " * 300_000)]


def archived(spark, rows, **options):
    folder = own_dir(spark, "warc-test")
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, record_type string")
    manifest = warc.write(df, folder, **options)
    return manifest, warc.read(manifest, folder).collect()


@pytest.mark.parametrize("most", [500_000, 0])
def test_round_trip(spark, most):
    """Also where the hashes of repeated payloads are too many to broadcast."""
    manifest, got = archived(spark, ROWS, most=most)
    assert len(got) == len(ROWS)
    assert {r["url"] for r in got if r["page_id"] not in (None, 3)} == {u for i, u, _ in ROWS if i not in (None, 3)}
    first = {}
    for i, _, h in ROWS:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    for r in got:
        html = next((h or "") for i, _, h in ROWS if i == r["page_id"])
        raw = html.encode()
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        lead = r["page_id"] is None or first[html] == r["page_id"]
        assert r["record_type"] == ("response" if lead else "revisit") and r["refers_to"] == (None if lead else first[html])
        assert r["payload"] == (raw if lead else None)


def test_least_size(spark):
    _, got = archived(spark, ROWS, min_bytes=100)
    assert {r["record_type"] for r in got if r["payload_bytes"] < 100} == {"response"}
    assert sum(r["record_type"] == "revisit" for r in got) == 2


def test_dictionary_frame_and_rolling(spark):
    rows = [(i, f"http://h/{i}", f"<html><body>page {i} of many with the same words around it {'x' * (i % 50)}</body></html>") for i in range(800)]
    manifest, got = archived(spark, rows, archive_bytes=8_000, sample_bytes=20_000, dict_bytes=2_048)
    paths = [r["path"] for r in manifest.collect()]
    assert len(got) == 800 and len(paths) > 4
    fs, _ = warc.filesystem(own_dir(spark, "x"))
    with fs.open_input_stream(paths[0]) as s:
        magic, n = struct.unpack("<II", s.read(8))
        assert magic == warc.SKIPPABLE and 0 < n <= 2_048 + 16
    with fs.open_input_stream(paths[0]) as s:
        kinds = [f["WARC-Type"] for f, _ in warc.records_of(s)]
    assert kinds[0] == "warcinfo" and set(kinds[1:]) == {"response"}


def test_empty_table(spark):
    folder = own_dir(spark, "warc-test")
    manifest = warc.write(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read(manifest, folder).collect() == []


def test_local_paths():
    fs, path = warc.filesystem("/tmp/x")
    assert isinstance(fs, pyarrow.fs.LocalFileSystem) and path == "/tmp/x"


def test_an_archive_a_task(spark):
    """As many read tasks as archives, also where pages that repeat lie in several of them; no payload is shuffled."""
    rows = [(i % 500, f"http://h/{i}", f"page {i % 500} " + "x" * 300) for i in range(2_000)]
    folder = own_dir(spark, "warc-test")
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    manifest = warc.write(df, folder, archive_bytes=8_000, sample_bytes=2_000)
    n = manifest.count()
    assert n > 12 and manifest.rdd.getNumPartitions() == 6
    out = warc.read(manifest, folder)
    held = out.rdd.glom().map(len).collect()
    assert out.rdd.getNumPartitions() == n and min(held) > 0 and max(held) < 400
    got = out.collect()
    assert len(got) == 2_000 and {r["record_type"] for r in got} == {"response"}
    assert {r["payload_digest"] for r in got} == {base64.b32encode(hashlib.sha1(h.encode()).digest()).decode() for _, _, h in rows}


def test_names_of_stores(monkeypatch):
    asked = []
    monkeypatch.setattr(warc, "pyarrow", types.SimpleNamespace(fs=types.SimpleNamespace(LocalFileSystem=lambda: "local", FileSystem=types.SimpleNamespace(from_uri=lambda u: asked.append(u)))))
    assert warc.filesystem("dbfs:/a/b") == ("local", "/dbfs/a/b") and warc.filesystem("/a:b/c") == ("local", "/a:b/c")
    for uri in ("s3a://bucket/x", "gs://bucket/x", "hdfs://host:1/x", "file:///x", "wasbs://c@a.blob.core.windows.net/x"):
        warc.filesystem(uri)
    assert asked == ["s3://bucket/x", "gs://bucket/x", "hdfs://host:1/x", "file:///x", "abfss://c@a.dfs.core.windows.net/x"]


def test_shared_folder_has_its_scheme(spark):
    """A folder that is named without a scheme belongs to Spark's default file system, and Arrow has to be told which that is."""
    from lakeloom.llm.common import shared_dir

    folder = shared_dir(spark)
    assert folder.split(":")[0] == "file"
    fs, path = warc.filesystem(folder)
    assert type(fs).__name__ == "LocalFileSystem" and path.startswith("/") and not path.startswith("//")
    assert warc.filesystem("file:/a b/c")[1] == "/a b/c"
