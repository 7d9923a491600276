"""A corpus tree, base/<doc_set>/<title>/<file>, as a data source of Spark's: read by doc set, written whole or not at all.

Written files stand in a hidden folder of the tree until every task is through; then the driver moves them to their place, a
doc set that is new by one rename, and a job that fails leaves the tree as it was. Where the driver is lost between two
renames, recovered() finishes the move. On a store without renames (S3) each move is a copy, and readers can see a part of it.
"""

from __future__ import annotations

import contextlib
import json
import time
import uuid
import zlib
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

NAME = "corpus_tree"
ROWS = "doc_set string, title string, content string"
#: Spark's file sources, too, pass over names that begin so.
STAGING, MOVING = "_staging-", "_moving"
PAGE = "docContent.md"


class TreeError(ValueError):
    pass


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme of its file system, which for a plain one is the session's default."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return str(p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString())


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """Arrow's file system and path for a name as Hadoop writes it."""
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return pyarrow.fs.LocalFileSystem(), uri
    if scheme == "file":
        return pyarrow.fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pyarrow.fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3", "gcs": "gs"}.get(scheme, scheme) + ":" + rest)


def folders(fs: pyarrow.fs.FileSystem, path: str) -> list[str]:
    found = fs.get_file_info(pyarrow.fs.FileSelector(path, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == pyarrow.fs.FileType.Directory)


def there(fs: pyarrow.fs.FileSystem, path: str) -> bool:
    return fs.get_file_info(path).type != pyarrow.fs.FileType.NotFound


@dataclass
class Part(InputPartition):
    doc_set: str
    part: int


class Reader(DataSourceReader):
    """A doc set in `splits` partitions, by the hash of a page's title, as one doc set may hold most of the pages."""

    def __init__(self, options: dict):
        self.base, self.file, self.splits = options["path"], options.get("file", PAGE), int(options.get("splits", "8"))
        self.sets = set(json.loads(options["doc_sets"])) if "doc_sets" in options else None

    def pushFilters(self, filters):
        """Names of doc sets are taken over, all else is left to Spark."""
        for f in filters:
            named = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if named is not None and f.attribute == ("doc_set",):
                self.sets = named if self.sets is None else self.sets & named
            else:
                yield f

    def partitions(self):
        fs, root = file_system(self.base)
        if not there(fs, root):
            raise TreeError(f"there is no tree at {self.base}")
        sets = [d for d in folders(fs, root) if "@" in d and (self.sets is None or d in self.sets)]
        # Spark takes no partitions at all for one partition without a value.
        return [Part(d, i) for d in sets for i in range(self.splits)] or [Part("", 0)]

    def read(self, partition: Part):
        if not partition.doc_set:
            return
        fs, root = file_system(self.base)
        folder = f"{root}/{partition.doc_set}"
        for title in folders(fs, folder):
            if zlib.crc32(title.encode()) % self.splits == partition.part and there(fs, f"{folder}/{title}/{self.file}"):
                with fs.open_input_stream(f"{folder}/{title}/{self.file}") as f:
                    yield partition.doc_set, title, f.read().decode(errors="replace").replace("\r\n", "\n").replace("\r", "\n")


@dataclass
class Written(WriterCommitMessage):
    doc_sets: list[str]
    files: int


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.base, self.file, self.overwrite = options["path"], options.get("file", PAGE), overwrite
        self.staging = STAGING + uuid.uuid4().hex

    def write(self, iterator):
        fs, root = file_system(self.base)
        sets, n = set(), 0
        for b in iterator:
            for d, t, c in zip(*(b.column(k).to_pylist() for k in ("doc_set", "title", "content"))):
                if any(not x or "/" in x or x in (".", "..") for x in (d, t)) or "@" not in d:
                    raise TreeError(f"no folder can be named so: {d!r}, {t!r}")
                folder = f"{root}/{self.staging}/{d}/{t}"
                fs.create_dir(folder, recursive=True)
                # Two attempts of a task may write at once: each under a name of its own, which then takes the file's place.
                own = f"{folder}/{self.file}.{uuid.uuid4().hex}"
                with fs.open_output_stream(own) as out:
                    out.write((c or "").encode())
                fs.move(own, f"{folder}/{self.file}")
                sets.add(d)
                n += 1
        return Written(sorted(sets), n)

    def commit(self, messages):
        fs, root = file_system(self.base)
        sets = sorted({d for m in messages if m for d in m.doc_sets})
        if sets:
            # Written under another name first, so that it is there as a whole or not at all.
            at = f"{root}/{self.staging}/{MOVING}"
            with fs.open_output_stream(at + "-") as out:
                out.write(json.dumps({"doc_sets": sets, "overwrite": self.overwrite}).encode())
            fs.move(at + "-", at)
            move_in(fs, root, self.staging)

    def abort(self, messages):
        fs, root = file_system(self.base)
        # Tasks that are being killed may still write: what they leave is hidden, and recovered() drops it.
        for wait in (0, 0.5, 2):
            time.sleep(wait)
            with contextlib.suppress(OSError):
                if there(fs, f"{root}/{self.staging}"):
                    fs.delete_dir(f"{root}/{self.staging}")
                return


def move_in(fs: pyarrow.fs.FileSystem, root: str, staging: str) -> None:
    """Staged doc sets to their places, as the staging folder's note says; what was moved before stays. With overwrite a doc
    set takes the place of the one of its name; else its files join those of the pages that are there."""
    held = f"{root}/{staging}"
    with fs.open_input_stream(f"{held}/{MOVING}") as f:
        note = json.loads(f.read())

    def join(title: str, at: str, to: str) -> None:
        if not there(fs, f"{to}/{title}"):
            fs.move(f"{at}/{title}", f"{to}/{title}")
            return
        for f in fs.get_file_info(pyarrow.fs.FileSelector(f"{at}/{title}")):
            fs.move(f.path, f"{to}/{title}/{f.base_name}")

    for d in note["doc_sets"]:
        at, to = f"{held}/{d}", f"{root}/{d}"
        if not there(fs, at):
            continue
        if there(fs, to) and note["overwrite"]:
            fs.create_dir(f"{held}/_old", recursive=True)
            fs.move(to, f"{held}/_old/{d}")
        if not there(fs, to):
            fs.move(at, to)
        else:
            with ThreadPoolExecutor(16) as pool:
                list(pool.map(lambda t: join(t, at, to), folders(fs, at)))
    fs.delete_dir(held)


def recovered(spark: SparkSession, base: str) -> int:
    """Finishes writes whose move had begun when their driver was lost, and drops those that had not come so far. To be called
    while nobody writes to the tree; gives how many were finished."""
    fs, root = file_system(qualified(spark, base))
    n = 0
    for d in folders(fs, root):
        if d.startswith(STAGING):
            if there(fs, f"{root}/{d}/{MOVING}"):
                move_in(fs, root, d)
                n += 1
            else:
                fs.delete_dir(f"{root}/{d}")
    return n


class CorpusTree(DataSource):
    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return ROWS

    def reader(self, schema):
        return Reader(dict(self.options))

    def writer(self, schema, overwrite):
        return Writer(dict(self.options), overwrite)


def registered(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CorpusTree)
    return spark


def read(spark: SparkSession, base: str, file: str = PAGE, doc_sets: list[str] | None = None, splits: int = 8) -> DataFrame:
    """(doc_set, title, content) of the pages that have the file. A filter on doc_set, or doc_sets, keeps the other doc sets from
    being listed or read. An empty tree has no rows; that there is no folder is an error."""
    r = registered(spark).read.format(NAME).options(file=file, splits=splits)
    return (r if doc_sets is None else r.option("doc_sets", json.dumps(doc_sets))).load(qualified(spark, base))


def write(pages: DataFrame, base: str, file: str = PAGE, overwrite: bool = False) -> None:
    """Writes a file for each row of pages (doc_set, title, content, ...), all or none. With overwrite the doc sets that are
    written replace those of their names; else their files join what is there, a file of the same name being replaced.

    A null content is an empty file. A null or empty name, one with a slash, and a doc set without @ are errors. Of rows with
    one doc set and title one stays. Without rows nothing changes.
    """
    w = registered(pages.sparkSession)
    rows = pages.select("doc_set", "title", "content")
    rows.write.format(NAME).mode("overwrite" if overwrite else "append").option("file", file).save(qualified(w, base))
