"""Suffix-array dedup of byte strings by bucket-pointer refinement.

repeats.py brings together the parts of the corpus that can hold a repeat. There the suffixes are put in buckets of equal
q-grams, in order. A bucket whose suffixes share d bytes is refined by sorting them on the bucket identifiers at offset d;
an identifier is the place of the bucket in the order, so it is written back at once and serves all that is sorted later in
the same pass, and a bucket just split is refined again at its new depth before the next ones are. Suffixes alone in their
bucket take no further part. Neighbours in the order that share the window's bytes are then equal windows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import table
from lakeloom.llm.repeats import Bytes, Finder, cut_repeats, spread

Q = 8
#: Suffixes that are sorted at once: whole buckets, one after the other.
CHUNK = 1 << 15
#: How often a chunk is refined before the next one is.
DEEPER = 2


class Buckets:
    """The suffixes of some strings, in order of their first `depth` bytes at least."""

    def __init__(self, data: np.ndarray, first: np.ndarray, size: np.ndarray, depth: int):
        self.depth = depth
        self.every = spread(first, size)
        self.left = np.zeros(len(data), np.int32)
        self.left[self.every] = np.repeat(first + size, size) - self.every  # bytes to the end of the string
        raw = np.concatenate((data, np.zeros(Q, np.uint8))).astype(np.uint64)
        self.gram = np.zeros(len(data), np.uint64)
        for j in range(Q):
            byte = raw[j : j + len(data)]
            self.gram |= np.where(self.left > j, byte, np.uint64(0)) << np.uint64(8 * (Q - 1 - j))
        # bucket: its place in the order, from 1; 0 is beyond the end. deep: bytes that its suffixes share.
        self.bucket, self.deep = np.zeros(len(data) + 1, np.int64), np.zeros(len(data) + 1, np.int32)
        order = self.every[np.argsort(self.gram[self.every], kind="stable")]
        g = self.gram[order]
        self.bucket[order] = place(np.concatenate(([True], g[1:] != g[:-1]))) + 1
        self.deep[order] = Q
        todo = self.unsolved(order)
        while len(todo):
            for chunk in self.chunks(todo):
                for _ in range(DEEPER):
                    chunk = self.unsolved(self.refine(chunk))
                    if not len(chunk):
                        break
            todo = self.unsolved(todo[np.argsort(self.bucket[todo], kind="stable")])

    def unsolved(self, order: np.ndarray) -> np.ndarray:
        """Of suffixes in order those that share a bucket of too little depth."""
        b = self.bucket[order]
        same = b[1:] == b[:-1]
        return order[(np.append(same, False) | np.concatenate(([False], same)))[: len(order)] & (self.deep[order] < self.depth)]

    def chunks(self, order: np.ndarray):
        b = self.bucket[order]
        edge = np.append(np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))), len(order))
        at = 0
        while at < len(order):
            to = int(edge[min(np.searchsorted(edge, at + CHUNK), len(edge) - 1)])
            yield order[at:to]
            at = to

    def refine(self, chunk: np.ndarray) -> np.ndarray:
        """Whole buckets in order, sorted on the identifiers at their depth; the identifiers and depths are written back."""
        old, off = self.bucket[chunk], self.deep[chunk]
        later = np.where(self.left[chunk] > off, chunk + off, len(self.bucket) - 1)
        key = self.bucket[later]
        by = np.argsort(old << 32 | key)
        chunk, old, key, later = chunk[by], old[by], key[by], later[by]
        head = np.concatenate(([True], old[1:] != old[:-1]))
        new = head | np.concatenate(([True], key[1:] != key[:-1]))
        self.bucket[chunk] = old + place(new) - place(head)
        # Past the end there is nothing left to tell apart.
        self.deep[chunk] = np.where(key > 0, np.minimum(off[by] + self.deep[later], 1 << 20), 1 << 20)
        return chunk

    def equal_windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(starts of all windows of `depth` bytes in order, a number for each: equal where these bytes are)."""
        at = self.every[self.left[self.every] >= self.depth]
        at = at[np.argsort(self.bucket[at], kind="stable")]
        a, b = at[:-1], at[1:]
        same = np.flatnonzero(self.gram[a] == self.gram[b])
        for j in [*range(Q, self.depth - Q, Q), max(0, self.depth - Q)]:
            same = same[self.gram[a[same] + j] == self.gram[b[same] + j]]
        new = np.ones(len(at), bool)
        new[same + 1] = False
        return at, np.cumsum(new) - 1


def place(new: np.ndarray) -> np.ndarray:
    """For each place the last one up to it that is new."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def occurrences(window: int):
    """The solver: how often each window of each context occurs."""

    def solve(contents, key, total, lowest):
        size = np.fromiter(map(len, contents), np.int64, len(contents))
        first = np.cumsum(size) - size
        at, which = Buckets(np.frombuffer(b"".join(contents), np.uint8), first, size, window).equal_windows()
        owner = np.searchsorted(first, at, "right") - 1
        count = np.zeros(int(size.sum()), np.int64)
        count[at] = np.bincount(which, total[owner]).astype(np.int64)[which]
        return [count[s : s + n - window + 1] for s, n in zip(first.tolist(), size.tolist())]

    return solve


def kept(text: bytes, starts: np.ndarray, ends: np.ndarray):
    """The bytes outside the spans, how many there are in all, how many go, and in how many spans."""
    out, at = [], 0
    for s, e in zip(starts.tolist(), ends.tolist()):
        out.append(text[at:s])
        at = e
    return b"".join([*out, text[at:]]) if out else text, len(text), int((ends - starts).sum()), len(starts)


def dedup_bytes(docs: DataFrame, *, window: int = 200, id_col: str = "doc_id", text_col: str = "text", hot: int = 10_000) -> DataFrame:
    """The input's rows and columns, with kept_bytes (binary: a cut can fall inside a character), n_bytes, n_removed and
    n_spans; columns of these names are replaced. Each byte goes that a string of `window` bytes covers which starts
    elsewhere too, in the same document or another; strings are judged on the input. A null text is empty. Rows without
    an id are kept whole and compared with none; rows that repeat an id are texts of their own. Texts of any length are
    read whole, in pieces of a few MB. An empty table gives an empty table. window: at least 8. hot: see repeats.py; it
    changes how windows are dealt to shards, not what is found.
    """
    finder = Finder(Bytes, window, min(32, window - window // 4), occurrences(window), lambda total, least: total, lambda value, least, n: value >= 2, lambda value, doc: value >= 2, False, hot)
    return cut_repeats(docs, finder, kept, "kept_bytes binary, n_bytes long, n_removed long, n_spans long", id_col=id_col, text_col=text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, encode(coalesce(text, '')) AS b FROM documents),
win AS (SELECT k, i, md5(b[i + 1 : i + 200]) AS w FROM (SELECT k, b, unnest(range(0, octet_length(b) - 199)) AS i FROM d WHERE octet_length(b) >= 200)),
again AS (SELECT w FROM win GROUP BY w HAVING count(*) > 1),
starts AS (SELECT k, i, coalesce(i > 200 + lag(i) OVER (PARTITION BY k ORDER BY i), true)::INT AS fresh FROM win SEMI JOIN again USING (w)),
spans AS (SELECT k, min(i) AS s, max(i) + 200 AS e FROM (SELECT k, i, sum(fresh) OVER (PARTITION BY k ORDER BY i) AS g FROM starts) GROUP BY k, g),
gaps AS (
  SELECT k, coalesce(lag(e) OVER (PARTITION BY k ORDER BY s), 0) AS a, s AS z FROM spans
  UNION ALL SELECT d.k, coalesce(max(e), 0), any_value(octet_length(b)) FROM d LEFT JOIN spans USING (k) GROUP BY d.k),
kept AS (SELECT k, string_agg(hex(b[a + 1 : z]), '' ORDER BY a) AS h FROM gaps JOIN d USING (k) GROUP BY k),
counts AS (SELECT k, sum(e - s) AS n, count(*) AS m FROM spans GROUP BY k)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(m, 0) AS n_spans, sha256(unhex(h)) AS kept_sha256
FROM d JOIN kept USING (k) LEFT JOIN counts USING (k)
"""
