"""Benchmark decontamination by a generalised suffix automaton over the words of the test items.

The automaton is built from the benchmark and broadcast; documents stream through it in Arrow batches without any shuffle.
For each word the length of the longest match that ends there is tracked; a match as long as a window marks its words, and
the items come from a table of the windows' states. A benchmark of more than `shard_mb` is dealt to shards, each with an
automaton and a pass of its own; what the passes have found of a text is put together by the text's hash.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lakeloom.llm.common import few, free, saved, table

#: Words are runs of 0-9, a-z and all beyond ASCII; A-Z are lower-cased first.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Automaton:
    """Generalised suffix automaton of word sequences, in flat arrays: a state's first transition is (word, to), further
    ones are in a dict that only branching states have.

    window_state, window_item: the state of each window of `size` words and the number of its item, in order of states.
    shorts[s]: (length, item number) of whole items under `size` words that end at s; nearest[s]: s or the first state on
    its way of suffix links that has such.
    """

    def __init__(self, items: list[list[bytes]], size: int):
        self.vocab: dict[bytes, int] = {}
        self.size = size
        self.word, self.to, self.more = array("i", [-1]), array("i", [-1]), {}
        self.link, self.len = array("i", [-1]), array("i", [0])
        coded = [array("i", [self.vocab.setdefault(w, len(self.vocab)) for w in item]) for item in items]
        for item in coded:
            last = 0
            for w in item:
                last = self._extend(last, w)
        states, owners, self.shorts = array("i"), array("i"), {}
        for k, item in enumerate(coded):
            if 0 < len(item) < size:
                state = 0
                for w in item:
                    state = self._step(state, w)
                self.shorts.setdefault(state, []).append((len(item), k))
            else:
                for state, n in self._walk(item):
                    if n >= size:
                        states.append(self._at(state))
                        owners.append(k)
        pairs = np.unique(np.frombuffer(states, np.int32).astype(np.int64) << 32 | np.frombuffer(owners, np.int32).astype(np.int64)) if len(states) else np.zeros(0, np.int64)
        self.window_state, self.window_item = (pairs >> 32).astype(np.int32), pairs.astype(np.int32)
        self.nearest = array("i")
        if self.shorts:
            near = np.zeros(len(self.len), np.int32)
            for s in np.argsort(np.frombuffer(self.len, np.int32), kind="stable").tolist():
                near[s] = s if s in self.shorts else near[self.link[s]] if s else 0
            self.nearest = array("i", near.tobytes())
        self.least = min([size, *(len(x) for x in coded if len(x))])

    def _step(self, state: int, w: int) -> int | None:
        if self.word[state] == w:
            return self.to[state]
        rest = self.more.get(state)
        return None if rest is None else rest.get(w)

    def _put(self, state: int, w: int, to: int) -> None:
        if self.word[state] in (w, -1):
            self.word[state], self.to[state] = w, to
        else:
            self.more.setdefault(state, {})[w] = to

    def _new(self, length: int, link: int, like: int | None) -> int:
        s = len(self.len)
        self.len.append(length)
        self.link.append(link)
        self.word.append(-1 if like is None else self.word[like])
        self.to.append(-1 if like is None else self.to[like])
        if like in self.more:
            self.more[s] = dict(self.more[like])
        return s

    def _split(self, p: int, w: int) -> int:
        """The state of p's longest sequence and w, split off from a longer one where needed."""
        q = self._step(p, w)
        if self.len[q] == self.len[p] + 1:
            return q
        c = self._new(self.len[p] + 1, self.link[q], q)
        self.link[q] = c
        while p >= 0 and self._step(p, w) == q:
            self._put(p, w, c)
            p = self.link[p]
        return c

    def _extend(self, last: int, w: int) -> int:
        if self._step(last, w) is not None:
            return self._split(last, w)
        s = self._new(self.len[last] + 1, 0, None)
        p = last
        while p >= 0 and self._step(p, w) is None:
            self._put(p, w, s)
            p = self.link[p]
        if p >= 0:
            self.link[s] = self._split(p, w)
        return s

    def _at(self, state: int) -> int:
        """The state that holds the last `size` words."""
        while self.len[self.link[state]] >= self.size:
            state = self.link[state]
        return state

    def _walk(self, words):
        word, to, more, link, length = self.word, self.to, self.more, self.link, self.len
        state = n = 0
        for w in words:
            while True:
                if word[state] == w:
                    state, n = to[state], n + 1
                    break
                rest = more.get(state)
                if rest is not None and w in rest:
                    state, n = rest[w], n + 1
                    break
                if not state:
                    n = 0
                    break
                state = link[state]
                n = length[state]
            yield state, n

    def match(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words a window covers, and the items found. Only runs of known words that could hold a window are walked."""
        hit, found, states = np.zeros(len(words), bool), set(), set()
        if len(words) < self.least:
            return hit, found
        ids = np.fromiter(map(self.vocab.get, words, [-1] * len(words)), np.int64, len(words))
        edge = np.diff(np.concatenate(([False], ids >= 0, [False])).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = ends - starts >= self.least
        for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            for i, (state, n) in enumerate(self._walk(ids[a:b].tolist()), a + 1):
                if n >= self.size:
                    hit[i - self.size : i] = True
                    states.add(self._at(state))
                if self.nearest and n:
                    s = self.nearest[state]
                    while s > 0:
                        for m, k in self.shorts[s]:
                            if m <= n:
                                hit[i - m : i] = True
                                found.add(k)
                        s = self.nearest[self.link[s]]
        if states:
            s = np.array(sorted(states), np.int32)
            for a, b in zip(np.searchsorted(self.window_state, s, "left").tolist(), np.searchsorted(self.window_state, s, "right").tolist()):
                found.update(self.window_item[a:b].tolist())
        return hit, found


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def cut(text: bytes, hit: np.ndarray) -> bytes:
    """The text without the runs of hit words; what lies between two words of a run goes with it."""
    b = np.frombuffer(text.translate(FOLD), np.uint8) != 32
    edge = np.diff(np.concatenate(([False], b, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    run = np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))
    out, at = [], 0
    for a, z in zip(np.flatnonzero(run == 1).tolist(), np.flatnonzero(run == -1).tolist(), strict=True):
        out.append(text[at : starts[a]])
        at = int(ends[z - 1])
    return b"".join([*out, text[at:]])


def pieces(benchmark: DataFrame, size: int, id_col: str, text_col: str, most_bytes: int) -> DataFrame:
    """(i, t): items as words joined by blanks; those of more than most_bytes in parts that overlap by size - 1 words, so
    that the parts have the item's windows. Items without words are left out."""

    def run(batches):
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = words_of(t.encode())
                at = 0
                while at < len(words):
                    end, held = at, 0
                    while end < len(words) and (held < most_bytes or end - at < size):
                        held += len(words[end]) + 1
                        end += 1
                    out.append((i, b" ".join(words[at:end]).decode("utf-8", "surrogatepass")))
                    at = end - size + 1 if end < len(words) else end
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())], ["i", "t"])

    rows = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, "i string, t string").distinct()


def automaton(items: DataFrame, size: int) -> tuple[Automaton, list[str | None]]:
    """The automaton of the rows of pieces(), and the id of each."""
    got = sorted(((r["i"], r["t"]) for r in items.collect()), key=lambda x: (x[0] is not None, x))
    return Automaton([t.encode("utf-8", "surrogatepass").split() for _, t in got], size), [i for i, _ in got]


def shared_model(spark: SparkSession, items: DataFrame, size: int):
    model, ids = automaton(items, size)
    return spark.sparkContext.broadcast((vars(model), ids))


def loaded(shared) -> tuple[Automaton, list[str | None]]:
    state, ids = shared.value
    model = Automaton.__new__(Automaton)
    model.__dict__ = state
    return model, ids


def result(text: str | None, raw: bytes, n_words: int, hit: np.ndarray, items: set) -> tuple:
    n = int(hit.sum())
    return n_words, n, len(items), sorted(i for i in items if i is not None), cut(raw, hit).decode("utf-8", "surrogatepass") if n else text


FOUND = "n_words long, n_hit long, n_items long, items array<string>, clean string"
NAMES = ["n_words", "n_hit", "n_items", "items", "clean"]


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, size: int = 10, text_col: str = "text", item_id_col: str = "item_id", item_col: str = "text", shard_mb: float = 8) -> DataFrame:
    """The input's rows and columns, with n_words, n_hit, n_items, items (ids as text, sorted) and clean_text, which is
    the text without the hit runs; columns of these names are replaced.

    A null text has no words and stays null. Texts are scanned whole, however long; rows that repeat are each judged,
    alike. Items without words take no part; rows that repeat an item id are one item. Items without an id are one item
    too: their windows hit and they count as one in n_items, but have no place in items. An empty table gives an empty
    table; with an empty benchmark nothing is hit. shard_mb: the most text of one automaton, which takes about ten times
    that memory; a larger benchmark takes a pass for each shard.
    """
    spark = docs.sparkSession
    parts = saved(pieces(benchmark, size, item_id_col, item_col, int(shard_mb * 125_000)))
    mb = (parts.agg(F.sum(F.octet_length("t"))).first()[0] or 0) / 1e6
    (m,) = free(docs.columns, "m")
    if mb <= shard_mb:
        shared = shared_model(spark, parts, size)

        @pandas_udf(FOUND)
        def scan(texts: pd.Series) -> pd.DataFrame:
            model, ids = loaded(shared)
            out = []
            for t in texts:
                raw = (t or "").encode("utf-8", "surrogatepass")
                words = words_of(raw)
                hit, found = model.match(words)
                out.append(result(t, raw, len(words), hit, {ids[k] for k in found}))
            return pd.DataFrame(out, columns=NAMES)

        # Said to be nondeterministic, so that a filter on its result doesn't make it run twice.
        out = docs.withColumn(m, scan.asNondeterministic()(F.col(text_col)))
    else:
        h1, h2, ours = free([*docs.columns, m], "h1", "h2", "hits")
        hashes = [F.xxhash64(text_col), F.xxhash64(F.lit(1), F.col(text_col))]
        n = -(-int(2 * mb * 1000) // max(1, int(shard_mb * 1000)))
        every = None
        for k in range(n):
            part = hits_of(docs.where(F.col(text_col).isNotNull()).select(*(h.alias(x) for h, x in zip(hashes, ("h1", "h2"))), F.col(text_col).alias("t")), shared_model(spark, parts.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k), size))
            part = saved(part.dropDuplicates(["h1", "h2"]))
            every = part if every is None else every.unionByName(part)
        every = saved(every.groupBy("h1", "h2").agg(F.collect_list(F.struct("runs", "items")).alias(ours)))  # a row for each shard at most

        @pandas_udf(FOUND)
        def together(texts: pd.Series, hits: pd.Series) -> pd.DataFrame:
            out = []
            for t, got in zip(texts, hits):
                raw = (t or "").encode("utf-8", "surrogatepass")
                words = words_of(raw)
                hit, items = np.zeros(len(words), bool), set()
                for x in got if got is not None else ():
                    for a, b in np.frombuffer(x["runs"], np.int64).reshape(-1, 2).tolist():
                        hit[a:b] = True
                    items.update(x["items"])
                out.append(result(t, raw, len(words), hit, items))
            return pd.DataFrame(out, columns=NAMES)

        found = few(every.select(F.col("h1").alias(h1), F.col("h2").alias(h2), ours))
        out = docs.withColumns(dict(zip((h1, h2), hashes))).join(found, [h1, h2], "left").withColumn(m, together.asNondeterministic()(F.col(text_col), F.col(ours))).drop(h1, h2, ours)
    got = F.col(m)
    return out.withColumns({"n_words": got["n_words"], "n_hit": got["n_hit"], "n_items": got["n_items"], "items": got["items"], "clean_text": got["clean"]}).drop(m)


def hits_of(texts: DataFrame, shared) -> DataFrame:
    """Of texts (h1, h2, t) that a shard's automaton hits: the runs of hit words (pairs of longs) and the items."""

    def run(batches):
        model, ids = loaded(shared)
        for b in batches:
            out = []
            for h1, h2, t in zip(*(b.column(k).to_pylist() for k in range(3))):
                hit, found = model.match(words_of(t.encode("utf-8", "surrogatepass")))
                if found:
                    edge = np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))
                    runs = np.stack((np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)), axis=1)
                    out.append((h1, h2, runs.astype(np.int64).tobytes(), sorted({ids[k] for k in found}, key=lambda i: (i is not None, i))))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], kind) for c, kind in enumerate(kinds)], ["h1", "h2", "runs", "items"])

    return texts.mapInArrow(run, "h1 long, h2 long, runs binary, items array<string>")


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, w, least(10, len(w)) AS m FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark) WHERE len(w) > 0),
bw AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS s
  FROM (SELECT item_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM b)),
sizes AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS s
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)),
found AS (SELECT doc_id, item_id, dw.m, i FROM dw JOIN bw ON dw.s = bw.s AND dw.m = bw.m),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
