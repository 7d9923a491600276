"""Substring dedup by suffix automata of reference shards.

repeats.py brings together, in shards, the parts of the corpus that can hold a repeat, each distinct one once. The passages
of an anchor stream through their generalised suffix automaton in order of the documents: matching statistics, with suffix links
where a match breaks off, tell for each window whether an earlier document has it, and which. What no earlier document has
joins the automaton; states know the first document they came from. The automata stay in the tasks that hold their shard:
sending each to all documents would take time in the square of the corpus (README has figures).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import table
from lakeloom.llm.repeats import Finder, Words, cut_repeats

NOBODY = 1 << 62


class Automaton:
    """Generalised suffix automaton of word sequences that are added one after the other, documents in order."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len, self.owner = [-1], [0], [NOBODY]

    def add(self, words: list[int], owner: int) -> None:
        nxt, link, length, own = self.next, self.link, self.len, self.owner
        last = 0
        for w in words:
            to = nxt[last].get(w)
            if to is not None and length[to] == length[last] + 1:
                last = to
                continue
            if to is None:
                new = len(nxt)
                nxt.append({})
                link.append(0)
                length.append(length[last] + 1)
                own.append(owner)
                p = last
                while p >= 0 and w not in nxt[p]:
                    nxt[p][w] = new
                    p = link[p]
            else:
                new, p = -1, last
            if p >= 0:
                q = nxt[p][w]
                if length[q] == length[p] + 1:
                    split = q
                else:
                    split = len(nxt)
                    nxt.append(dict(nxt[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    own.append(own[q])  # whoever had the longer sequence first had the shorter
                    link[q] = split
                    while p >= 0 and nxt[p].get(w) == q:
                        nxt[p][w] = split
                        p = link[p]
                if new >= 0:
                    link[new] = split
                else:
                    new = split
            last = new

    def owners(self, words: list[int], window: int) -> list[int]:
        """For each window the first document that has it, NOBODY if none has: by the length of the longest match that ends
        at its last word, and the state that holds the window."""
        nxt, link, length, own = self.next, self.link, self.len, self.owner
        state = n = 0
        out = []
        for w in words:
            to = nxt[state].get(w)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = nxt[state].get(w)
            if to is None:
                n = 0
            else:
                state, n = to, n + 1
                while length[link[state]] >= window:
                    state = link[state]
                    n = length[state]
            out.append(own[state] if n >= window else NOBODY)
        return out[window - 1 :]


def smallest_owner(window: int):
    """The solver: the smallest document that has each window of each context.

    A window's match holds its anchor, so the passages of an anchor have an automaton of their own, which the first of them
    finds empty and the last need not join."""

    def solve(contents, key, total, lowest):
        out = []
        new = np.concatenate((key[1:] != key[:-1], [True])).tolist()
        shard, vocab = None, {}
        for c, owner, last in zip(contents, lowest.tolist(), new):
            words = c.split()
            n = len(words) - window + 1
            if shard is None:
                got = np.full(n, owner, np.int64)
                fresh = [(0, n - 1)]
                if not last:
                    shard, vocab = Automaton(), {}
            else:
                words = [vocab.setdefault(w, len(vocab)) for w in words]
                got = np.array(shard.owners(words, window), np.int64)
                at = np.flatnonzero(got == NOBODY)
                got[at] = owner
                edge = np.flatnonzero(np.diff(at) > 1)
                fresh = list(zip(at[np.concatenate(([0], edge + 1))].tolist(), at[np.concatenate((edge, [len(at) - 1]))].tolist())) if len(at) else []
            if last:
                shard = None
            elif fresh:
                coded = [vocab.setdefault(w, len(vocab)) for w in words] if isinstance(words[0], bytes) else words
                for s, e in fresh:
                    shard.add(coded[s : e + window], owner)
            out.append(got)
        return out

    return solve


def kept(text: bytes, starts: np.ndarray, ends: np.ndarray):
    """The words outside the spans, joined by one space; how many there are in all; how many go."""
    n, out, spans = 0, [], list(zip(starts.tolist(), ends.tolist()))
    for base, piece in Words.pieces(text, 1):
        words = piece.split()
        n = base + len(words)
        at, stay = base, []
        while spans and spans[0][0] < n:
            s, e = spans[0]
            stay += words[at - base : max(at, s) - base]
            at = max(at, min(e, n))
            if e > n:
                break
            spans.pop(0)
        stay += words[at - base :]
        if stay:
            out.append(b" ".join(stay))
    return b" ".join(out).decode("utf-8", "surrogatepass"), n, int((ends - starts).sum())


def dedup_windows(docs: DataFrame, *, window: int = 13, id_col: str = "doc_id", text_col: str = "text", hot: int = 10_000) -> DataFrame:
    """The input's rows and columns, with kept_text (words joined by one space), n_words and n_removed; columns of these
    names are replaced. Each word goes that a window of `window` words covers which also starts in a document with a
    smaller id; windows are judged on the input. A null text has no words. Rows without an id are kept whole and compared
    with none; rows that repeat an id are parts of one document, which is not smaller than itself. Texts of any length are
    read whole, in pieces of a few MB. An empty table gives an empty table. hot: see repeats.py; it changes how windows are
    dealt to shards, not what is found.
    """
    finder = Finder(Words, window, max(1, window * 5 // 13), smallest_owner(window), lambda total, least: least, lambda value, least, n: (value < least) | (n > 1), lambda value, doc: value < doc, True, hot)
    return cut_repeats(docs, finder, kept, "kept_text string, n_words long, n_removed long", id_col=id_col, text_col=text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_windows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
first AS (SELECT s, min(doc_id) AS first_id FROM win GROUP BY s),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN first USING (s) WHERE first_id < doc_id),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
left_over AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY words.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (doc_id)
"""
