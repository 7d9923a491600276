"""Periodic runs of words by the linear tandem-repeat method of Gusfield and Stoye.

Of each text only stretches are looked at in which every k words come twice, as they do everywhere in a run (k follows from
the least length and power of a run); so most texts need no more than a hash for each word. Stretches of a batch are put
one after another, with a word of its own after each, and solved together:

- Lempel-Ziv blocks, and for each block and period the leftmost square that ends beyond it or begins before it, by common
  extensions to both sides: a leftmost-covering set of squares (those of primitive roots are kept);
- from the place of each in the suffix tree, suffix links lead to the rotated square, which is in the vocabulary if the
  tree goes on with the square's first word, until that fails or was there before: the vocabulary is then complete;
- the leaves below a place are the occurrences of a square, and occurrences of one period at consecutive words are a run.

The suffix tree is that of a suffix array, nodes being its intervals. Spark deals the texts out; each is solved by itself,
in time and memory of n log n words of its repeated stretches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lakeloom.llm.common import free, table

KIND = "struct<n_words: bigint, runs: array<struct<start: bigint, length: bigint, period: bigint>>, kept_text: string>"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
ADDED = ["n_words", "runs", "kept_text"]
#: Words of the stretches that are solved together; a longer stretch is alone.
TOGETHER = 1 << 16
BLANKS = r"[\x20\x09-\x0D]+"


class Factors:
    """Ranks of all stretches of 1, 2, 4, ... words, up to a length at which all differ: the last are those of the suffixes."""

    def __init__(self, x: np.ndarray):
        self.n, self.names = len(x), []
        now, width = np.unique(x, return_inverse=True)[1], 1
        while True:
            self.names.append(np.append(now, -1).astype(np.int32))
            if now.max(initial=0) == self.n - 1:
                break
            after = np.zeros(self.n, np.int64)
            after[:-width] = now[width:] + 1
            now, width = np.unique(now.astype(np.int64) * (self.n + 1) + after, return_inverse=True)[1], 2 * width

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of what is equal from i and from j on (i and j differ)."""
        out = np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            out += (self.names[level][i + out] == self.names[level][j + out]).astype(np.int64) << level
        return out

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of what is equal up to i and up to j, both included; -1 is before the first word."""
        out = np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            a, b = i - out - (1 << level) + 1, j - out - (1 << level) + 1
            ok = (a >= 0) & (b >= 0)
            out += (ok & (self.names[level][np.where(ok, a, self.n)] == self.names[level][np.where(ok, b, 0)])).astype(np.int64) << level
        return out


class Tree:
    """The suffix tree: leaves are suffixes by rank, inner nodes the intervals of ranks that share a prefix."""

    def __init__(self, x: np.ndarray, f: Factors):
        n = len(x)
        self.rank = f.names[-1][:-1].astype(np.int64)
        self.sa = np.empty(n, np.int64)
        self.sa[self.rank] = np.arange(n)
        lcp = np.zeros(n + 1, np.int64)
        lcp[0] = lcp[n] = -1
        lcp[1:n] = f.forward(self.sa[:-1], self.sa[1:])
        self.least = [lcp.astype(np.int32)]  # the least of 1, 2, 4, ... from each on
        while 2 << (len(self.least) - 1) <= n + 1:
            half = 1 << (len(self.least) - 1)
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))
        inner = np.arange(1, n)
        lo, hi = self.interval(inner, lcp[1:n])
        self.keys, first = np.unique(lo * (n + 1) + lcp[1:n], return_index=True)  # inner nodes by first rank and depth
        self.lo = np.concatenate([np.arange(n), lo[first]])
        self.hi = np.concatenate([np.arange(n), hi[first]])
        self.depth = np.concatenate([n - self.sa, lcp[1:n][first]])
        up = np.maximum(lcp[self.lo], lcp[self.hi + 1])
        self.root = n + int(np.searchsorted(self.keys, 0)) if n > 1 else -1
        self.parent = np.full(len(self.lo), -1)
        below = up >= 0
        self.parent[below] = self.node(self.lo[below], up[below])

    def interval(self, rank: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last rank of the suffixes that share their first `length` words with the one of that rank."""
        lo, hi = rank.copy(), rank.copy()
        for level in range(len(self.least) - 1, -1, -1):
            t, step = self.least[level], 1 << level
            at = lo - step + 1
            lo -= np.where((at >= 1) & (t[np.clip(at, 0, len(t) - 1)] >= length), step, 0)
            at = hi + 1
            hi += np.where((at < len(t)) & (t[np.clip(at, 0, len(t) - 1)] >= length), step, 0)
        return lo, hi

    def node(self, rank: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The node at which, or above which, the first `length` words of the suffix of that rank end."""
        lo, hi = self.interval(rank, length)
        out, inner = lo.copy(), lo < hi
        a, b = lo[inner] + 1, hi[inner] + 1
        level = np.frexp(b - a)[1] - 1
        depth = np.empty(len(a), np.int64)
        for v in np.unique(level):
            at = level == v
            depth[at] = np.minimum(self.least[v][a[at]], self.least[v][b[at] - (1 << int(v))])
        out[inner] = len(self.sa) + np.searchsorted(self.keys, lo[inner] * (len(self.sa) + 1) + depth)
        return out


def blocks(f: Factors, tree: Tree) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks, with the end: each is the longest stretch that also starts earlier, or a new word."""
    n, stack = f.n, []
    before, after = [-1] * n, [-1] * n
    for p in tree.sa.tolist():  # the neighbours by rank that start earlier
        while stack and stack[-1] > p:
            after[stack.pop()] = p
        if stack:
            before[p] = stack[-1]
        stack.append(p)
    longest = np.zeros(n, np.int64)
    for other in (np.array(before), np.array(after)):
        at = np.flatnonzero(other >= 0)
        longest[at] = np.maximum(longest[at], f.forward(at, other[at]))
    longest, out, h = longest.tolist(), [], 0
    while h < n:
        out.append(h)
        h += max(1, longest[h])
    return np.array([*out, n])


def counted(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the row, 1 to its size) for each."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1


def covering(f: Factors, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length of the root) of squares, among them, for each that is in the text, one that its leftmost occurrence is
    reached from by moving right over squares of the same length."""
    n, size = f.n, np.diff(cut)
    row, k = counted(size)  # the first half begins in the block, the second ends beyond it
    end = cut[row + 1]
    row, k, end = row[end < n], k[end < n], end[end < n]
    q = end - k
    ahead, back = f.forward(end, q), f.backward(end - 1, q - 1)
    start = np.maximum(q - back, q - k + 1)
    ok = (ahead + back >= k) & (ahead > 0)
    starts, roots = [start[ok]], [k[ok]]
    row, k = counted(size + np.append(size[1:], 0))  # the first half begins before the block, the second in it
    h = cut[row]
    row, k, h = row[h + k < n], k[h + k < n], h[h + k < n]
    ahead, back = f.forward(h, h + k), f.backward(h - 1, h + k - 1)
    start = np.maximum(h - back, h - k + 1)
    ok = (ahead + back >= k) & (ahead > 0) & (back > 0) & (start + k <= cut[row + 1])
    return np.concatenate([*starts, start[ok]]), np.concatenate([*roots, k[ok]])


def primitive(f: Factors, start: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Roots that are no power of a shorter one: none of their length divided by a prime is a period."""
    most = int(k.max(initial=1))
    factor = np.arange(most + 1)
    for p in range(2, int(most**0.5) + 1):
        if factor[p] == p:
            multiples = factor[p * p :: p]
            multiples[multiples == np.arange(p * p, most + 1, p)] = p
    ok, rest = np.ones(len(k), bool), k.copy()
    while (at := np.flatnonzero(rest > 1)).size:
        p = factor[rest[at]]
        d = k[at] // p
        ok[at] &= f.forward(start[at], start[at] + d) < k[at] - d
        rest[at] //= p
    return ok


def vocabulary(x: np.ndarray, tree: Tree, start: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, length of the root) of all squares: those given and what suffix links lead to from them."""
    first = tree.node(tree.rank[start], 2 * k)
    todo = list(dict.fromkeys(zip(first.tolist(), k.tolist())))
    marked = set(todo)
    n, root = len(x), tree.root
    words, sa, lo, depth, parent = x.tolist(), tree.sa.tolist(), tree.lo.tolist(), tree.depth.tolist(), tree.parent.tolist()
    inner = np.arange(n, len(lo))
    shifted = tree.sa[tree.lo[inner]] + 1
    link = [-1] * n + np.where(tree.depth[inner] > 0, tree.node(tree.rank[np.minimum(shifted, n - 1)], np.maximum(tree.depth[inner] - 1, 0)), root).tolist()
    at = np.flatnonzero(tree.parent >= 0)
    child = dict(zip(zip(tree.parent[at].tolist(), x[tree.sa[tree.lo[at]] + tree.depth[tree.parent[at]]].tolist()), at.tolist()))
    for v, root_length in todo:
        length = 2 * root_length
        while True:
            i = sa[lo[v]]
            u = parent[v]
            w = root if u == root else link[u]
            while depth[w] < length - 1:  # down along words i+1 to i+length-1
                w = child[w, words[i + 1 + depth[w]]]
            if depth[w] == length - 1:
                w = child.get((w, words[i]), -1)
            elif words[sa[lo[w]] + length - 1] != words[i]:
                w = -1
            if w < 0 or (w, root_length) in marked:
                break
            marked.add((w, root_length))
            v = w
    nodes, roots = zip(*marked) if marked else ((), ())
    return np.array(nodes, np.int64), np.array(roots, np.int64)


def solve(x: np.ndarray, min_words: int, power: int) -> np.ndarray:
    """(runs, 3): start, length and smallest period of each run of at least `min_words` words and `power` periods."""
    none = np.zeros((0, 3), np.int64)
    if len(x) < 2:
        return none
    f = Factors(x)
    tree = Tree(x, f)
    start, k = covering(f, blocks(f, tree))
    some = primitive(f, start, k)
    node, k = vocabulary(x, tree, start[some], k[some])
    if not len(node):
        return none
    row, j = counted(tree.hi[node] - tree.lo[node] + 1)
    at = np.unique(k[row] * (len(x) + 1) + tree.sa[tree.lo[node][row] + j - 1])  # occurrences by period and start
    period, start = at // (len(x) + 1), at % (len(x) + 1)
    begins = np.flatnonzero(np.append(True, np.diff(at) != 1))
    ends = np.append(begins[1:], len(at)) - 1
    runs = np.stack([start[begins], start[ends] - start[begins] + 2 * period[begins], period[begins]], axis=1)
    return runs[runs[:, 1] >= np.maximum(min_words, power * runs[:, 2])]


def repeated_stretches(ids: np.ndarray, doc: np.ndarray, k: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of maximal stretches of words in which every k come again in their text."""
    n = len(ids) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = doc[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(k):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + n].astype(np.uint64) + np.uint64(1)
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    order = at[np.argsort(h[at])]
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(n + 1, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    begins = np.flatnonzero(twice[:-1] & ~np.append(False, twice[: n - 1] & (doc[1:n] == doc[: n - 1])))
    ends = np.flatnonzero(twice[:-1] & ~np.append(twice[1:n] & (doc[1:n] == doc[: n - 1]), False)) + k
    long = ends - begins >= min_words
    return begins[long], ends[long]


def runs_of(ids: np.ndarray, doc: np.ndarray, min_words: int, power: int):
    """(row, start, length, period) arrays of the runs of texts one after another; starts count in the whole."""
    k = min(max(min_words, power * q) - 2 * q + 1 for q in range(1, min_words + 1))
    begins, ends = repeated_stretches(ids, doc, k, min_words)
    out, a = [np.zeros((0, 3), np.int64)], 0
    while a < len(begins):
        b, total = a, 0
        while b < len(begins) and (b == a or total + ends[b] - begins[b] < TOGETHER):
            total += ends[b] - begins[b] + 1
            b += 1
        size = ends[a:b] - begins[a:b] + 1
        row, j = counted(size)
        place = begins[a:b][row] + j - 1
        own = j == size[row]  # a word of its own after each stretch
        x = np.where(own, ids.max() + 1 + row, ids[np.minimum(place, len(ids) - 1)])
        runs = solve(x, min_words, power)
        runs[:, 0] = place[runs[:, 0]]
        out.append(runs)
        a = b
    return np.concatenate(out)


def periodic_runs(docs: DataFrame, *, text_col: str = "text", min_words: int = 6, power: int = 4) -> DataFrame:
    """The input's rows and columns with n_words, runs and kept_text; columns of these names are replaced.

    Words are what stands between ASCII blanks. runs: (start, length, period) of every longest stretch of words with that
    smallest period, of at least `min_words` words and `power` (2 or more) periods, by start and period; starts are word
    numbers from 0. kept_text: the words without those that a run contains after its first period, joined by one blank. A
    null or empty text has no words and an empty kept_text; texts of any length are read whole; rows that repeat are each
    solved; an empty table gives an empty table.
    """
    if power < 2 or min_words < 2:
        raise ValueError("runs have two words and two periods at least")

    @arrow_udf(KIND)
    def solved(texts: pa.Array) -> pa.Array:
        words = [(t or b"").split() for t in texts.cast(pa.binary()).to_pylist()]
        sizes = np.array([len(w) for w in words], np.int64)
        begin = np.cumsum(sizes) - sizes
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for ws in words for w in ws), np.int64, int(sizes.sum()))
        doc = np.repeat(np.arange(len(words)), sizes)
        runs = runs_of(ids, doc, min_words, power)
        runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
        row = doc[runs[:, 0]] if len(runs) else np.zeros(0, np.int64)
        change = np.zeros(len(ids) + 1, np.int64)
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 0] + runs[:, 1], -1)
        stays = np.cumsum(change)[:-1] == 0
        kept = [b" ".join(w) for w in words]
        for r in np.unique(row).tolist():
            kept[r] = b" ".join(w for w, s in zip(words[r], stays[begin[r] : begin[r] + sizes[r]].tolist()) if s)
        runs = pa.StructArray.from_arrays([pa.array(runs[:, 0] - begin[row]), pa.array(runs[:, 1]), pa.array(runs[:, 2])], fields=list(RUN))
        ends = np.append(0, np.cumsum(np.bincount(row, minlength=len(words)))).astype(np.int32)
        return pa.StructArray.from_arrays([pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends), runs), pa.array(kept, pa.binary()).cast(pa.string())], ADDED)

    (out,) = free([*docs.columns, *ADDED], "out")
    docs = docs.withColumn(out, solved(F.col(text_col)))
    return docs.select(*[c for c in docs.columns if c not in (*ADDED, out)], *[F.col(out)[c].alias(c) for c in ADDED])


def with_repeats(docs: DataFrame) -> DataFrame:
    """Every tenth text (by the CRC of its id) ends in a repeated stretch of its own words; others stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        again = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.array_join(F.slice(F.concat(F.slice(w, F.lit(1), a), again), F.lit(1), n), " ")).otherwise("")

    words = F.array_remove(F.split("text", BLANKS), "")
    return docs.withColumn("text", F.when((h % 10 == 0) & F.col("text").isNotNull(), F.transform(F.array(words), repeated)[0]).otherwise(F.col("text")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs(with_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    docs = docs.withColumn("best", longest).withColumns({"start": -F.col("best.start"), "length": F.col("best.length"), "period": -F.col("best.period")})
    return docs.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "start", "length", "period", F.expr("1000 * length div period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("collapsed_sha256"),
    )
