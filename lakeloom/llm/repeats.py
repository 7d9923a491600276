"""What substring and suffix-array dedup share: finding, over a whole corpus, the windows of W units that occur again.

Texts are dealt to groups of about GROUP_MB by a hash of the id and shuffled once. From there on only packed arrays move:

1. Each group picks anchors: in any W consecutive units the k-gram with the least hash, the leftmost of equals, so that
   equal windows have equal anchors at the same place. A group sends each anchor's hash once, with a count.
2. Shards, to which hashes are dealt, find those that are there twice and tell the groups.
3. Each group sends for such an anchor its contexts, the units of the windows that have this anchor: each distinct one
   once, with the places where it occurs.
4. A solver works on a shard's contexts: for each window it finds over all groups what the operator asks for (the smallest
   document, or the number of occurrences). All equal windows meet in one shard, as they share the anchor. Hashes only say
   what may be equal; the solver reads the units themselves.
5. Groups cut their documents.

An anchor that occurs more than `hot` times would crowd a shard. Its windows take the same way one by one: step 3 sends a
hash of each, step 4 finds those that are there twice, and only these are sent as contexts of one window, each to the shard
that its hash names, and solved there like any other.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lakeloom.llm.common import free

GROUP_MB, SHARD_MB = 6, 12
POS = np.uint64(0xFFFFFF)
#: Bytes of texts that are looked at together, and the most of one text.
STEP = 1 << 21
BLOCK = 1 << 18
BLANK = re.compile(rb"[ \t-\r]")
MUL = np.uint64(0x9E3779B97F4A7C15)
#: One kind of row for all that moves. SPANS: of text number `text`, units from `lo` to `which` have value `least`.
ANCHORS, AGAIN, CONTEXTS, WINDOWS, SPANS = range(5)
PARTS = {"key": np.uint64, "size": np.uint32, "least": np.int64, "which": np.uint32, "text": np.uint32, "lo": np.uint32}
ROW = "shard int, grp long, kind int, " + ", ".join(f"{c} binary" for c in PARTS) + ", content binary"


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def least_of(key: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive ones."""
    m, have = key, 1
    while have * 2 <= w:
        m, have = np.minimum(m[:-have], m[have:]), have * 2
    return m if have == w else np.minimum(m[: len(m) - (w - have)], m[w - have :])


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[i], starts[i] + 1, ... (sizes[i] of them), one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - starts, sizes)


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans in order, those that overlap or touch as one."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order]) if len(end) else end
    new = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1]))) if len(start) else np.zeros(0, np.int64)
    return start[new], end[np.concatenate((new[1:], [len(end)])) - 1] if len(new) else end[:0]


@dataclass
class Units:
    """The units of some texts: their k-gram hashes, and by text where they begin and end. starts, ends: bytes of a unit
    in data, or None if units are bytes."""

    grams: np.ndarray
    first: np.ndarray
    last: np.ndarray
    data: bytes
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None


class Bytes:
    def __init__(self, k: int):
        self.k = k

    def pieces(self, text: bytes, window: int):
        """(unit at which it begins, piece): each window of the text lies in one piece."""
        for at in range(0, max(0, len(text) - window + 1), STEP):
            yield at, text[at : at + STEP + window - 1]

    def units(self, texts: list[bytes]) -> Units:
        data = b"".join(texts)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        last = np.cumsum(size)
        n, h = len(data), np.empty(len(data), np.uint64)
        raw = np.frombuffer(data + bytes(self.k + 8), np.uint8)
        for at in range(0, n, BLOCK):
            m = min(BLOCK, n - at)
            w = raw[at : at + m + self.k + 7].astype(np.uint64)
            for s in (1, 2, 4):
                w = w[:-s] | (w[s:] << np.uint64(8 * s))
            g = np.zeros(m, np.uint64)
            for j in range(0, self.k, 8):
                g = (g ^ (w[j : j + m] & np.uint64(256 ** min(8, self.k - j) - 1))) * MUL
                g ^= g >> np.uint64(29)
            h[at : at + m] = mixed(g)
        return Units(h, last - size, last, data)

    @staticmethod
    def content(u: Units, a: int, b: int) -> bytes:
        return u.data[a:b]

    length = staticmethod(len)

    @staticmethod
    def windows(piece: bytes, at: list[int], window: int) -> list[bytes]:
        return [piece[a : a + window] for a in at]


class Words:
    """Runs of anything but ASCII blanks."""

    def __init__(self, k: int):
        self.k = k
        self.blank = np.zeros(256, bool)
        self.blank[[9, 10, 11, 12, 13, 32]] = True
        self.table = mixed(np.arange(1, 257, dtype=np.uint64) * MUL)
        self.step = 1 << 20
        odd, back = MUL, np.uint64(pow(int(MUL), -1, 1 << 64))
        self.up = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(self.step, odd))))
        self.down = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(self.step, back))))

    @staticmethod
    def pieces(text: bytes, window: int):
        """(word at which it begins, piece): each window of the text lies in one piece. Pieces end where a word does."""
        at, words, tail = 0, 0, []
        while True:
            blank = BLANK.search(text, at + STEP)
            end = blank.start() if blank else len(text)
            piece = b" ".join([*tail, text[at:end]]) if tail else text[at:end]
            yield words - len(tail), piece
            if end == len(text):
                return
            every = piece.split()
            words += len(every) - len(tail)
            tail, at = every[max(0, len(every) + 1 - window) :] if window > 1 else [], end

    def hashes(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of the words that lie in b, `step` bytes at a time; a word that is cut is the sum of its parts."""
        out, base = np.zeros(len(starts), np.uint64), 0
        while base < len(b):
            part = b[base : base + self.step]
            sums = np.concatenate(([np.uint64(0)], np.cumsum(self.table[part] * self.up[: len(part)])))
            i, j = np.searchsorted(ends, base, "right"), np.searchsorted(starts, base + len(part), "left")
            s, e = np.maximum(starts[i:j] - base, 0), np.minimum(ends[i:j] - base, len(part))
            cut = (sums[e] - sums[s]) * self.down[s]
            for x in np.flatnonzero(starts[i:j] < base):  # at most one, which goes on from the part before
                cut[x : x + 1] *= np.uint64(pow(int(MUL), int(base - starts[i + x]), 1 << 64))
            out[i:j] += cut
            base += len(part)
        return mixed(out + (ends - starts).astype(np.uint64))

    def units(self, texts: list[bytes]) -> Units:
        data = b" ".join(texts)
        b = np.frombuffer(data, np.uint8)
        word = np.concatenate(([False], ~self.blank[b], [False]))
        edge = np.flatnonzero(word[1:] != word[:-1])
        starts, ends = edge[::2], edge[1::2]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        at = np.cumsum(size + 1) - (size + 1)
        first, last = np.searchsorted(starts, at), np.searchsorted(starts, at + size)
        h = self.hashes(b, starts, ends)
        n = len(h)
        h = np.concatenate((h, np.zeros(self.k, np.uint64)))
        g = np.zeros(n, np.uint64)
        for j in range(self.k):
            g = (g ^ h[j : j + n]) * MUL
            g ^= g >> np.uint64(29)
        return Units(mixed(g), first, last, data, starts, ends)

    @staticmethod
    def content(u: Units, a: int, b: int) -> bytes:
        return b" ".join(u.data[u.starts[a] : u.ends[b - 1]].split())

    @staticmethod
    def length(content: bytes) -> int:
        return content.count(b" ") + 1

    @staticmethod
    def windows(piece: bytes, at: list[int], window: int) -> list[bytes]:
        words = piece.split()
        return [b" ".join(words[a : a + window]) for a in at]


def anchors(u: Units, window: int, k: int):
    """(text number, place of the anchor, first and last window start) of each anchor of windows within one text."""
    size = u.last - u.first
    own = np.flatnonzero(size >= window)
    if not len(own):
        return (np.zeros(0, np.int64),) * 4
    n = size[own] - window + 1
    starts = spread(u.first[own], n)
    key = (u.grams & ~POS) | np.arange(len(u.grams), dtype=np.uint64)
    p = (least_of(key, window - k + 1)[starts] & POS).astype(np.int64)
    text = np.repeat(own, n)
    new = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (text[1:] != text[:-1]))))
    return text[new], p[new], starts[new], starts[np.concatenate((new[1:], [len(p)])) - 1]


def packed(shard: np.ndarray):
    """(order, shards, slices of the order) that put what goes to one shard together."""
    order = np.argsort(shard, kind="stable")
    s = shard[order]
    new = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
    return order, s[new], list(zip(new.tolist(), np.concatenate((new[1:], [len(s)])).tolist()))


def column(t: pa.Table, name: str) -> np.ndarray:
    """All rows' arrays of one column, one after the other."""
    return np.frombuffer(b"".join(x for x in t[name].to_pylist() if x), PARTS[name])


def counts(t: pa.Table, name: str) -> np.ndarray:
    """How many each row has in a column."""
    return np.array([len(x or b"") // np.dtype(PARTS[name]).itemsize for x in t[name].to_pylist()], np.int64)


class Rows:
    """Rows to be sent."""

    def __init__(self):
        self.rows: list[dict] = []

    def add(self, shard: int, grp: int, kind: int, content: bytes | None = None, **arrays: np.ndarray) -> None:
        self.rows.append({"shard": int(shard), "grp": int(grp), "kind": kind, "content": content} | {c: np.ascontiguousarray(a, PARTS[c]).tobytes() for c, a in arrays.items()})

    def table(self) -> pa.Table:
        kinds = {"shard": pa.int32(), "grp": pa.int64(), "kind": pa.int32(), **dict.fromkeys(PARTS, pa.binary()), "content": pa.binary()}
        return pa.table({c: pa.array([r.get(c) for r in self.rows], kind) for c, kind in kinds.items()})


def of_kind(t: pa.Table, *kinds: int) -> pa.Table:
    return t.filter(pa.array(np.isin(t["kind"].to_numpy(), kinds)))


class Contexts:
    """A group's distinct contexts, and where they occur."""

    def __init__(self):
        self.seen: dict[bytes, int] = {}
        self.key, self.which, self.text, self.lo = [], [], [], []

    def add(self, contents: list[bytes], keys, text: np.ndarray, lo: np.ndarray) -> None:
        seen, had, which = self.seen, len(self.seen), []
        for c in contents:
            which.append(seen.setdefault(c, len(seen)))
        which = np.array(which, np.int64)
        new, at = np.unique(which, return_index=True)
        keep = new >= had
        self.key.append(np.asarray(keys, np.uint64)[at[keep]])
        self.which.append(which)
        self.text.append(text)
        self.lo.append(lo)

    def send(self, rows: Rows, grp: int, shards: int, number: np.ndarray) -> None:
        """A row for each shard, to which anchors are dealt. number: the documents' ids by text number."""
        if not self.seen:
            return
        key, which, text, lo = (np.concatenate(x) for x in (self.key, self.which, self.text, self.lo))
        contents = list(self.seen)
        size = np.fromiter(map(len, contents), np.uint32, len(contents))
        least = np.full(len(contents), np.iinfo(np.int64).max)
        np.minimum.at(least, which, number[text])
        order, at, cuts = packed((key % np.uint64(shards)).astype(np.int64))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        by = np.argsort(place[which], kind="stable")
        which, text, lo = place[which][by], text[by], lo[by]
        press = zstandard.ZstdCompressor(level=3)
        for shard, (s, e) in zip(at, cuts):
            a, b = np.searchsorted(which, (s, e))
            o = order[s:e]
            rows.add(shard, grp, CONTEXTS, press.compress(b"".join([contents[x] for x in o.tolist()])), key=key[o], size=size[o], least=least[o], which=which[a:b] - s, text=text[a:b], lo=lo[a:b])


class Finder:
    """solve(contents, key, total, least) gives for each context an array with a value per window (key: the anchor; in order of
    anchors and then of `least`); alone(total, least) the value of all windows of a context that is alone under its anchor; tells(value, least, n) says which of them the groups need to know (least and n: of the group's own places of
    that context); keep(values, ids) tells which windows go. distinct_docs: anchors count by document."""

    def __init__(self, kind, window: int, k: int, solve, alone, tells, keep, distinct_docs: bool, hot: int):
        self.kind, self.window, self.k, self.solve, self.alone, self.tells, self.keep = kind, window, k, solve, alone, tells, keep
        self.distinct_docs, self.hot = distinct_docs, hot

    # Steps on a group's texts

    @staticmethod
    def read(t: pa.Table, id_col: str, text_col: str):
        """(rows' order, ids, texts that are compared, texts). Texts are numbered in an order of their own, as a group's rows
        come in another one each time; what has no id is not compared and reads as empty."""
        ids, texts = t[id_col].to_pylist(), [x or b"" for x in t[text_col].cast(pa.binary()).to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        ids, texts = [ids[i] for i in order], [texts[i] for i in order]
        return order, np.array([0 if i is None else i for i in ids], np.int64), [b"" if i is None else x for i, x in zip(ids, texts)], texts

    def anchored(self, texts: list[bytes]):
        """For pieces of texts, STEP bytes together: (units, hashes, text, shift, lo, hi): anchors' hashes, their texts, and
        their windows' first and last starts in the units; `shift` is to be added for the place in the text."""
        kind, held, pieces = self.kind(self.k), 0, []

        def found():
            u = kind.units([p for _, _, p in pieces])
            at, p, lo, hi = anchors(u, self.window, self.k)
            text, shift = np.array([x for x, _, _ in pieces], np.int64), np.array([x for _, x, _ in pieces], np.int64)
            return kind, u, u.grams[p], text[at], shift[at] - u.first[at], lo, hi

        for i, x in enumerate(texts):
            for at, piece in kind.pieces(x, self.window) if x else ():
                pieces.append((i, at, piece))
                held += len(piece)
                if held >= STEP:
                    yield found()
                    held, pieces = 0, []
        if pieces:
            yield found()

    def tally(self, key: np.ndarray, text: np.ndarray, number: np.ndarray):
        """Distinct keys and how often they occur, or in how many documents."""
        if self.distinct_docs and len(key):
            doc = np.unique(number, return_inverse=True)[1][text]
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            key = key[np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))]
        return np.unique(key, return_counts=True)

    def send_anchors(self, t: pa.Table, id_col: str, text_col: str, shards: int, grp: int) -> pa.Table:
        _, number, texts, _ = self.read(t, id_col, text_col)
        got = [(a, text) for _, _, a, text, *_ in self.anchored(texts)]
        rows = Rows()
        if got:
            a, n = self.tally(np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got]), number)
            order, shard, cuts = packed((a % np.uint64(shards)).astype(np.int64))
            for k, (s, e) in zip(shard, cuts):
                rows.add(k, grp, ANCHORS, key=a[order[s:e]], size=n[order[s:e]])
        return rows.table()

    def find_again(self, t: pa.Table) -> pa.Table:
        """What is there twice, told to the groups; `size` is 1 for what is hot."""
        key, n = column(t, "key"), column(t, "size").astype(np.int64)
        every, which = np.unique(key, return_inverse=True)
        total = np.bincount(which, n, minlength=len(every))
        again, hot = (total >= 2)[which], (total > self.hot)[which]
        rows, end = Rows(), np.cumsum(counts(t, "key"))
        for grp, s, e in zip(t["grp"].to_pylist(), np.concatenate(([0], end[:-1])).tolist(), end.tolist()):
            use = again[s:e]
            if use.any():
                rows.add(-1, grp, AGAIN, key=key[s:e][use], size=hot[s:e][use])
        return rows.table()

    def send_contexts(self, t: pa.Table, mail: pa.Table, id_col: str, text_col: str, shards: int, grp: int) -> pa.Table:
        _, number, texts, _ = self.read(t, id_col, text_col)
        again, hot = column(mail, "key"), column(mail, "size").astype(bool)
        again, hot = np.sort(again[~hot]), np.sort(again[hot])
        rows, held, alone, w = Rows(), Contexts(), [], self.window
        for kind, u, a, text, shift, lo, hi in self.anchored(texts) if mail.num_rows else ():
            use = np.flatnonzero(among(a, again))
            held.add([kind.content(u, s, e) for s, e in zip(lo[use].tolist(), (hi[use] + w).tolist())], a[use], text[use], (lo + shift)[use])
            use = np.flatnonzero(among(a, hot))
            if len(use):
                n = hi[use] - lo[use] + 1
                at, own = spread(lo[use], n), np.repeat(use, n)
                key = np.fromiter((xxhash.xxh3_64_intdigest(kind.content(u, s, s + w)) for s in at.tolist()), np.uint64, len(at))
                alone.append((key, text[own], at + shift[own]))
        held.send(rows, grp, shards, number)
        if alone:
            key, text, lo = (np.concatenate(x) for x in zip(*alone))
            one, n = self.tally(key, text, number)
            order, shard, cuts = packed((one % np.uint64(shards)).astype(np.int64))
            which = np.empty(len(one), np.int64)
            which[order] = np.arange(len(one))
            which = which[np.searchsorted(one, key)]
            by = np.argsort(which, kind="stable")
            which, text, lo = which[by], text[by], lo[by]
            for k, (s, e) in zip(shard, cuts):
                x, y = np.searchsorted(which, (s, e))
                rows.add(k, grp, WINDOWS, key=one[order[s:e]], size=n[order[s:e]], which=which[x:y] - s, text=text[x:y], lo=lo[x:y])
        return rows.table()

    def send_windows(self, t: pa.Table, mail: pa.Table, id_col: str, text_col: str, shards: int, grp: int) -> pa.Table:
        """Windows of hot anchors that are there again, as contexts; what is told already is passed on."""
        rows, held, w, kind = Rows(), Contexts(), self.window, self.kind(self.k)
        for r in of_kind(mail, SPANS).to_pylist():
            rows.rows.append(r | {"shard": grp % shards})
        again = of_kind(mail, WINDOWS)
        if again.num_rows and t.num_rows:
            _, number, texts, _ = self.read(t, id_col, text_col)
            text, lo = column(again, "text").astype(np.int64), column(again, "lo").astype(np.int64)
            order = np.lexsort((lo, text))
            text, lo = text[order], lo[order]
            for x in np.unique(text).tolist():
                own = lo[np.searchsorted(text, x) : np.searchsorted(text, x, "right")]
                pieces = list(kind.pieces(texts[x], w))
                for (at, piece), (end, _) in zip(pieces, [*pieces[1:], (1 << 62, b"")]):
                    here = own[(own >= at) & (own < end)]
                    contents = kind.windows(piece, (here - at).tolist(), w)
                    held.add(contents, [xxhash.xxh3_64_intdigest(c) for c in contents], np.full(len(here), x), here)
            held.send(rows, grp, shards, number)
        return rows.table()

    def spans(self, mail: pa.Table, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first and last unit but one) of all that goes."""
        mail = of_kind(mail, SPANS)
        text, lo, hi, value = (column(mail, c).astype(np.int64) for c in ("text", "lo", "which", "least"))
        go = self.keep(value, number[text])
        order = np.argsort(text[go], kind="stable")
        return text[go][order], lo[go][order], hi[go][order]

    # A shard's step

    def answer(self, t: pa.Table, shard: int, most_bytes: int = 1 << 20) -> pa.Table:
        rows = Rows()
        for r in of_kind(t, SPANS).to_pylist():
            rows.rows.append(r | {"shard": -1})
        alone = of_kind(t, WINDOWS)
        if alone.num_rows:
            again = of_kind(Finder.find_again(self, alone), AGAIN)
            keys = {g: np.sort(np.frombuffer(k, np.uint64)) for g, k in zip(again["grp"].to_pylist(), again["key"].to_pylist())}
            for r in alone.to_pylist():
                if r["grp"] in keys:
                    own = among(np.frombuffer(r["key"], np.uint64), keys[r["grp"]])[np.frombuffer(r["which"], np.uint32)]
                    rows.add(-1, r["grp"], WINDOWS, text=np.frombuffer(r["text"], np.uint32)[own], lo=np.frombuffer(r["lo"], np.uint32)[own])
        t = of_kind(t, CONTEXTS)
        if t.num_rows:
            self.solved(t, rows, most_bytes)
        return rows.table()

    def solved(self, t: pa.Table, rows: Rows, most_bytes: int) -> None:
        key, size, least = column(t, "key"), column(t, "size").astype(np.int64), column(t, "least")
        data = b"".join(zstandard.ZstdDecompressor().decompress(x) for x in t["content"].to_pylist())
        end = np.cumsum(size)
        seen: dict[bytes, int] = {}
        which = np.fromiter((seen.setdefault(data[e - s : e], len(seen)) for e, s in zip(end.tolist(), size.tolist())), np.int64, len(size))
        del data
        contents = list(seen)
        del seen
        first = np.unique(which, return_index=True)[1]
        key, size, lowest = key[first], size[first], np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(lowest, which, least)
        each, places = counts(t, "size"), counts(t, "which")
        base = np.cumsum(each) - each
        own = column(t, "which").astype(np.int64) + np.repeat(base, places)  # the row's context of each place
        n = np.bincount(own, minlength=len(which))
        total = np.bincount(which, n, minlength=len(contents)).astype(np.int64)
        # Runs of whole anchor groups are solved together.
        order = np.lexsort((lowest, key))
        same = key[order][1:] == key[order][:-1]
        one = ~(np.append(same, False) | np.concatenate(([False], same)))
        a, b, v, m = ([None] * len(contents) for _ in range(4))
        # Equal windows have their anchor at the same place, so a context that is alone under its anchor repeats none.
        first = np.zeros(1, np.int64)
        for c, x in zip(order[one].tolist(), self.alone(total[order[one]], lowest[order[one]]).tolist()):
            a[c], b[c], v[c], m[c] = first, np.array([self.kind.length(contents[c]) - self.window + 1]), np.array([x]), 1
        order = order[~one]
        edge = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
        held = np.cumsum(size[order])
        runs, at = [], 0
        while at < len(order):
            to = int(np.searchsorted(held, held[at] - size[order[at]] + most_bytes, "left")) + 1
            i = int(np.searchsorted(edge, to, "left"))
            to = int(edge[i]) if i < len(edge) else len(order)
            runs.append(order[at:to])
            at = to
        for run in runs:
            for c, x in zip(run.tolist(), self.solve([contents[c] for c in run.tolist()], key[run], total[run], lowest[run])):
                cut = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
                a[c], b[c], v[c], m[c] = cut, np.concatenate((cut[1:], [len(x)])), x[cut], len(cut)
        m = np.array(m, np.int64)
        head = np.cumsum(m) - m
        a, b, v = (np.concatenate(x).astype(np.int64) for x in (a, b, v))
        # What each place of a context is told: its runs of windows with one value.
        text, lo = column(t, "text").astype(np.int64), column(t, "lo").astype(np.int64)
        last = np.cumsum(places)
        for grp, s, e in zip(t["grp"].to_pylist(), (last - places).tolist(), last.tolist()):
            c = which[own[s:e]]
            run, at = spread(head[c], m[c]), np.repeat(np.arange(s, e), m[c])
            go = self.tells(v[run], least[own[at]], n[own[at]])
            run, at = run[go], at[go]
            if len(run):
                rows.add(-1, grp, SPANS, text=text[at], lo=lo[at] + a[run], which=lo[at] + b[run] - 1 + self.window, least=v[run])


def among(a: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of a are in a sorted array."""
    if not len(ordered):
        return np.zeros(len(a), bool)
    return ordered[np.minimum(np.searchsorted(ordered, a), len(ordered) - 1)] == a


def cut_repeats(docs: DataFrame, finder: Finder, kept, outputs: str, *, id_col: str, text_col: str) -> DataFrame:
    """The input's rows and columns and `outputs`, which kept(text, starts, ends) gives for each text and its spans that
    go; columns of the same names are replaced. Rows without an id are kept whole and compared with none."""
    names = [f.name for f in T._parse_datatype_string(outputs).fields]
    docs = docs.drop(*names)
    mb = (docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) / 1e6
    groups, shards = max(1, round(mb / GROUP_MB)), max(8, round(mb / SHARD_MB))
    (grp,) = free([*docs.columns, *names], "grp")
    key = F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(F.xxhash64(id_col))
    dealt = docs.withColumn(grp, F.pmod(key, F.lit(groups)))
    # In the order of `docs`, so that texts are shuffled once where there are no other columns.
    narrow = dealt.select(*[c for c in docs.columns if c in (id_col, text_col)], grp)
    by_group = lambda df: df.groupBy(grp)
    schema = docs.schema
    arrow = to_arrow_schema(T.StructType([*schema.fields, *T._parse_datatype_string(outputs).fields]))

    def number(t: pa.Table) -> int:
        return t[grp][0].as_py()

    def send_anchors(t: pa.Table) -> pa.Table:
        return finder.send_anchors(t, id_col, text_col, shards, number(t))

    def find_again(t: pa.Table) -> pa.Table:
        return finder.find_again(t)

    def send_contexts(t: pa.Table, mail: pa.Table) -> pa.Table:
        return finder.send_contexts(t, mail, id_col, text_col, shards, number(t)) if t.num_rows and mail.num_rows else Rows().table()

    def send_windows(t: pa.Table, mail: pa.Table) -> pa.Table:
        return finder.send_windows(t, mail, id_col, text_col, shards, number(t)) if t.num_rows and mail.num_rows else Rows().table()

    def answer(t: pa.Table) -> pa.Table:
        return finder.answer(t, t["shard"][0].as_py())

    def cut(t: pa.Table, mail: pa.Table) -> pa.Table:
        if not t.num_rows:
            return arrow.empty_table()
        order, ids, _, texts = finder.read(t, id_col, text_col)
        text, lo, hi = finder.spans(mail, ids)
        edge = np.searchsorted(text, np.arange(len(texts) + 1))
        got = [kept(x, *merged(lo[s:e], hi[s:e])) for x, s, e in zip(texts, edge[:-1].tolist(), edge[1:].tolist())]
        t = t.drop_columns([grp]).take(order)
        for i, name in enumerate(names):
            t = t.append_column(name, pa.array([r[i] for r in got], arrow.field(name).type))
        return t

    sent = by_group(narrow).applyInArrow(send_anchors, ROW)
    again = sent.groupBy("shard").applyInArrow(find_again, ROW)
    contexts = by_group(narrow).cogroup(again.groupBy("grp")).applyInArrow(send_contexts, ROW)
    answers = contexts.groupBy("shard").applyInArrow(answer, ROW)
    windows = by_group(narrow).cogroup(answers.groupBy("grp")).applyInArrow(send_windows, ROW)
    answers = windows.groupBy("shard").applyInArrow(answer, ROW)
    out = T.StructType([*schema.fields, *T._parse_datatype_string(outputs).fields])
    return by_group(dealt).cogroup(answers.groupBy("grp")).applyInArrow(cut, out)
