import random
from collections import Counter

import numpy as np
import pytest
from cases import none, odd, same_columns
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeloom.llm import repeats, substring_dedup, suffix_array


def brute_bytes(rows, window):
    texts = [(t or "").encode() if i is not None else b"" for i, t in rows]
    count = Counter(t[a : a + window] for t in texts for a in range(len(t) - window + 1))
    out = []
    for (i, t), raw in zip(rows, texts):
        whole = (t or "").encode()
        gone = np.zeros(len(whole), bool)
        for a in range(len(raw) - window + 1):
            if count[raw[a : a + window]] > 1:
                gone[a : a + window] = True
        runs = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        out.append((i, len(whole), int(gone.sum()), runs, np.frombuffer(whole, np.uint8)[~gone].tobytes()))
    return sorted(out, key=repr)


def brute_words(rows, window):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for a in range(len(w) - window + 1) if i is not None else ():
            k = tuple(w[a : a + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for a in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[a : a + window])] < i:
                gone[a : a + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=repr)


def got_bytes(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept_bytes"])) for r in df.collect()), key=repr)


def got_words(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("hot", [200_000, 1])
def test_odd_rows(spark, hot):
    docs = odd(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    a = suffix_array.dedup_bytes(docs, window=50, hot=hot)
    same_columns(a, docs, ["kept_bytes", "n_bytes", "n_removed", "n_spans"])
    assert got_bytes(a) == brute_bytes(rows, 50)
    b = substring_dedup.dedup_windows(docs, hot=hot)
    same_columns(b, docs, ["kept_text", "n_words", "n_removed"])
    assert got_words(b) == brute_words(rows, 13)


def test_empty_tables(spark):
    assert suffix_array.dedup_bytes(none(spark)).collect() == []
    assert substring_dedup.dedup_windows(none(spark)).collect() == []


@pytest.mark.parametrize("mb", [12, 0.01])
def test_tables(spark, data, monkeypatch, mb):
    monkeypatch.setattr(repeats, "GROUP_MB", mb)
    monkeypatch.setattr(repeats, "SHARD_MB", mb)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got_bytes(suffix_array.dedup_bytes(docs)) == brute_bytes(rows, 200)
    assert got_words(substring_dedup.dedup_windows(docs)) == brute_words(rows, 13)


def test_made_up_texts(spark, monkeypatch):
    r = random.Random(1)
    base = "".join(r.choice("ab ") for _ in range(400))
    rows = [(i, "".join([base[(s := r.randrange(300)) : s + r.randrange(20, 90)], r.choice(["", "xyz", " "]), base[(s := r.randrange(300)) : s + r.randrange(90)]])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for group in (12, 0.001):
        monkeypatch.setattr(repeats, "GROUP_MB", group)
        assert got_bytes(suffix_array.dedup_bytes(docs, window=24)) == brute_bytes(rows, 24)
        assert got_words(substring_dedup.dedup_windows(docs, window=5)) == brute_words(rows, 5)


def test_pieces_of_long_texts(spark, monkeypatch):
    """Texts that are read in pieces have the same windows, each under the same anchor, and lose the same."""
    text = b" \t ".join(b"w%d" % (i * i % 311) + b"x" * (i % 97 == 0) * 900 for i in range(3000))
    for kind, window in ((repeats.Words(5), 13), (repeats.Bytes(32), 200)):
        finder, found = repeats.Finder(lambda k, kind=kind: kind, window, kind.k, None, None, None, None, False, 1), []
        for step in (1 << 21, 700):
            monkeypatch.setattr(repeats, "STEP", step)
            every = set()
            for _, _, a, t, shift, lo, hi in finder.anchored([b"tiny", text, b"", text[:1000]]):
                every |= {(int(x), int(y), s) for x, y, z, p, q in zip(a, t, shift, lo, hi) for s in range(p + z, q + z + 1)}
            found.append(every)
        assert found[0] == found[1] and len(found[0]) > 2000
    monkeypatch.setattr(repeats, "STEP", 500)
    docs = odd(spark).where("text is null or length(text) < 5000")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for hot in (10_000, 1):
        assert got_bytes(suffix_array.dedup_bytes(docs, window=50, hot=hot)) == brute_bytes(rows, 50)
        assert got_words(substring_dedup.dedup_windows(docs, hot=hot)) == brute_words(rows, 13)


def test_memory_of_a_long_text():
    """What is held of one text at a time does not grow with it, but for the places of anchors."""
    import tracemalloc

    text = b" ".join(b"w%d" % (i * 7919 % 1_000_003) for i in range(3_000_000))
    for kind, window, k in ((repeats.Words, 13, 5), (repeats.Bytes, 200, 32)):
        finder = repeats.Finder(kind, window, k, None, None, None, None, False, 1)
        tracemalloc.start()
        n = sum(len(a) for _, _, a, *_ in finder.anchored([text]))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n > 10_000 and most < 12 * len(text) and most < 250e6


@given(st.lists(st.text(alphabet="ab \n\tü", max_size=60), max_size=6))
@settings(max_examples=60, deadline=None)
def test_words_have_equal_hashes_iff_equal(texts):
    kind = repeats.Words(1)
    kind.step = 7
    raw = [t.encode() for t in texts]
    u = kind.units(raw)
    words = [w for t in raw for w in t.split()]
    assert [u.data[a:b] for a, b in zip(u.starts, u.ends)] == words
    assert [len(t.split()) for t in raw] == (u.last - u.first).tolist()
    seen = {}
    for w, h in zip(words, u.grams.tolist()):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


@given(st.lists(st.binary(min_size=1, max_size=60).map(lambda b: bytes(x % 2 for x in b)), min_size=1, max_size=5), st.integers(8, 40))
@settings(max_examples=150, deadline=None)
def test_refinement(strings, depth):
    size = np.array([len(s) for s in strings])
    first = np.cumsum(size) - size
    at, which = suffix_array.Buckets(np.frombuffer(b"".join(strings), np.uint8), first, size, depth).equal_windows()
    subs = {int(f) + i: s[i : i + depth] for f, s in zip(first, strings) for i in range(len(s) - depth + 1)}
    assert sorted(at.tolist()) == sorted(subs)
    assert len({*zip(which.tolist(), (subs[i] for i in at.tolist()))}) == len({*which.tolist()}) == len({*subs.values()})


def test_refinement_in_chunks(monkeypatch):
    """Small chunks, so that identifiers written back in a pass are met in it; the order is that of the bytes."""
    r = random.Random(4)
    strings = [bytes(r.choice(b"ab") for _ in range(30)) * r.randrange(1, 4) for _ in range(80)]
    size = np.array([len(s) for s in strings])
    first = np.cumsum(size) - size
    for chunk, deeper in ((1 << 15, 2), (16, 1), (16, 5)):
        monkeypatch.setattr(suffix_array, "CHUNK", chunk)
        monkeypatch.setattr(suffix_array, "DEEPER", deeper)
        at, which = suffix_array.Buckets(np.frombuffer(b"".join(strings), np.uint8), first, size, 25).equal_windows()
        subs = {int(f) + i: s[i : i + 25] for f, s in zip(first, strings) for i in range(len(s) - 24)}
        assert [subs[i] for i in at.tolist()] == sorted(subs.values())
        assert len({*zip(which.tolist(), (subs[i] for i in at.tolist()))}) == len({*which.tolist()}) == len({*subs.values()})


@given(st.lists(st.lists(st.integers(0, 2), min_size=4, max_size=15), min_size=1, max_size=6, unique_by=tuple))
@settings(max_examples=150, deadline=None)
def test_smallest_owner(passages):
    parts = [" ".join(map(str, p)).encode() for p in passages]
    owners = np.array([(7 * i) % 5 + 1 for i in range(len(parts))])
    order = np.argsort(owners, kind="stable").tolist()
    found = substring_dedup.smallest_owner(4)([parts[i] for i in order], np.zeros(len(parts), int), np.ones(len(parts), int), owners[order])
    got = [found[order.index(i)] for i in range(len(parts))]
    for p, values in zip(passages, got):
        assert values.tolist() == [min(o for q, o in zip(passages, owners) if any(q[j : j + 4] == p[i : i + 4] for j in range(len(q) - 3))) for i in range(len(p) - 3)]


def test_merged():
    a, b = repeats.merged(np.array([5, 1, 30, 8, 2]), np.array([8, 4, 31, 9, 3]))
    assert list(zip(a.tolist(), b.tolist())) == [(1, 4), (5, 9), (30, 31)]
    assert [x.tolist() for x in repeats.merged(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [[], []]


def test_hot_windows(spark, monkeypatch):
    """A passage that most documents share, with another text around it in each, is split by windows and told the same."""
    monkeypatch.setattr(repeats, "GROUP_MB", 0.01)
    passage = " ".join(f"all{i} have" for i in range(40))
    rows = [(i, f"{i} own{i % 50} text {'of ' * (i % 7)}{passage if i % 3 else passage[60:]} and {i % 4} more of {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (10_000, 40, 3):
        assert got_bytes(suffix_array.dedup_bytes(docs, window=60, hot=hot)) == brute_bytes(rows, 60)
        assert got_words(substring_dedup.dedup_windows(docs, hot=hot)) == brute_words(rows, 13)


def test_rows_come_in_any_order(spark, monkeypatch):
    """A group's rows come in another order at each step, as shuffled blocks do."""
    import pyarrow as pa

    order = random.Random(7)
    read = repeats.Finder.read

    def shuffled(t, *columns):
        by = list(range(t.num_rows))
        order.shuffle(by)
        back, *rest = read(t.take(by), *columns)
        return [by[i] for i in back], *rest

    docs = odd(spark)
    for make, window, kept, brute in ((suffix_array.dedup_bytes, 50, suffix_array.kept, brute_bytes), (substring_dedup.dedup_windows, 13, substring_dedup.kept, brute_words)):
        finders = []
        module = suffix_array if make is suffix_array.dedup_bytes else substring_dedup
        monkeypatch.setattr(module, "cut_repeats", lambda docs, finder, *a, **b: finders.append(finder))
        make(docs, window=window, hot=1)
        finder = finders[0]
        finder.read = shuffled
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        t = pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([x for _, x in rows], pa.string())})
        step = lambda rows, key: {v: rows.filter(pa.array([x == v for x in rows[key].to_pylist()])) for v in set(rows[key].to_pylist())}
        ids = ("doc_id", "text", 3, 0)
        sent = step(finder.send_anchors(t, *ids), "shard")
        again = pa.concat_tables([finder.find_again(x) for x in sent.values()])
        mail = step(finder.send_contexts(t, again, *ids), "shard")
        told = pa.concat_tables([finder.answer(x, s) for s, x in mail.items()])
        mail = step(finder.send_windows(t, told, *ids), "shard")
        told = pa.concat_tables([finder.answer(x, s) for s, x in mail.items()])
        by, number, _, texts = shuffled(t, "doc_id", "text")
        text, lo, hi = finder.spans(told, number)
        gone = [kept(x, *repeats.merged(lo[text == k], hi[text == k])) for k, x in enumerate(texts)]
        out = [(rows[i][0], *g[1:], g[0]) for i, g in zip(by, gone)]
        assert sorted(out, key=repr) == brute(rows, window)
