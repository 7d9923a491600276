import random

import pytest
from cases import none, odd, same_columns

from lakeloom.llm import decontaminate as d


def brute(text, items, size):
    words = d.words_of((text or "").encode())
    hit, found = [False] * len(words), set()
    for k, item in enumerate(items):
        m = min(size, len(item))
        wins = {tuple(item[i : i + m]) for i in range(len(item) - m + 1)} if m else set()
        for i in range(len(words) - m + 1) if m else ():
            if tuple(words[i : i + m]) in wins:
                hit[i : i + m] = [True] * m
                found.add(k)
    return hit, found


@pytest.mark.parametrize("seed", range(60))
def test_automaton(seed):
    r = random.Random(seed)
    word = lambda: bytes([97 + r.randrange(3)])
    items = [[word() for _ in range(r.randrange(0, 14))] for _ in range(r.randrange(0, 8))]
    a = d.Automaton(items, 5)
    for _ in range(20):
        text = [word() if r.random() < 0.95 else b"z" for _ in range(r.randrange(0, 60))]
        hit, found = a.match(text)
        want = brute(b" ".join(text).decode(), items, 5)
        assert (hit.tolist(), found) == want


ITEMS = [(3, " ".join(f"P{i}" for i in range(20, 40))), (1, "short"), (20, "漢字"), (4, None), (5, ""), (None, "line"), (None, " ".join(f"p{i}" for i in range(10))), (3, "filler1 word1"), (7, " ".join(f"word{i % 977} filler{i % 13}" for i in range(300, 360)))]


@pytest.mark.parametrize("shard_mb", [8, 0.0003])
def test_odd_rows(spark, shard_mb):
    """Also with a benchmark beyond what one automaton takes, whose long items are cut into parts."""
    docs = odd(spark)
    bench = spark.createDataFrame([*ITEMS, ITEMS[0]], "item_id long, text string")
    out = d.decontaminate(docs, bench, shard_mb=shard_mb)
    same_columns(out, docs, ["n_words", "n_hit", "n_items", "items", "clean_text"])
    rows = [(i if i is None else str(i), t) for i, t in ITEMS if t]
    items = [d.words_of(t.encode()) for _, t in rows]
    got = out.collect()
    assert len(got) == docs.count()
    for r in got:
        hit, found = brute(r["text"], items, 10)
        ids = {rows[k][0] for k in found}
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items"]) == (len(hit), sum(hit), len(ids), sorted(ids - {None}))
        left = d.words_of((r["clean_text"] or "").encode())
        assert left == [w for w, h in zip(d.words_of((r["text"] or "").encode()), hit) if not h]
        assert r["clean_text"] == r["text"] or sum(hit)
    assert any(r["n_items"] > len(r["items"]) and r["n_hit"] for r in got)


def test_shards_of_the_table(spark, data):
    """Shards give what one automaton gives, over whole tables."""
    docs, bench = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    one, many = (sorted(map(tuple, d.decontaminate(docs.select("doc_id", "text"), bench, shard_mb=mb).collect()), key=repr) for mb in (8, 0.004))
    assert one == many


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert d.decontaminate(none(spark), bench).collect() == []
    assert {r["n_hit"] for r in d.decontaminate(odd(spark), bench).collect()} == {0}


def test_memory_of_an_automaton():
    """Under 150 bytes a word, so that shard_mb of text takes a bounded part of a worker."""
    r = random.Random(1)
    words = [b"w%d" % int(r.paretovariate(0.4)) for _ in range(60_000)]
    import pickle

    a = d.Automaton([words[i : i + 60] for i in range(0, len(words), 60)], 10)
    flat = sum(len(x) * x.itemsize for x in (a.word, a.to, a.link, a.len))
    assert flat + a.window_state.nbytes + a.window_item.nbytes < 50 * len(words)
    assert sum(len(x) for x in a.more.values()) < 2 * len(words)
    assert len(pickle.dumps(vars(a))) < 150 * len(words)


def test_long_text(spark):
    text = "nothing here " * 700_000 + " ".join(f"p{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = d.decontaminate(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).first()
    assert (r["n_words"], r["n_hit"], r["items"]) == (1_400_030, 20, ["3"])
