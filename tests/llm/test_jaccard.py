"""The near-duplicate stage against brute-force Jaccard similarity of 5-word shingles."""

import random

import corpus_pipeline as cp
from cases import none, odd
from test_simhash import slow_fingerprint

from lakeloom.llm import jaccard


def sets_of(text, k=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows):
    sets = [(i, sets_of(t)) for i, t in rows if i is not None]
    return {(i, j) for i, a in sets for j, b in sets if i < j and a and b and len(a & b) / len(a | b) >= 0.8}


def corpus(seed=1):
    """Groups of copies with more and more words changed, some around a passage that most texts have; short texts; bounds."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    passage, texts = [word() for _ in range(40)], []
    for g in range(25):
        base = [word() for _ in range(rng.choice([6, 9, 40, 120, 300]))] + (passage if g % 2 else [])
        for k in range(8):
            copy = list(base)
            for at in rng.sample(range(len(copy)), min(len(copy), k * max(1, len(copy) // 120))):
                copy[at] = word()
            texts.append(" ".join(copy))
    nine = [f"u{i}" for i in range(13)]  # 9 shingles; with one word more 10 (0.9), with two 11, with three 12 (0.75)
    texts += [" ".join(nine + [f"v{i}" for i in range(k)]) for k in range(4)]
    texts += ["A b c", "a B  c", "a b d", "", None]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_links_are_those_of_brute_force(spark):
    rows = corpus()
    want = brute(rows)
    text = dict(rows)
    assert sum((slow_fingerprint(text[i]) ^ slow_fingerprint(text[j])).bit_count() > 4 for i, j in want) > 20
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for share in (1.0, 0.1):  # all texts and few counted: the order differs, the pairs do not
        assert {tuple(r) for r in jaccard.links(df, share=share).collect()} == want


def closure(pairs):
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in root if find(i) != i}


def test_groups_are_those_of_all_links(spark):
    """Chains of near copies whose ends are not near, large groups, and what only shares passages with them."""
    rng = random.Random(5)
    rows = corpus(3)
    text = [f"c{i}" for i in range(200)]
    for k in range(60):  # each differs a little from the one before
        rows.append((1000 + (k * 37) % 60, " ".join(text)))
        for at in rng.sample(range(200), 2):
            text[at] = f"c{rng.randrange(10**6)}"
    rows += [(2000 + k, " ".join([*text[:100], *(f"x{k}_{i}" for i in range(rng.randrange(5, 60)))])) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for share in (1.0, 0.1):
        assert {r["node"]: r["root"] for r in jaccard.groups(df, share=share).collect()} == closure(brute(rows))
    gone = spark.createDataFrame([(i,) for i, _ in rows[::3]], "id long")
    left = [r for k, r in enumerate(rows) if k % 3]
    assert {r["node"]: r["root"] for r in jaccard.groups(df, gone).collect()} == closure(brute(left))


def test_large_groups_are_not_compared_in_pairs(spark, monkeypatch):
    """Of 400 near copies each is compared with few others."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(400):
        copy = list(base)
        for at in rng.sample(range(300), 3):
            copy[at] = f"own{k}_{at}"
        rows.append((k, " ".join(copy)))
    n, told = [], jaccard.told
    monkeypatch.setattr(jaccard, "told", lambda pairs, *a: n.append(pairs.count()) or told(pairs, *a))
    assert {r["root"] for r in jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0}
    assert sum(n) < 20 * 400


def test_odd_rows(spark):
    docs = odd(spark)
    assert {tuple(r) for r in jaccard.links(docs).collect()} == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["node"]: r["root"] for r in jaccard.groups(docs).collect()} == closure(brute([(r["doc_id"], r["text"]) for r in docs.collect()]))
    assert jaccard.links(none(spark)).collect() == [] and jaccard.groups(none(spark)).collect() == []


def test_stage_leaves_no_near_copies(spark, data):
    rows = corpus(2)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = [(r["doc_id"], r["text"]) for r in cp.near_stage(spark, docs, data).collect()]
    assert brute(rows) and not brute(left)
    assert {i for i, _ in rows} - {i for p in brute(rows) for i in p} - {i for i, t in rows if not t} <= {i for i, _ in left}
