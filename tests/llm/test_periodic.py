import hashlib
import random
import zlib

import numpy as np
from cases import none, odd, same_columns

from lakeloom.llm import periodic


def brute(words, min_words=6, power=4):
    """Every stretch with a period that no neighbour extends, by its smallest period."""
    n, out = len(words), set()
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_words, power * q):
                s = words[i : j + q]
                if not any(all(a == b for a, b in zip(s, s[d:])) for d in range(1, q)):
                    out.add((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def found(words, min_words, power):
    ids = np.array([hash(w) % 1000 for w in words], np.int64)
    runs = periodic.runs_of(ids, np.zeros(len(ids), np.int64), min_words, power)
    return sorted(map(tuple, runs.tolist()), key=lambda r: (r[0], r[2]))


def periodic_words(rng, n):
    out = []
    while len(out) < n:
        root = rng.choices(range(rng.choice([2, 3, 50])), k=rng.randint(1, 9))
        out += (root * rng.randint(1, 7))[: rng.randint(1, 60)]
    return out[:n]


def test_all_squares():
    """Runs of two periods and more: every square is in one, so the vocabulary has to be complete."""
    rng = random.Random(1)
    for n in range(600):
        words = rng.choices(range(rng.choice([1, 2, 3, 4])), k=rng.randint(0, 60)) if n % 2 else periodic_words(rng, rng.randint(1, 150))
        assert found(words, 2, 2) == brute(words, 2, 2), words


def test_all_words_of_two_letters():
    for n in range(1, 12):
        for bits in range(1 << n):
            words = [bits >> i & 1 for i in range(n)]
            assert found(words, 2, 2) == brute(words, 2, 2), words


def test_words_that_repeat_in_fibonacci_order():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    assert found(b, 2, 2) == brute(b, 2, 2)


def test_powers_and_lengths():
    rng = random.Random(2)
    for power, least in ((4, 6), (3, 5), (2, 9), (5, 2)):
        for _ in range(150):
            words = periodic_words(rng, 200)
            assert found(words, least, power) == brute(words, least, power), (power, least, words)


def test_texts_of_a_batch_are_apart(monkeypatch):
    """Stretches that are solved together, or in groups, give what each gives alone."""
    rng = random.Random(3)
    texts = [periodic_words(rng, rng.randint(0, 90)) for _ in range(60)]
    ids, doc = np.concatenate([np.array(t, np.int64) for t in texts]), np.repeat(np.arange(60), [len(t) for t in texts])
    begin = np.cumsum([0, *map(len, texts)])
    want = sorted((begin[d] + s, length, q) for d, t in enumerate(texts) for s, length, q in brute(t))
    for together in (1, 100, 1 << 16):
        monkeypatch.setattr(periodic, "TOGETHER", together)
        assert sorted(map(tuple, periodic.runs_of(ids, doc, 6, 4).tolist())) == want


def test_long_periods():
    rng = random.Random(4)
    words = rng.choices(range(5000), k=3000) * 7 + rng.choices(range(5000), k=500)
    runs = periodic.runs_of(np.array(words, np.int64), np.zeros(len(words), np.int64), 6, 4)
    assert [tuple(r) for r in runs.tolist() if r[2] > 10] == [(0, 21_000 + next(i for i in range(500) if words[21_000 + i] != words[18_000 + i]), 3000)]


def test_odd_rows(spark):
    docs = odd(spark).unionByName(odd(spark).limit(1).selectExpr("doc_id", "'x ' || repeat('a b\\n ', 9) || 'c' AS text", "* except(doc_id, text)"))
    out = periodic.periodic_runs(docs)
    same_columns(out, docs, ["n_words", "runs", "kept_text"])
    for r in out.collect():
        words = [w.decode() for w in (r["text"] or "").encode().split()]
        want = brute(words) if len(words) < 5000 else [(0, 120_000, 2 * 977 * 13)]
        assert r["n_words"] == len(words) and [tuple(x) for x in r["runs"]] == want and r["kept_text"] == kept(words, want)
    assert [tuple(x) for r in out.where("text like 'x a b%'").collect() for x in r["runs"]] == [(1, 18, 2)]
    assert periodic.periodic_runs(none(spark)).collect() == []


def test_query(spark, data):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect():
        words = [w.decode() for w in (r["text"] or "").encode().split()]
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute(words)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None,) * 3)
        want.append((r["doc_id"], len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(kept(words, runs))))
    assert any(w[1] for w in want)
    assert sorted(map(tuple, periodic.query(spark, data).collect())) == sorted(want)
