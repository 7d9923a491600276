import numpy as np
import xxhash
from cases import none, odd

from lakeloom.llm import simhash
from lakeloom.llm.graph import components


def slow_fingerprint(text, each=4):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + each]) for i in range(max(1, len(words) - each + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, pairs):
    p = list(range(n))

    def find(a):
        while p[a] != a:
            p[a] = p[p[a]]
            a = p[a]
        return a

    for a, b in pairs:
        p[find(a)] = find(b)
    return [find(a) for a in range(n)]


def brute(rows, radius=4, each=4):
    rows = [(i, slow_fingerprint(t, each)) for i, t in rows if i is not None]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if (rows[a][1] ^ rows[b][1]).bit_count() <= radius or rows[a][0] == rows[b][0]]
    r = roots(len(rows), pairs)
    least = {k: min(rows[a][0] for a in range(len(rows)) if r[a] == k) for k in set(r)}
    return sorted((i, f, least[k]) for (i, f), k in zip(rows, r))


def got(df):
    return sorted((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in df.collect())


def test_odd_rows(spark):
    docs = odd(spark)
    assert got(simhash.near_dedup(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_empty_table(spark):
    assert simhash.near_dedup(none(spark)).collect() == []


def test_query(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert [(r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in sorted(simhash.query(spark, data).collect())] == brute(rows)


def test_bit_slices():
    rng = np.random.default_rng(3)
    for n, m, radius in ((70, 130, 4), (1, 1, 0), (5, 64, 7), (64, 65, 1)):
        base = rng.integers(0, 1 << 63, m, dtype=np.uint64)
        q = base[rng.integers(0, m, n)] ^ (rng.integers(0, 1 << 63, n, dtype=np.uint64) & rng.integers(0, 1 << 63, n, dtype=np.uint64) & rng.integers(0, 1 << 63, n, dtype=np.uint64) & rng.integers(0, 1 << 63, n, dtype=np.uint64))
        i, j = simhash.near(q, base, radius)
        assert {*zip(i.tolist(), j.tolist())} == {(a, b) for a in range(n) for b in range(m) if (int(q[a]) ^ int(base[b])).bit_count() <= radius}


def test_tiles_find_the_same(spark):
    rng = np.random.default_rng(5)
    seed = rng.integers(0, 1 << 62, 6, dtype=np.int64)
    fps = {int(s) ^ (1 << int(a)) ^ (1 << int(b)) for s in seed for a, b in rng.integers(0, 62, (120, 2))}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for tile in (20_000, 10):
        found = components(simhash.links(df, 4, tile))
        names = sorted(fps)
        place = {f: k for k, f in enumerate(names)}
        own = roots(len(names), [(place[r["node"]], place[r["root"]]) for r in found.collect()])
        want = roots(len(names), [(a, b) for a in range(len(names)) for b in range(a) if (names[a] ^ names[b]).bit_count() <= 4])
        assert len({*zip(own, want)}) == len({*own}) == len({*want})


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 301)) and got[1001] == 1000


def test_more_bit_groups_find_the_same(spark):
    """However many groups must agree, all near fingerprints share a bucket; their number follows the table."""
    assert [simhash.groups_for(n, 4) for n in (0, 10**6, 2 * 10**8, 10**10, 10**12)] == [2, 2, 3, 4, 5]
    rng = np.random.default_rng(8)
    seed = rng.integers(0, 1 << 62, 5, dtype=np.int64)
    fps = sorted({int(s) ^ sum({1 << int(b) for b in bits}) for s in seed for bits in rng.integers(0, 63, (40, 3))})
    want = roots(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    place = {f: k for k, f in enumerate(fps)}
    for m in (2, 3, 4):
        own = roots(len(fps), [(place[r["a"]], place[r["b"]]) for r in simhash.links(df, 4, m=m).collect()])
        assert len({*zip(own, want)}) == len({*own}) == len({*want})


def test_long_text(spark):
    text = " ".join(f"w{i % 1009}" for i in range(400_000))
    r = simhash.near_dedup(spark.createDataFrame([(1, text), (2, text + " x"), (3, "y")], "doc_id long, text string")).collect()
    assert sorted((x["doc_id"], x["component_id"]) for x in r) == [(1, 1), (2, 1), (3, 3)] and r[0]["fp"] is not None
