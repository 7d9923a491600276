import random

from lakeloom.functions import similarity


def strings(n, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzéß漢 ", k=rng.randint(1, 9))) for _ in range(60)]
    out = [" ".join(rng.choices(words, k=rng.randint(0, 6))) for _ in range(n)]
    return out + [t[2:] + "x" for t in out[::3]] + ["", "  ", "A", "a" * 300]


def test_bounds_are_bounds():
    texts = strings(60)
    grams = similarity.Grams(texts)
    for q, a in enumerate(texts):
        for b, most in zip(texts, grams.bounds(grams, q).tolist()):
            assert similarity.ratio_of(a, b) <= most + 1e-12


def test_pairs_are_those_of_brute_force(spark):
    names, asked = strings(80), strings(25, seed=4) + strings(80)[::7]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*names, None])], "i int, page string").repartition(3)
    q = spark.createDataFrame([(t,) for t in sorted(set(asked))], "asked string")
    for least, mb in ((0.6, 16), (0.8, 16), (0.8, 0.01)):
        want = {(a, i) for a in set(asked) for i, b in enumerate(names) if similarity.ratio_of(a, b) >= least}
        assert {(r["asked"], r["i"]) for r in similarity.similar_pairs(q, df, "page", least, block_mb=mb).collect()} == want
    assert similarity.similar_pairs(q, df.limit(0), "page", 0.6).collect() == [] and similarity.similar_pairs(q.limit(0), df, "page", 0.6).collect() == []


def test_few_pairs_are_compared(spark, data):
    t = [r["t"] for r in spark.sql(f"select regexp_extract(html, '<title>([^<]*)</title>', 1) t from parquet.`/root/testdata/sf0.01/pages.parquet`").distinct().collect()]
    names, q = spark.createDataFrame([(x,) for x in t], "page string"), spark.createDataFrame([(x[3:],) for x in t], "asked string")
    share = {}
    for least in (0.6, 0.8):
        counter = spark.sparkContext.accumulator(0)
        found = similarity.similar_pairs(q, names, "page", least, counter=counter).count()
        share[least] = counter.value / len(t) ** 2
        assert found <= counter.value
    print(share)
    assert share[0.8] < 0.1 and share[0.6] < 0.6


def test_common_subsequences_bound_ratios():
    texts = strings(40) + ["b" * 64, "ab" * 32, "b" * 65, "漢" * 3]
    grams = similarity.Grams(texts)
    every = list(range(len(texts)))
    for q, a in enumerate(texts):
        for b, most in zip(texts, grams.in_order(similarity.np.array(every), grams, q).tolist()):
            assert similarity.ratio_of(a, b) <= most + 1e-12


def test_the_best_are_those_of_brute_force_and_few_are_compared(spark):
    names, asked = strings(300), sorted(set(strings(20, seed=4) + [t[3:] for t in strings(300)[::9]]))
    df = spark.createDataFrame([(i, t, f"g{i % 40}") for i, t in enumerate(names)], "i int, page string, grp string").repartition(3)
    q = spark.createDataFrame([(t,) for t in asked], "asked string")
    for best, cap, below, group in ((1, 1.0, 0.0, None), (4, 0.7, 0.1, "grp")):
        counter = spark.sparkContext.accumulator(0)
        got = {(r["asked"], r["i"]): r["similarity"] for r in similarity.similar_pairs(q, df, "page", 0.3, counter=counter, best=best, cap=cap, below=below, group_col=group).collect()}
        for a in asked:
            full = {i: r for i, b in enumerate(names) if (r := similarity.ratio_of(a, b)) >= 0.3}
            tops = {}
            for i, r in full.items():
                g = f"g{i % 40}" if group else names[i]
                tops[g] = max(tops.get(g, 0), min(cap, r))
            floor = sorted(tops.values(), reverse=True)[best - 1] - below if len(tops) >= best else 0.3
            mine = {i: s for (b, i), s in got.items() if b == a}
            assert mine == {i: full[i] for i in mine} and {i for i, r in full.items() if r >= floor} <= set(mine)
        assert best > 1 or counter.value < 0.25 * len(asked) * len(names)
