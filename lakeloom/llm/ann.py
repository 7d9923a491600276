"""Approximate nearest neighbours over learned partitions.

On a bounded sample the exact neighbour graph is cut into balanced partitions, and a softmax classifier learns them from
the vectors. Partitions that are still large are cut again in the same way, on a sample of their own, so that there are
more of them the larger the table is. The tree of classifiers deals every vector to one partition and routes each query to
those it holds for probable; how probable they must be is set on the sample, so that the partitions asked hold the wanted
share of true neighbours. Candidates are reranked by the exact distance, partitions and queries in blocks of bounded size.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lakeloom.llm.common import saved, table

#: Rows that are drawn by a hash of their number.
WIDE = 1 << 40
FOUND = "query long, query_id long, row long, vec_id long, score double"


def neighbour_graph(x: np.ndarray, k: int, step: int = 512) -> np.ndarray:
    """(rows, k): each row's nearest others."""
    norm = (x * x).sum(axis=1)
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), step):
        d = norm[None, :] - 2 * x[a : a + step] @ x.T
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out[a : a + step] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced(graph: np.ndarray, x: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """Partition of each row. Halved along the main axis until there are `parts` equal pieces, then improved: in each
    round rows move to the partition that holds most of their neighbours, best gains first, while it has room (5 % over)."""
    part = np.zeros(len(x), np.int64)

    def halve(rows, lo, hi):
        if hi - lo == 1:
            part[rows] = lo
            return
        mid = (lo + hi) // 2
        own = x[rows] - x[rows].mean(axis=0)
        v = np.ones(x.shape[1])
        for _ in range(30):
            v = own.T @ (own @ v) + 1e-12
            v /= np.linalg.norm(v)
        order = rows[np.argsort(own @ v, kind="stable")]
        cut = len(rows) * (mid - lo) // (hi - lo)
        halve(order[:cut], lo, mid)
        halve(order[cut:], mid, hi)

    halve(np.arange(len(x)), 0, parts)
    room = int(np.ceil(1.05 * len(x) / parts))
    rows = np.arange(len(x))
    for _ in range(rounds):
        votes = np.zeros((len(x), parts))
        np.add.at(votes, (np.repeat(rows, graph.shape[1]), part[graph].ravel()), 1)
        np.add.at(votes, (graph.ravel(), np.repeat(part, graph.shape[1])), 1)
        to = votes.argmax(axis=1)
        gain = votes[rows, to] - votes[rows, part]
        size, moved = np.bincount(part, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[to[i]] < room:
                size[part[i]] -= 1
                size[to[i]] += 1
                part[i] = to[i]
                moved += 1
        if not moved:
            break
    return part


def learn(x: np.ndarray, y: np.ndarray, parts: int, rounds: int = 300, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression by Adam on all rows at once."""
    w, b = np.zeros((x.shape[1], parts)), np.zeros(parts)
    m, v = [np.zeros_like(w), np.zeros_like(b)], [np.zeros_like(w), np.zeros_like(b)]
    goal = np.eye(parts)[y]
    for t in range(1, rounds + 1):
        g = probabilities(x, w, b) - goal
        for k, (p, d) in enumerate(((w, x.T @ g / len(x) + 1e-5 * w), (b, g.mean(axis=0)))):
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.999 * v[k] + 0.001 * d * d
            p -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return w, b


def probabilities(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    z = x @ w + b
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, parts: int, degree: int = 10) -> dict | None:
    """Learns `parts` partitions of the rows; none where there are too few different rows to tell apart."""
    middle, scale = x.mean(axis=0), x.std()
    if len(x) < 2 * parts or not scale > 0:
        return None
    z = (x - middle) / scale
    w, b = learn(z, balanced(neighbour_graph(z, min(degree, len(z) - 1)), z, parts), parts)
    return {"middle": middle, "scale": scale, "w": w.astype(np.float32), "b": b.astype(np.float32)}


class Tree:
    """Classifiers by the name of the partition that each cuts; partitions without one are leaves."""

    def __init__(self):
        self.nodes: dict[str, dict] = {}

    def split(self, name: str, x: np.ndarray) -> np.ndarray:
        n = self.nodes[name]
        with np.errstate(over="ignore", invalid="ignore"):
            z = np.nan_to_num((x - n["middle"]) / n["scale"], nan=0.0, posinf=1e30, neginf=-1e30)
            return probabilities(np.clip(z, -1e30, 1e30), n["w"].astype(np.float64), n["b"].astype(np.float64))

    def leaf(self, root: str, x: np.ndarray) -> np.ndarray:
        """The most probable leaf of each row, level by level."""
        out, todo = np.empty(len(x), object), [(root, np.arange(len(x)))]
        while todo:
            name, rows = todo.pop()
            if name not in self.nodes:
                out[rows] = name
                continue
            kid = self.split(name, x[rows]).argmax(axis=1)
            todo += [(f"{name}.{k}", rows[kid == k]) for k in np.unique(kid)]
        return out

    def leaves(self, root: str, x: np.ndarray, least: float):
        """(row, leaf, probability) of all leaves of at least that probability, and of each row's most probable one."""
        rows, names, held = [], [], []
        todo = [(root, np.arange(len(x)), np.ones(len(x)), np.ones(len(x), bool))]
        while todo:
            name, at, p, first = todo.pop()
            if name not in self.nodes:
                rows.append(at)
                names += [name] * len(at)
                held.append(p)
                continue
            q = self.split(name, x[at])
            best = q.argmax(axis=1)
            for k in range(q.shape[1]):
                own = p * q[:, k]
                lead = first & (best == k)
                go = lead | (own >= least)
                if go.any():
                    todo.append((f"{name}.{k}", at[go], own[go], lead[go]))
        none = np.zeros(0)
        return np.concatenate(rows or [none]).astype(np.int64), np.array(names, object), np.concatenate(held or [none])


def asked_leaves(tree: Tree, root: str, x: np.ndarray, least: float, held: dict[str, int], enough: int) -> list[list[str]]:
    """Leaves that each row asks: those of at least that probability, and where these hold fewer than `enough` rows in all,
    the next most probable ones, until they do or no leaf is left."""
    out: list[list[str]] = [[] for _ in range(len(x))]
    for i, name in zip(*tree.leaves(root, x, least)[:2]):
        out[i].append(name)
    short = np.array([i for i, names in enumerate(out) if sum(held.get(n, 0) for n in names) < enough], np.int64)
    row, name, p = tree.leaves(root, x[short], 0.0) if len(short) else (short, short, short)
    for j in np.lexsort((name.astype(str), -p, row)) if len(short) else ():
        names = out[short[row[j]]]
        if name[j] not in names and held.get(name[j]) and sum(held.get(n, 0) for n in names) < enough:
            names.append(name[j])
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances row by row; where squares would leave the range of a double, of scaled rows."""
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        d = a - b
        s = (d * d).sum(axis=1)
        odd = ~np.isfinite(s) | (s < 1e-280)
        if odd.any():
            x, y = a[odd] / 4, b[odd] / 4
            d = np.abs(x - y)
            most = d.max(axis=1)
            unit = np.where(most > 0, most, 1.0)
            s[odd] = 0
            root = np.sqrt(s)
            root[odd] = np.sqrt(((d / unit[:, None]) ** 2).sum(axis=1)) * most * 4
            return root
        return np.sqrt(s)


def nearest(q: np.ndarray, q_row: np.ndarray, x: np.ndarray, x_id: np.ndarray, x_row: np.ndarray, k: int, step: int = 256, pairs: int = 1 << 18):
    """(query number, row number, distance): each query's k nearest rows, ties to the smaller id, never the query's own row.

    A first pass by dot products keeps all rows that could be among the k; distances are then taken anew from differences,
    `pairs` at a time.
    """
    unit = max(float(np.abs(q).max(initial=0)), float(np.abs(x).max(initial=0)), 1e-300)
    unit = 2.0 ** np.floor(np.log2(unit)) if not 1e-60 < unit < 1e60 else 1.0
    small, out = x / unit, []
    norm = (small * small).sum(axis=1)
    for a in range(0, len(q), step):
        s = q[a : a + step] / unit
        own = q_row[a : a + step][:, None] == x_row[None, :]
        d = (s * s).sum(axis=1)[:, None] + norm[None, :] - 2 * s @ small.T
        d[own] = np.inf
        size = (s * s).sum(axis=1)[:, None] + norm.max(initial=0)
        kth = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if d.shape[1] > k else np.full((len(s), 1), np.inf)
        i, j = np.nonzero((d <= kth + 1e-9 * size) & ~own)
        exact = np.concatenate([distances(q[a + i[c : c + pairs]], x[j[c : c + pairs]]) for c in range(0, len(i), pairs)] or [np.zeros(0)])
        order = np.lexsort((x_row[j], x_id[j], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        out.append((i[rank < k] + a, j[rank < k], exact[rank < k]))
    return tuple(np.concatenate([o[c] for o in out]) if out else np.zeros(0) for c in range(3))


def rows_of(t: pa.Table | pa.RecordBatch, name: str, n: int) -> np.ndarray:
    c = t.column(name)
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return c.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def grow(base: DataFrame, sizes: dict[str, int], leaf: int, fan: int, sample: int, most_bytes: int) -> Tree:
    """base (row, d, v); sizes: rows by length of the vectors, which name the roots. Partitions of over twice the `leaf` rows
    are cut until none is left, or what is left does not come apart."""
    tree, spark = Tree(), base.sparkSession
    sizes, done = {str(d): n for d, n in sizes.items()}, set()
    total = sum(n * int(d) * 4 for d, n in sizes.items())
    leaf = max(leaf, -(-leaf * total // max(1, most_bytes * leaf)))  # the tree has 4 bytes a component for each leaf
    while True:
        cut = {k: min(fan, max(-(-n // leaf), min(8, n // 200))) for k, n in sizes.items() if k not in done and (n > 2 * leaf or "." not in k)}
        cut = {k: p for k, p in cut.items() if p > 1}
        if not cut:
            return tree
        shared = spark.sparkContext.broadcast(tree)
        least = F.create_map(*[F.lit(y) for k in cut for y in (k, min(WIDE, int(WIDE * 1.1 * sample / sizes[k]) + 1))])

        def learned(t: pa.Table) -> pa.Table:
            name = t["leaf"][0].as_py()
            order = np.argsort(t["o"].to_numpy(), kind="stable")[:sample]
            model = fit(rows_of(t, "v", t.num_rows)[order], cut[name])
            return pa.table({"leaf": pa.array([name], pa.string()), "model": pa.array([pickle.dumps(model)], pa.binary())})

        now = base.withColumn("leaf", leaf_of(shared)).withColumn("o", F.pmod(F.xxhash64("row"), F.lit(WIDE)))
        models = now.where(F.col("o") < least[F.col("leaf")]).groupBy("leaf").applyInArrow(learned, "leaf string, model binary").collect()  # under most_bytes
        done |= set(cut)
        tree.nodes |= {r["leaf"]: m for r in models if (m := pickle.loads(r["model"])) is not None}
        shared = spark.sparkContext.broadcast(tree)
        new = {r["leaf"]: r["n"] for r in base.groupBy(leaf_of(shared).alias("leaf")).agg(F.count("*").alias("n")).collect()}
        # Where one part keeps nearly all rows, as they are much the same, it is not cut again.
        done |= {k for k, n in new.items() if n > 0.9 * sizes.get(k.rpartition(".")[0], 1 << 62)}
        sizes = new


def leaf_of(shared) -> Column:
    @pandas_udf("string")
    def run(d: pd.Series, v: pd.Series) -> pd.Series:
        out = np.empty(len(d), object)
        for size in d.unique():
            at = np.flatnonzero(d.to_numpy() == size)
            out[at] = shared.value.leaf(str(size), np.stack(v.to_numpy()[at]))
        return pd.Series(out)

    return run("d", "v")


def threshold(tree: Tree, base: DataFrame, sizes: dict[int, int], recall: float, k: int, sample: int) -> float:
    """The least probability of a leaf that is asked: with it, the leaves asked hold the share `recall` of the k nearest
    neighbours in a sample, of a fifth of the sample. Neighbours in a sample are further than in the table, so this errs
    on the safe side."""
    least = 1.0
    for d, n in sizes.items():
        if str(d) not in tree.nodes:
            continue
        some = base.where((F.col("d") == d) & (F.pmod(F.xxhash64(F.lit(1), F.col("row")), F.lit(WIDE)) < min(WIDE, int(WIDE * sample / n) + 1)))
        got = [r["v"] for r in some.select("v", "row").orderBy("row").limit(2 * sample).collect()]
        x = np.array(got, np.float64)
        if len(x) < 2:
            continue
        asks = np.arange(0, len(x), 5)
        i, j, _ = nearest(x[asks], asks, x, np.arange(len(x)), np.arange(len(x)), k)
        home = tree.leaf(str(d), x)
        row, name, p = tree.leaves(str(d), x[asks], 0.0)
        held = dict(zip(zip(row.tolist(), name.tolist()), p.tolist()))
        need = np.sort([held.get((a, home[b]), 0.0) for a, b in zip(i.tolist(), j.tolist())])
        if len(need):
            least = min(least, float(need[int((1 - recall) * len(need))]))
    return least


def search(vectors: DataFrame, asked: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, recall: float = 0.97, leaf: int = 2_000, fan: int = 32, sample: int = 6_000, block: int = 20_000, most_bytes: int = 256 << 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of which `asked` holds its k nearest found among all other rows.

    Each row is a query or a candidate of its own, also where ids repeat: rows of a query's id are among its candidates, but
    for the query itself, and a query id that comes twice has its ranks twice. Ties go to the smaller id. Vectors that are
    null, empty, zero, or hold null or non-finite components take no part, on either side, nor do rows without an id;
    vectors of another length have no distance and are searched among their like. An empty table gives an empty table. A query
    whose partitions hold fewer than k candidates, as those of vectors far out may, asks further ones until they do.

    recall: the share of true neighbours aimed at in the choice of partitions. leaf: rows of a partition, about; sample: the
    most rows that one classifier learns from; block: the most rows of a partition, or queries, that meet at once;
    most_bytes: of the tree of classifiers, beyond which partitions are larger instead.
    """
    v = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    ok = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.coalesce(asked, F.lit(False)).alias("asked")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ok)
    base = saved(clean.withColumn("row", F.monotonically_increasing_id()).withColumn("d", F.size("v")))  # numbered once and for all
    sizes = {r["d"]: r["n"] for r in base.groupBy("d").agg(F.count("*").alias("n")).collect()}
    tree = grow(base, sizes, leaf, fan, sample, most_bytes)
    least = threshold(tree, base, sizes, recall, k, sample)
    shared = vectors.sparkSession.sparkContext.broadcast(tree)
    renamed = [F.col(c).alias(c) for c in ("row", "id", "v")]  # as the two sides of a cogroup must not be one column
    dealt = saved(base.select("row", "id", "v", leaf_of(shared).alias("leaf")))
    held = {r["leaf"]: r["n"] for r in dealt.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row for each leaf of the tree

    @pandas_udf("array<string>")
    def routed(d: pd.Series, v: pd.Series) -> pd.Series:
        out = [[] for _ in range(len(d))]
        for size in d.unique():
            at = np.flatnonzero(d.to_numpy() == size)
            for i, names in zip(at, asked_leaves(shared.value, str(size), np.stack(v.to_numpy()[at]), least, held, k + 1)):
                out[i] = names
        return pd.Series(out)

    def blocks(df: DataFrame, name: str) -> DataFrame:
        return saved(df.groupBy("leaf").agg(F.ceil(F.count("*") / block).cast("int").alias(name)))  # a row for each leaf

    def part(row: Column, n: Column) -> Column:
        return F.pmod(F.xxhash64(row), n).cast("int")

    def each(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    sent = saved(base.where("asked").select(*renamed, F.explode(routed("d", "v")).alias("leaf")))
    counts = blocks(dealt, "n").join(blocks(sent, "m"), "leaf")
    left = sent.join(counts, "leaf").withColumn("y", part(F.col("row"), F.col("m"))).withColumn("x", each("n")).select("leaf", "x", "y", *renamed)
    right = dealt.join(counts, "leaf").withColumn("x", part(F.col("row"), F.col("n"))).withColumn("y", each("m")).select("leaf", "x", "y", "row", "id", "v")

    def rerank(a: pa.Table, b: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in FOUND.split(", ")]
        if not a.num_rows or not b.num_rows:
            return pa.table({c: pa.array([], pa.float64() if c == "score" else pa.int64()) for c in names})
        q_row, q_id, x_row, x_id = (t[c].to_numpy() for t in (a, b) for c in ("row", "id"))
        i, j, d = nearest(rows_of(a, "v", a.num_rows), q_row, rows_of(b, "v", b.num_rows), x_id, x_row, k)
        return pa.table(dict(zip(names, (q_row[i], q_id[i], x_row[j], x_id[j], d))))

    by = ("leaf", "x", "y")
    near = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(rerank, FOUND)
    best = Window.partitionBy("query").orderBy("score", "vec_id", "row")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
