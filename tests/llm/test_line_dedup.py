import hashlib
import re
from collections import defaultdict

from cases import none, odd, same_columns

from lakeloom.llm import line_dedup


def brute(rows, min_chars=10, min_docs=2):
    fold = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in re.sub(r"^[ \t-\r]+|[ \t-\r]+$", "", s))
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(fold(line)) >= min_chars:
                held[fold(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [s for s in lines if i is None or len(held[fold(s)]) < min_docs or min(held[fold(s)]) == i]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in df.collect()), key=repr)


def test_odd_rows(spark):
    docs = odd(spark)
    out = line_dedup.dedup_lines(docs)
    same_columns(out, docs, ["kept_text", "n_lines", "n_dropped"])
    assert got(out) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_more_documents(spark):
    docs = odd(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got(line_dedup.dedup_lines(docs, min_docs=3)) == brute(rows, min_docs=3)
    assert got(line_dedup.dedup_lines(docs, min_chars=1)) == brute(rows, min_chars=1)


def test_empty_table(spark):
    assert line_dedup.dedup_lines(none(spark)).collect() == []


def test_query(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    want = {i: (n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute(rows)}
    assert {r[0]: tuple(r[1:]) for r in line_dedup.query(spark, data).collect()} == want


def test_many_lines_in_one_document(spark):
    shared = [f"shared line number {i}" for i in range(20_000)]
    docs = spark.createDataFrame([(1, "\n".join(shared)), (2, "\n".join(x for s in shared for x in (s, "own " + s[:6])))], "doc_id long, text string")
    r = {x["doc_id"]: x for x in line_dedup.dedup_lines(docs, min_chars=12).collect()}
    assert r[2]["n_dropped"] == 20_000 and r[2]["n_lines"] == 40_000 and r[1]["n_dropped"] == 0


def test_no_python_in_the_plan(spark, data):
    plan = line_dedup.query(spark, data)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_hot_lines_are_salted(spark):
    """A line that most documents share is told right when it is dealt over many tasks, and joined there."""
    rows = [(i, f"the line that all have\nown line of document {i}\n" + ("another that many have" if i % 3 else "")) for i in range(3_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(line_dedup.dedup_lines(docs)) == brute(rows)
    assert "salt" in line_dedup.dedup_lines(docs)._jdf.queryExecution().toString()
