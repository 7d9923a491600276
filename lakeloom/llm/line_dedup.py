"""Line dedup, with DataFrame functions only: lines are exploded, their keys hashed to 128 bits, documents counted per
hash, lines over the threshold dropped except in the smallest document that holds them, and the rest joined by position.

Only hashes and positions are shuffled by key. A sum for each key and task comes first, so a line that a third of all
documents share costs one row per task; its lines are then dealt over as many tasks as there are shuffle partitions by a
salt, which only keys with over 1/1,000 of the shared lines have, so there are 1,000 such keys at most and they are
broadcast. Texts are shuffled once, by document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import LOWER, UPPER, fold_ascii, free, parts, saved, table

BLANKS = " \t\n\x0b\x0c\r"


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """The input's rows and columns, with kept_text, n_lines (before dropping) and n_dropped; columns of these names are replaced.

    A null or empty text is one empty line. Keys are lines without blanks at both ends, A-Z lower-cased; keys under
    `min_chars` code points always stay. Rows without an id are kept whole and count for no key. Rows that repeat an id
    are parts of one document. An empty table gives an empty table.
    """
    i, row, pos, text, h1, h2, first, last, n, salt, away = free([*docs.columns, "kept_text", "n_lines", "n_dropped"], "id", "row", "pos", "line", "h1", "h2", "first", "last", "n", "salt", "gone")
    line = F.coalesce(F.col(text_col), F.lit(""))
    own = F.xxhash64(F.col(text_col))
    bare = F.btrim(F.col(text), F.lit(BLANKS))
    occ = (
        docs.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias(i), own.alias(row), F.posexplode(F.split(line, "\n")).alias(pos, text))
        .withColumn(text, bare)
        .where(F.length(text) >= min_chars)  # folding keeps the length, so only lines that stay are folded
        .withColumn(text, fold_ascii(F.col(text)))
        .select(i, row, pos, F.xxhash64(text).alias(h1), F.xxhash64(F.lit(1), F.col(text)).alias(h2))
    )
    by_key = occ.groupBy(h1, h2)
    if min_docs <= 2:
        shared = by_key.agg(F.min(i).alias(first), F.max(i).alias(last), F.count("*").alias(n))
        shared = shared.where(F.col(first) < F.col(last)) if min_docs == 2 else shared
    else:
        shared = by_key.agg(F.min(i).alias(first), F.count_distinct(i).alias(last), F.count("*").alias(n)).where(F.col(last) >= min_docs)
    shared = saved(shared.select(h1, h2, first, n))
    least = (shared.agg(F.sum(n)).first()[0] or 0) / 1000
    salts = F.lit(parts(docs.sparkSession))
    hot = F.broadcast(shared.where(F.col(n) > least).select(h1, h2, salts.alias(salt)))  # under 1,000 rows
    dealt = shared.withColumn(salt, F.explode(F.sequence(F.lit(0), F.when(F.col(n) > least, salts - 1).otherwise(0)))).drop(n)
    occ = occ.join(hot, [h1, h2], "left").withColumn(salt, F.coalesce(F.pmod(F.xxhash64(i, pos), F.col(salt)).cast("int"), F.lit(0)))
    gone = occ.join(dealt, [h1, h2, salt]).where(F.col(i) > F.col(first)).groupBy(i, row).agg(F.collect_set(pos).alias(away))
    out = docs.withColumns({i: F.col(id_col), row: own}).join(gone, [i, row], "left")
    split, count = F.split(line, "\n"), F.size(F.split(line, "\n"))
    stay = F.array_except(F.sequence(F.lit(0), count - 1), F.col(away))
    kept = F.when(F.col(away).isNull(), line).otherwise(F.array_join(F.transform(stay, lambda k: F.get(split, k)), "\n"))
    return out.withColumns({"kept_text": kept, "n_lines": count.cast("long"), "n_dropped": F.coalesce(F.size(away), F.lit(0)).cast("long")}).drop(i, row, away)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = f"""
WITH lines AS (
  SELECT doc_id, i, ls[i] AS line,
         translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
shared AS (
  SELECT key, min(doc_id) AS first_id FROM lines WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT l.doc_id, l.i, l.line, coalesce(l.doc_id > s.first_id, false) AS gone
  FROM lines l LEFT JOIN shared s ON l.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
