"""Vectors, reranking, fusion, titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.catalog.base import Derived, Fixture, query, query_on
from lakeloom.functions import similarity, vectors
from lakeloom.operators import layers
from lakeloom.operators import ranking as R
from lakeloom.operators import retrieval
from lakeloom.operators.cut import saved

#: The queries: every hundredth vector by id, against all.
Q = "vec_id % 100 = 0"
SIMS = f"""sims AS (
  SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS sim
  FROM embeddings q, embeddings c WHERE q.{Q})"""


def asked(read):
    e = read("embeddings")
    return e.where(Q).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v")), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


@query(f"WITH {SIMS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id)::INT AS rank FROM sims) SELECT * FROM r WHERE rank <= 10")
def cosine_topk(spark, read):
    """Each query's ten most similar vectors."""
    return R.nearest(*asked(read), 10)


@query(f"WITH {SIMS} SELECT id, max(sim) AS sim FROM sims GROUP BY id")
def rerank_max(spark, read):
    """Each vector's highest similarity over the queries."""
    return R.most_similar(*asked(read), digits=6)


@query(f"""
WITH {SIMS}, b AS (SELECT id, max(sim) AS sim FROM sims GROUP BY id),
c AS (SELECT sim AS cut FROM b ORDER BY sim DESC LIMIT 1 OFFSET (SELECT least(floor(count(*) * 0.6)::BIGINT, count(*) - 1) FROM b))
SELECT id, sim FROM b, c WHERE sim >= cut""")
def quantile_cut(spark, read):
    """The best three fifths."""
    return R.quantile_cut(saved(R.most_similar(*asked(read), digits=6)), "sim", 0.6)


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm, round((embedding::DOUBLE[])[1] / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS first FROM embeddings")
def unit_vectors(spark, read):
    """Norms, and first components after scaling."""
    return read("embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"), F.round(F.get(vectors.unit(F.col("embedding")), F.lit(0)), 6).alias("first"))


#: Documents as hits of a search: sources are doc sets, languages pages; headings are numbered and often the same but for that.
DOC_HITS = Derived(
    """SELECT source AS doc_set, lang AS page, '## ' || doc_id % 9 || '. ' || regexp_extract(coalesce(text, ''), '[A-Za-z]+') AS heading, CASE WHEN n_chars > 50 THEN n_chars % 100 / 100.0::DOUBLE END AS bm25,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'at ' || doc_id END AS ctx, CASE WHEN doc_id % 2 = 0 THEN 'FALLBACK_1' ELSE 'FALLBACK_2' END AS source, (CASE WHEN doc_id % 2 = 0 THEN -doc_id ELSE doc_id + 2 END)::INT AS pos FROM documents WHERE doc_id IS NOT NULL""",
    lambda read: read("documents").where("doc_id IS NOT NULL").select(F.col("source").alias("doc_set"), F.col("lang").alias("page"), F.concat(F.lit("## "), F.expr("doc_id % 9"), F.lit(". "), F.regexp_extract(F.coalesce("text", F.lit("")), "[A-Za-z]+", 0)).alias("heading"), F.expr("CASE WHEN n_chars > 50 THEN double(n_chars % 100) / 100.0D END").alias("bm25"),
        F.expr("if(doc_id % 3 = 0, '', concat('at ', doc_id))").alias("ctx"), F.expr("if(doc_id % 2 = 0, 'FALLBACK_1', 'FALLBACK_2')").alias("source"), F.expr("int(if(doc_id % 2 = 0, -doc_id, doc_id + 2))").alias("pos")),
)
HITS = Fixture("doc_set string, page string, heading string, bm25 double, ctx string, source string, pos int", [
    ("a@1", "p", "## 1. Set up", 0.5, "", "FALLBACK_1", 1), ("a@1", "p", "Set up", 0.9, "", "FALLBACK_1", 2), ("a@1", "p", "2. Set up", 0.1, "some context", "FALLBACK_2", 3), ("a@1", "p", "Other", None, "", "FALLBACK_1", 4),
    ("a@1", "p", "", 0.2, "", "FALLBACK_1", 5), ("a@1", "p", "# ", 0.3, "", "FALLBACK_1", 6), ("a@1", "q", "Set up", 0.75, "x", "FALLBACK_2", 7), ("b@1", "p", "Set up", 0.0, None, "FALLBACK_1", 8), ("a@1", "q", "III. Set up", 0.75, "", "FALLBACK_1", 9),
])
NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace(trim(heading), '^#{1,6}\s+', ''), '^[0-9]+(\.[0-9]+)*(\.|\s)\s*', ''), '(?i)^(I{1,3}|IV|V|VI{0,3}|IX|X)\.\s*', ''))"
MERGED = f"""m AS (
  SELECT doc_set, page, heading, bm25, coalesce(nullif(ctx, ''), fctx, '') AS ctx, CASE WHEN coalesce(ctx, '') = '' AND fctx IS NOT NULL AND fsrc = 'FALLBACK_2' THEN fsrc ELSE source END AS source, pos FROM (
    SELECT *, row_number() OVER w AS n, first_value(nullif(ctx, '') IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fctx,
      first_value(CASE WHEN ctx <> '' THEN source END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fsrc
    FROM (SELECT *, CASE WHEN {NORMAL} IN ('', '#') THEN 'no' || pos ELSE {NORMAL} END AS key FROM <<hits>>)
    WINDOW w AS (PARTITION BY doc_set, page, key ORDER BY coalesce(bm25, 0) DESC, pos)) WHERE n = 1)"""


@query_on(f"WITH {MERGED} SELECT * FROM m", hits=(DOC_HITS, HITS))
def fusion_headings(spark, hits):
    """Headings of several searches, equal ones merged."""
    return R.merged_headings(hits)


@query_on(f"WITH {MERGED} SELECT doc_set, page, count(*) AS heading_count, count(*) FILTER (bm25 >= 0.7) AS precision_count, max(coalesce(bm25, 0)) AS score, bool_or(coalesce(bm25 >= 0.7, false)) AS is_precision FROM m GROUP BY doc_set, page", hits=(DOC_HITS, HITS))
def fusion_merge(spark, hits):
    """Pages of several searches."""
    return R.merged_pages(R.merged_headings(hits))


@query_on(f"""
WITH s AS (SELECT *, CASE WHEN pos <= 2 THEN 0 ELSE 1 END AS side FROM <<hits>>),
k AS (SELECT *, CASE WHEN {NORMAL} IN ('', '#') THEN 'no' || pos ELSE {NORMAL} END AS key FROM s),
w AS (SELECT *, row_number() OVER p AS n, first_value(nullif(ctx, '') IGNORE NULLS) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS c,
  max(CASE WHEN source = 'FALLBACK_2' THEN source END) OVER (PARTITION BY doc_set, page, key) AS o FROM k WINDOW p AS (PARTITION BY doc_set, page, key ORDER BY side, pos))
SELECT doc_set, page, heading, bm25, coalesce(c, '') AS ctx, coalesce(o, source) AS source, pos FROM w WHERE n = 1""", hits=(DOC_HITS, HITS))
def fusion_combine(spark, hits):
    """A search's headings joined by those of a fallback."""
    h = hits
    return R.combined(h.where("pos <= 2"), h.where("pos > 2"))


#: Turns as headings that were reranked, conversations as their pages.
TURN_SCORES = Derived(
    "SELECT conv_id::VARCHAR AS page, CASE WHEN conv_id % 11 > 0 THEN conv_id % 11 / 10.0::DOUBLE END AS page_sim, turn::INT AS pos, role || ' ' || turn AS heading, length(text) % 9 / 10.0::DOUBLE AS heading_sim FROM conversations",
    lambda read: read("conversations").select(F.col("conv_id").cast("string").alias("page"), F.expr("if(conv_id % 11 > 0, double(conv_id % 11) / 10.0D, null)").alias("page_sim"), F.col("turn").cast("int").alias("pos"), F.concat("role", F.lit(" "), "turn").alias("heading"), F.expr("double(length(text) % 9) / 10.0D").alias("heading_sim")),
)
RERANKED = Fixture("page string, page_sim double, pos int, heading string, heading_sim double", [("p", 0.8, 1, "a", 0.1), ("p", 0.8, 2, "b", 0.9), ("q", 0.3, 1, "c", 0.6), ("q", 0.3, 2, "d", 0.4), ("r", None, 1, "e", 0.7), ("s", 0.2, 1, "f", 0.2), ("s", 0.2, 2, "g", None)])


@query_on(f"""
SELECT DISTINCT page, page_sim, NULL::VARCHAR AS heading, NULL::DOUBLE AS heading_sim FROM <<reranked>> WHERE page_sim >= 0.5
UNION ALL SELECT page, page_sim, heading, heading_sim FROM <<reranked>> WHERE coalesce(page_sim < 0.5, true) AND heading_sim >= 0.5""", reranked=(TURN_SCORES, RERANKED))
def rerank_filter(spark, reranked):
    """What stays after reranking."""
    return R.after_rerank(reranked, 0.5)


TITLES = "(SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)"


def titles(read):
    return read("pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query(f"""
WITH t AS (SELECT page_id, title, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS l FROM {TITLES}),
m AS (SELECT page_id, title, CASE WHEN l = 'the' THEN 'exact' WHEN starts_with(l, 'the') THEN 'prefix' WHEN contains(l, 'the') THEN 'partial' END AS match_type, CASE WHEN l = 'the' THEN 1.0 WHEN starts_with(l, 'the') THEN 0.9 WHEN contains(l, 'the') THEN 0.7 END::DOUBLE AS similarity FROM t)
SELECT * FROM m WHERE match_type IS NOT NULL""")
def title_layers(spark, read):
    """Titles by layers of match."""
    return R.title_layers(titles(read), "the", k=None)


TITLE_PAIRS = Derived(
    f"SELECT title AS a, replace(substr(text, 1, 60), chr(10), ' ') AS b FROM {TITLES} JOIN benchmark ON item_id = page_id",
    lambda read: titles(read).join(read("benchmark").select(F.col("item_id").alias("page_id"), F.replace(F.substring("text", 1, 60), F.lit("\n"), F.lit(" ")).alias("b")), "page_id").select(F.col("title").alias("a"), "b"),
)
PAIRS = Fixture("a string, b string", [("Skill", "skill"), ("hello", "hallo"), ("abc", "xyz"), ("", "x"), ("agent skills", "skills of agents"), (None, "x")])


#: The longest block that both have, the first in a, then in b; then what is left of it and right of it, in turn.
BLOCK = "list_max(flatten(list_transform(range(1, length(a) + 1), lambda i: list_transform(range(1, length(a) - i + 2), lambda n: CASE WHEN contains(b, substr(a, i, n)) THEN {'n': n, 'i': -i} END))))"
BLOCKS = f"""seg(k, a, b) AS (
  SELECT k, a, b FROM pairs WHERE a <> '' AND b <> ''
  UNION ALL
  SELECT k, unnest([substr(a, 1, -m.i - 1), substr(a, -m.i + m.n)]) AS a, unnest([substr(b, 1, strpos(b, substr(a, -m.i, m.n)) - 1), substr(b, strpos(b, substr(a, -m.i, m.n)) + m.n)]) AS b
  FROM (SELECT *, {BLOCK} AS m FROM seg WHERE a <> '' AND b <> '') WHERE m IS NOT NULL),
matched AS (SELECT k, sum(m.n) AS n FROM (SELECT k, {BLOCK} AS m FROM seg WHERE a <> '' AND b <> '') GROUP BY k)"""


@query(f"""
WITH RECURSIVE titles AS (SELECT page_id AS k, title, lower(trim(title)) AS l FROM {TITLES}),
pairs AS (SELECT k, 'thing of the thention' AS a, l AS b FROM titles),
{BLOCKS},
r AS (SELECT titles.k AS page_id, title, CASE WHEN l = '' THEN 0 ELSE 2 * coalesce(n, 0) / (21 + length(l))::DOUBLE END AS similarity FROM titles LEFT JOIN matched USING (k))
SELECT page_id, title, 'fuzzy' AS match_type, round(similarity, 9)::DOUBLE AS similarity FROM r WHERE similarity >= 0.5""")
def fuzzy_titles(spark, read):
    """Titles like a query by matching blocks, where no plainer layer takes any."""
    return R.title_layers(titles(read), "thing of the thention", fuzzy=0.5, k=None).withColumn("similarity", F.round("similarity", 9))


@query(f"""
WITH RECURSIVE q AS (SELECT DISTINCT substr(title, 4) AS asked FROM {TITLES} WHERE page_id % 100 = 0 AND trim(substr(title, 4)) <> ''),
t AS (SELECT DISTINCT title FROM {TITLES}),
met AS (SELECT row_number() OVER () AS k, asked, title FROM q, t),
pairs AS (SELECT k, lower(trim(asked)) AS a, lower(trim(title)) AS b FROM met),
{BLOCKS},
r AS (SELECT asked, title, CASE WHEN pairs.a = '' OR pairs.b = '' THEN 0 ELSE 2 * coalesce(n, 0) / (length(pairs.a) + length(pairs.b))::DOUBLE END AS s FROM met JOIN pairs USING (k) LEFT JOIN matched USING (k)),
o AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY s DESC, title) AS i FROM r WHERE s >= 0.6)
SELECT asked, title AS page, round(s, 9)::DOUBLE AS similarity FROM o WHERE i = 1""")
def title_lookup(spark, read):
    """The page that each of a set of mangled titles means: those of every hundredth page, without their first letters."""
    from lakeloom.operators import retrieval

    t = titles(read)
    asked = t.where("page_id % 100 = 0").select(F.substr("title", F.lit(4)).alias("title"))
    pages = t.select(F.lit("pages").alias("doc_set"), "title", F.lit("").alias("content"))
    found = retrieval.extract(pages, asked, mode="fuzzy", modes=("fuzzy",))
    return found.select(F.col("title").alias("asked"), "page", F.round("similarity", 9).alias("similarity"))


@query_on(f"""
WITH RECURSIVE raw AS (SELECT *, row_number() OVER () AS k FROM <<pairs_of>>),
pairs AS (SELECT k, lower(trim(coalesce(a, ''))) AS a, lower(trim(coalesce(b, ''))) AS b FROM raw),
{BLOCKS}
SELECT raw.a, raw.b, CASE WHEN pairs.a = '' OR pairs.b = '' THEN 0 ELSE 2 * coalesce(n, 0) / (length(pairs.a) + length(pairs.b))::DOUBLE END::DOUBLE AS ratio
FROM raw JOIN pairs USING (k) LEFT JOIN matched USING (k)""", pairs_of=(TITLE_PAIRS, PAIRS))
def title_ratio(spark, pairs_of):
    """Matching-block ratios."""
    return pairs_of.select("a", "b", similarity.ratio(F.col("a"), F.col("b")).alias("ratio"))


#: Pages as matches of a query, by what their ids leave over.
PAGE_MATCHES = Derived(
    f"SELECT title, page_id % 101 / 100.0::DOUBLE AS similarity, CASE page_id % 3 WHEN 0 THEN 'prefix' WHEN 1 THEN 'toc_section' ELSE 'content_preview' END AS match_type, CASE page_id % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'toc' ELSE 'preview' END AS source, (page_id % 5)::INT AS n_sections FROM {TITLES}",
    lambda read: titles(read).select("title", F.expr("double(page_id % 101) / 100.0D").alias("similarity"), F.expr("CASE page_id % 3 WHEN 0 THEN 'prefix' WHEN 1 THEN 'toc_section' ELSE 'content_preview' END").alias("match_type"), F.expr("CASE page_id % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'toc' ELSE 'preview' END").alias("source"), F.expr("int(page_id % 5)").alias("n_sections")),
)
MATCHES = Fixture("title string, similarity double, match_type string, source string, n_sections int", [("Agent skills", 0.9, "prefix", "title", 0), ("Agent skills", 1.0, "toc_section", "toc", 2), ("Skills", 0.7, "toc_section", "toc", 5), ("Hooks", 0.5, "content_preview", "preview", 0), ("Intro", 0.45, "content_preview", "preview", 0)])
#: Pages as matches of benchmark items, ten for each.
ITEM_MATCHES = Derived(
    f"SELECT item_id::INT AS query_id, array_to_string(string_split(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')), ' ')[1:6], ' ') AS query, m.* EXCLUDE page_id FROM (SELECT title, page_id, page_id % 101 / 100.0::DOUBLE AS similarity, CASE page_id % 3 WHEN 0 THEN 'prefix' WHEN 1 THEN 'toc_section' ELSE 'content_preview' END AS match_type, CASE page_id % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'toc' ELSE 'preview' END AS source, (page_id % 5)::INT AS n_sections FROM {TITLES}) m JOIN benchmark ON item_id = page_id // 10 WHERE trim(text) <> ''",
    lambda read: titles(read).join(read("benchmark").where("trim(text) <> ''").select(F.col("item_id").cast("int").alias("query_id"), F.substring_index(F.trim(F.regexp_replace("text", r"[ \t\r\n]+", " ")), " ", 6).alias("query")), F.expr("query_id = page_id div 10"))
    .select("query_id", "query", "title", F.expr("double(page_id % 101) / 100.0D").alias("similarity"), F.expr("CASE page_id % 3 WHEN 0 THEN 'prefix' WHEN 1 THEN 'toc_section' ELSE 'content_preview' END").alias("match_type"), F.expr("CASE page_id % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'toc' ELSE 'preview' END").alias("source"), F.expr("int(page_id % 5)").alias("n_sections")),
)
ASKED_MATCHES = Fixture("query_id int, query string, title string, similarity double, match_type string, source string, n_sections int", [(q, text, *m) for q, text in ((1, "agent skills"), (2, "Hooks hooks intro")) for m in MATCHES.rows])
WORDS = "list_distinct(list_filter(string_split(lower(query), ' '), lambda x: x <> ''))"
FINAL = f"""f AS (
  SELECT query_id, title, match_type, source, least(1.0, similarity * 0.6 + w * 0.2 + 0.1 * len(list_filter({WORDS}, lambda x: list_contains(string_split(lower(title), ' '), x))) / greatest(1, len({WORDS})) + least(0.15, n_sections * 0.05)) AS s
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, title ORDER BY w DESC, similarity DESC, match_type) AS n FROM (SELECT *, CASE source WHEN 'title' THEN 1.0 WHEN 'toc' THEN 0.95 WHEN 'preview' THEN 0.8 ELSE 0.5 END AS w FROM <<found>>)) WHERE n = 1)"""


def matches(rows):
    return rows.withColumn("sections", F.array_repeat(F.lit("s"), F.col("n_sections"))).drop("n_sections")


@query_on(f"""
WITH {FINAL} SELECT query_id, title, source, match_type, round(CASE WHEN row_number() OVER (PARTITION BY query_id, source ORDER BY s DESC, title) = 1 AND count(*) OVER (PARTITION BY query_id) > 1 THEN least(1.0, s + 0.1) ELSE s END, 6)::DOUBLE AS similarity,
  row_number() OVER (PARTITION BY query_id ORDER BY s DESC, title)::INT AS rank FROM f""", found=(ITEM_MATCHES, ASKED_MATCHES))
def reflective_rerank(spark, found):
    """For each query one row a title, composite scores, a boost for each source's first."""
    rows = matches(found).withColumns({"doc_set": F.lit("pages"), "preview": F.lit(None).cast("string")})
    r = layers.rerank(rows.drop("query"), found.select("query_id", "query").distinct())
    return r.select("query_id", "title", "source", "match_type", F.round("similarity", 6).alias("similarity"), "rank")


QUALITY = """
SELECT grp, n AS count, top AS max_similarity, round(mean, 6) AS avg_similarity, sources AS source_diversity, kinds AS match_type_diversity,
  n >= 3 AND top >= 0.7 AND sources >= 1 AS satisfactory, CASE WHEN n >= 3 AND top >= 0.7 THEN NULL WHEN top < 0.5 THEN 'lower_threshold' WHEN n < 3 THEN 'expand_search' END AS suggestion
FROM (SELECT grp, count(*) AS n, max(similarity) AS top, avg(similarity) AS mean, count(DISTINCT source) AS sources, count(DISTINCT match_type) AS kinds FROM ({0}) GROUP BY grp)"""
GROUPS = {"all": "true", "titles": "source = 'title'", "previews": "source = 'preview'", "low": "similarity < 0.5"}


@query_on(QUALITY.format(" UNION ALL ".join(f"SELECT '{g}' AS grp, * FROM <<found>> WHERE {w}" for g, w in GROUPS.items())), found=(PAGE_MATCHES, MATCHES))
def match_quality(spark, found):
    """Measures of several results, and what to do about those that do not satisfy."""
    out = None
    for g, w in GROUPS.items():
        q = R.quality(matches(found).where(w)).select(F.lit(g).alias("grp"), "*").withColumn("avg_similarity", F.round("avg_similarity", 6))
        out = q if out is None else out.unionByName(q)
    return out


@query_on(f"SELECT title, round(CASE WHEN max(similarity) OVER () > 0 THEN 0.3 + similarity / max(similarity) OVER () * 0.4 ELSE 0.3 END, 6)::DOUBLE AS score, round(greatest(0, similarity - 0.1), 2)::DOUBLE AS relaxed FROM <<found>>", found=(PAGE_MATCHES, MATCHES))
def normalised_scores(spark, found):
    """Scores by the share of the best, and relaxed thresholds."""
    return R.preview_scores(matches(found), "similarity", "score").select("title", F.round("score", 6).alias("score"), R.relaxed(F.col("similarity")).alias("relaxed"))


#: Properties of events as answers: fenced, with a comma too many, with single quotes.
EVENT_ANSWERS = Derived(
    "SELECT event_id::INT AS id, CASE event_id % 4 WHEN 0 THEN 'so: ```json' || chr(10) || props || chr(10) || '``` .' WHEN 1 THEN 'x ' || regexp_replace(props, '[}]$', ',}') || ' y' WHEN 2 THEN replace(props, '\"', chr(39)) ELSE 'none' END AS raw FROM events",
    lambda read: read("events").select(F.col("event_id").cast("int").alias("id"), F.expr("CASE event_id % 4 WHEN 0 THEN concat('so: ```json\\n', props, '\\n``` .') WHEN 1 THEN concat('x ', regexp_replace(props, '[}]$', ',}'), ' y') WHEN 2 THEN replace(props, '\"', char(39)) ELSE 'none' END").alias("raw")),
)
RAW = Fixture("id int, raw string", [(1, 'text ```json\n{"a": 1, "b": [1, 2]}\n``` more'), (2, 'x {"a": 1,} y'), (3, "{'a': 'q'}"), (4, "no json"), (5, "{broken"), (6, "{a: 2}")])


@query_on(r"""
WITH a AS (SELECT id, CASE WHEN contains(raw, '```') THEN regexp_extract(raw, '(?s)```(json)?\s*(.*?)```', 2) ELSE raw END AS t FROM <<answers>>),
b AS (SELECT id, nullif(regexp_extract(t, '(?s)\{.*\}'), '') AS t FROM a),
c AS (SELECT id, t, regexp_replace(t, ',\s*([}\]])', '\1', 'g') AS t1 FROM b),
d AS (SELECT *, regexp_replace(t1, '([{,]\s*)([A-Za-z_]\w*)\s*:', '\1"\2":', 'g') AS t2 FROM c),
e AS (SELECT *, replace(t2, chr(39), '"') AS t3 FROM d)
SELECT id, CASE WHEN json_valid(t) THEN json(t)::VARCHAR WHEN json_valid(t1) THEN json(t1)::VARCHAR WHEN json_valid(t2) THEN json(t2)::VARCHAR WHEN json_valid(t3) THEN json(t3)::VARCHAR END AS json FROM e""", answers=(EVENT_ANSWERS, RAW))
def json_repair(spark, answers):
    """JSON out of answers."""
    return answers.select("id", similarity.extract_json(F.col("raw")).alias("json"))


#: Titles of every hundredth page, as they are, in capitals, without their last and without their first letters.
MANGLED = Derived(
    f"SELECT DISTINCT CASE k WHEN 0 THEN title WHEN 1 THEN upper(title) WHEN 2 THEN substr(title, 1, 30) ELSE substr(title, 4) END AS title FROM {TITLES}, (SELECT unnest(range(4)) AS k) WHERE page_id % 100 = 0",
    lambda read: titles(read).where("page_id % 100 = 0").select(F.explode(F.array("title", F.upper("title"), F.substring("title", 1, 30), F.substr("title", F.lit(4)))).alias("title")).distinct(),
)
TITLED = Derived(
    "SELECT DISTINCT regexp_extract(url, '^[^:]+://([^/?#]*)', 1) AS doc_set, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, '' AS content FROM pages",
    lambda read: read("pages").select(F.regexp_extract("url", "^[^:]+://([^/?#]*)", 1).alias("doc_set"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.lit("").alias("content")).distinct(),
)
WANTED = Fixture("title string", [("Guide",), ("  guide ",), ("kills",), ("Agent skils",), ("nothing like it at all",), (" ",), ("Deploy  ",), ("GUIDE",)])
PAGES = Fixture("doc_set string, title string, content string", [("b@1", "Guide", "second"), ("a@1", "Guide", "first"), ("a@1", "guide", "lower"), ("a@1", "Agent skills", "skills"), ("a@1", "Skills", "short"), ("a@1", "Deploy", "ship")])


@query_on(f"""
WITH RECURSIVE w AS (SELECT DISTINCT title FROM <<wanted>> WHERE trim(title) <> ''),
p AS (SELECT * FROM <<pages>>),
every AS (SELECT w.title AS asked, p.doc_set, p.title AS page, p.content, row_number() OVER () AS k FROM w, p),
pairs AS (SELECT k, lower(trim(asked)) AS a, lower(trim(page)) AS b FROM every),
{BLOCKS},
modes AS (
  SELECT asked, doc_set, page, content, 'exact' AS mode, 0 AS r, 1.0::DOUBLE AS s FROM every WHERE trim(asked) = trim(page)
  UNION ALL SELECT asked, doc_set, page, content, 'case_insensitive', 1, 1.0 FROM every WHERE lower(trim(asked)) = lower(trim(page))
  UNION ALL SELECT asked, doc_set, page, content, 'partial', 2, length(trim(asked)) / length(trim(page))::DOUBLE FROM every WHERE contains(lower(trim(page)), lower(trim(asked)))
  UNION ALL SELECT asked, doc_set, page, content, 'fuzzy', 3, 2 * n / (length(trim(asked)) + length(trim(page)))::DOUBLE FROM every JOIN matched USING (k) WHERE 2 * n / (length(trim(asked)) + length(trim(page)))::DOUBLE >= 0.6)
SELECT asked AS title, doc_set, page, mode, round(s, 9)::DOUBLE AS similarity, content FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY r, s DESC, doc_set, page) AS n FROM modes) WHERE n = 1""", wanted=(MANGLED, WANTED), pages=(TITLED, PAGES))
def title_extract(spark, wanted, pages):
    """Pages by their titles, several at once, by the first mode that finds one."""
    return retrieval.extract(pages, wanted).withColumn("similarity", F.round("similarity", 9))


@query_on(f"SELECT heading, heading_sim, page, pos FROM (SELECT h.heading, h.heading_sim, p.page, p.pos, row_number() OVER (PARTITION BY h.heading, h.heading_sim ORDER BY p.pos, p.page) AS n FROM <<reranked>> h JOIN <<reranked>> p USING (heading) WHERE h.heading_sim >= 0.5) WHERE n = 1", reranked=(TURN_SCORES, RERANKED))
def heading_pages(spark, reranked):
    """Headings that were reranked, each with the first page that has one of the same text."""
    h = reranked
    return R.first_pages(h.where("heading_sim >= 0.5").select("heading", "heading_sim").distinct(), h.select("pos", "page", "heading"))
