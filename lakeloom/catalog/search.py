"""BM25 and tokens over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.catalog.base import Derived, Fixture, query, query_on
from lakeloom.functions import text as T
from lakeloom.operators import blockmax, bm25, growing
from lakeloom.operators.cut import own_folder, spread
from lakeloom.streaming import indexing

STOP = ", ".join(f"'{w}'" for w in "a about an and are as at be but by for from had has have in is it of on or that the this to was were with".split())
RAW = r"(SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')) AS w FROM documents)"


#: Word endings in their order, as regular expressions that are written anew here, with what a word then ends in.
ENDINGS = [
    ("(.+)ies", "y"), ("(.+)ves", "f"), ("(.+s)es", ""), ("(.+x)es", ""), ("(.+z)es", ""), ("(.*ch)es", ""), ("(.*sh)es", ""), ("(.*m)en", "an"), ("(.+[^aeiou])es", ""), ("(.{2,})s", ""), ("(.*)ying", "ie"), ("(.*ee)d", ""), ("(.{2,})ed", ""), ("(.{2,})ing", ""),
    ("(.{2,})ly", ""), ("(.{2,})er", ""), ("(.{2,})est", ""), ("(.{2,})ness", ""), ("(.*iz)ation", "e"), ("(.+)ition", "e"), ("(.{2,})ment", ""), ("(.+)ity", "y"), ("(.{2,})ive", ""), ("(.{2,})ic", ""), ("(.{2,})al", ""), ("(.{2,})ful", ""), ("(.{2,})less", ""),
    ("(.{2,})[ai]ble", ""), ("(.{2,})[ae]nt", ""),
]
AS_THEY_ARE = "agent apis urls ids stats docs apps logs jobs users admins settings get set let put use"


def stem_sql(w: str) -> str:
    kept = ", ".join(f"'{x}'" for x in AS_THEY_ARE.split())
    cases = [f"WHEN regexp_full_match({w}, '{p}') THEN regexp_extract({w}, '^{p}$', 1) || '{new}'" for p, new in ENDINGS]
    return f"CASE WHEN length({w}) < 3 OR {w} IN ({kept}) THEN {w} {' '.join(cases)} ELSE {w} END"


def terms_sql(stemmed: bool, table: str = RAW, key: str = "doc_id") -> str:
    term = stem_sql("w") if stemmed else "w"
    return f"(SELECT {key}, term FROM (SELECT {key}, {term} AS term FROM {table}) WHERE term NOT IN ({STOP}) AND length(term) BETWEEN 2 AND 30)"


def index_sql(stemmed: bool) -> str:
    return f"""
tf AS (SELECT doc_id, term, count(*) AS tf FROM {terms_sql(stemmed)} GROUP BY ALL),
dl AS (SELECT d.doc_id, coalesce(sum(tf), 0)::BIGINT AS len FROM documents d LEFT JOIN tf USING (doc_id) GROUP BY d.doc_id),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
stats AS (SELECT count(*) AS n, avg(len) AS avg_len FROM dl)"""


SCORE = "ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))"
QUERY = "worthless trash and the disgusting licensed things"
ASKED = terms_sql(True, r"(SELECT 0 AS q, unnest(regexp_extract_all(lower('" + QUERY + r"'), '[\p{L}\p{N}_]+')) AS w)", "q")


@query(f"""
WITH {index_sql(True)},
hits AS (
  SELECT doc_id, sum({SCORE}) AS score FROM tf JOIN {ASKED} asked USING (term) JOIN df USING (term) JOIN dl USING (doc_id), stats GROUP BY doc_id)
SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank
FROM hits ORDER BY score DESC, doc_id LIMIT 20""")
def bm25_topk(spark, read):
    """A query's best documents, over stemmed tokens."""
    asked = spark.createDataFrame([(0, QUERY)], "query_id int, query string")
    index = bm25.build_for(asked, "query_id", "query", spread(read("documents")), "doc_id", "text")
    found = bm25.search(index, asked, top_k=20, min_score=1e-12)
    return found.select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


BENCHMARK_HITS = f"""{index_sql(False)},
asked AS (SELECT q, term, count(*) AS times FROM {terms_sql(False, "(SELECT item_id AS q, unnest(regexp_extract_all(lower(text), '[" + chr(92) + "p{L}" + chr(92) + "p{N}_]+')) AS w FROM benchmark)", "q")} GROUP BY ALL),
hits AS (
  SELECT q, doc_id, sum(times * {SCORE}) AS score FROM tf JOIN asked USING (term) JOIN df USING (term) JOIN dl USING (doc_id), stats GROUP BY q, doc_id)"""


def benchmark_index(read):
    return bm25.build_for(read("benchmark"), "item_id", "text", spread(read("documents")), "doc_id", "text", bm25.Params(stemmed=False))


@query(f"""
WITH {BENCHMARK_HITS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, doc_id) AS r FROM hits)
SELECT doc_id, max(round(score, 6)) AS score FROM ranked WHERE r <= 100 GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 100""")
def bm25_multi_query_max(spark, read):
    """Benchmark items as queries: each one's top 100, then each document's best score, then the top 100."""
    top = blockmax.topk(benchmark_index(read), read("benchmark"), 100, id_col="item_id", text_col="text", digits=6)
    return bm25.best_over_queries(top, 100).select(F.col("doc").alias("doc_id"), "score")


@query(f"""
WITH {BENCHMARK_HITS},
ranked AS (SELECT q AS item_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, doc_id)::INT AS rank FROM hits)
SELECT item_id, doc_id, score, rank FROM ranked WHERE rank <= 10""")
def bm25_per_query(spark, read):
    """Each benchmark item's ten best documents."""
    top = blockmax.topk(benchmark_index(read), read("benchmark"), 10, id_col="item_id", text_col="text", digits=6)
    return top.select(F.col("query_id").alias("item_id"), F.col("doc").alias("doc_id"), "score", "rank")


@query(f"""
WITH {index_sql(False)}
SELECT term, df, sum(tf)::BIGINT AS cf, round(ln((any_value(n) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1::DOUBLE), 6) AS idf
FROM df JOIN tf USING (term), stats GROUP BY term, df""")
def term_stats(spark, read):
    """Document and corpus frequency and idf of each term."""
    return bm25.term_stats(bm25.build(spread(read("documents")), "doc_id", "text", bm25.Params(stemmed=False))).withColumn("idf", F.round("idf", 6))


@query(f"""
WITH {index_sql(False)}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term)::INT AS rank FROM tf)
SELECT doc_id, term, tf, rank FROM r WHERE rank <= 10""")
def doc_top_terms(spark, read):
    """Each document's ten most frequent terms."""
    return bm25.top_terms_of(spread(read("documents")), "doc_id", "text", bm25.Params(stemmed=False)).select(F.col("doc").alias("doc_id"), "term", "tf", "rank")


@query(f"""
WITH {index_sql(False)}
SELECT source, count(*) AS n_docs, sum(len)::BIGINT AS n_tokens, round(avg(len), 6) AS avg_len, count(*) FILTER (len = 0) AS n_empty
FROM dl JOIN documents USING (doc_id) GROUP BY source""")
def corpus_stats_by_source(spark, read):
    """Documents, tokens and mean length by source; empty documents count."""
    docs = spread(read("documents"))
    dl = bm25.build(docs, "doc_id", "text", bm25.Params(stemmed=False)).dl
    return dl.join(docs.select("source", F.col("doc_id").alias("doc")), "doc").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("len").alias("n_tokens"), F.round(F.avg("len"), 6).alias("avg_len"), F.count_if(F.col("len") == 0).alias("n_empty"))


@query(f"""
WITH own AS (SELECT doc_id, term, count(*) AS tf FROM {terms_sql(True)} GROUP BY ALL),
hits AS (SELECT doc_id, sum(ln(4::DOUBLE / 3) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE)) AS s FROM own JOIN {ASKED} asked USING (term) GROUP BY doc_id)
SELECT doc_id, round(coalesce(s, 0), 6) AS score FROM documents LEFT JOIN hits USING (doc_id)""")
def single_doc_similarity(spark, read):
    """BM25 of a query against each document as its own corpus."""
    return spread(read("documents")).select("doc_id", F.round(bm25.one_doc_similarity(QUERY, F.col("text")), 6).alias("score"))


@query(f"""
SELECT stem, count(DISTINCT w) AS n_words, count(*) AS n FROM (SELECT w, {stem_sql("w")} AS stem FROM {RAW}) GROUP BY stem""")
def stemmed_vocab(spark, read):
    """Stems with how many words share them."""
    words = spread(read("documents")).select(F.explode(T.words(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    stems = words.select(F.explode(F.transform(F.array("w"), T.stem)).alias("stem"), "n")  # each word once
    return stems.groupBy("stem").agg(F.count("*").alias("n_words"), F.sum("n").alias("n"))


ITEM_TEXTS = Derived("SELECT item_id::VARCHAR AS doc, text FROM benchmark", lambda read: read("benchmark").select(F.col("item_id").cast("string").alias("doc"), "text"))
PAGE_TITLES = Derived(
    "SELECT page_id::INT AS q, regexp_extract(html, '<title>([^<]*)</title>', 1) AS query FROM pages",
    lambda read: read("pages").select(F.col("page_id").cast("int").alias("q"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("query")),
)
TOY = Fixture("doc string, text string", [
    ("a", "Machine learning teaches machines to learn from data"), ("b", "A recipe for bread with flour and water"), ("c", "Deep learning is learning with many layers"), ("d", ""), ("e", "The weather of the week"), ("f", "Data about machine parts"), ("g", None), ("h", "Bread and data"),
])
TOY_QUERIES = Fixture("q int, query string", [(1, "machine learning"), (2, "nothing of that kind"), (3, "data data bread"), (4, "")])


@query_on(rf"""
WITH t AS (SELECT doc, w FROM (SELECT doc, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+')) AS w FROM <<toy>>) WHERE length(w) BETWEEN 2 AND 30 AND w NOT IN ({STOP})),
tf AS (SELECT doc, w, count(*) AS tf FROM t GROUP BY ALL),
dl AS (SELECT d.doc, coalesce(sum(tf), 0) AS len FROM <<toy>> d LEFT JOIN tf USING (doc) GROUP BY d.doc),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
st AS (SELECT count(*) AS n, avg(len) AS avg_len FROM dl),
asked AS (SELECT q, w, count(*) AS times FROM (SELECT q, unnest(regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}_]+')) AS w FROM <<asked>>) GROUP BY ALL),
s AS (SELECT q, doc, sum(times * {SCORE}) AS score FROM tf JOIN asked USING (w) JOIN df USING (w) JOIN dl USING (doc), st GROUP BY q, doc),
every AS (SELECT q, doc, round(coalesce(score, 0), 6) AS score, row_number() OVER (PARTITION BY q ORDER BY coalesce(score, 0) DESC, doc)::INT AS rank FROM (SELECT q FROM <<asked>>) JOIN dl ON true LEFT JOIN s USING (q, doc))
SELECT q, doc, score::DOUBLE AS score, rank FROM every WHERE rank <= 5""", toy=(ITEM_TEXTS, TOY), asked=(PAGE_TITLES, TOY_QUERIES))
def bm25_zero_fill(spark, toy, asked):
    """Several queries over a small corpus: documents without a term fill up the five that are asked for."""
    index = bm25.build(toy, "doc", "text", bm25.Params(stemmed=False))
    found = bm25.search(index, asked, top_k=5, min_score=0.0, id_col="q", text_col="query")
    return found.select(F.col("query_id").alias("q"), "doc", F.round("score", 6).alias("score"), "rank")


TURN_WORDS = Derived(
    r"SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')) AS w FROM conversations",
    lambda read: read("conversations").select(F.explode(T.words(F.col("text"))).alias("w")).distinct(),
)
STEMS = Fixture("w string", [(w,) for w in "cities wolves passes boxes buzzes catches wishes women gases cats agents tying agreed feed walked running quickly faster fastest happiness organization composition development ability city creative heroic ivy pity nation addition organisation agreement element ly lying tie children women menu axes buses quizzes dishes riches knives ties eyes bees going being seed bleed red bed removal helpful hopeless readable visible assistant dependent apis urls agent set use es is ing bus sses ches shes men ies ed a to".split()])


@query_on(f"SELECT w, {stem_sql('w')} AS stem FROM <<words>>", words=(TURN_WORDS, STEMS))
def stem_rules(spark, words):
    """Each suffix rule, words that are left alone, words too short for a rule."""
    return words.select("w", T.stem(F.col("w")).alias("stem"))


@query(f"""
SELECT doc_id, count(*) AS n_tokens, count(DISTINCT term) AS n_terms FROM {terms_sql(False)} GROUP BY doc_id""")
def token_counts(spark, read):
    """Tokens and distinct terms of each document, unstemmed; documents without any are left out."""
    t = spread(read("documents")).select("doc_id", F.explode(T.tokens(F.col("text"), stemmed=False)).alias("t"))
    return t.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.count_distinct("t").alias("n_terms"))


QUESTIONS = Derived("SELECT item_id::INT AS id, text FROM benchmark", lambda read: read("benchmark").select(F.col("item_id").cast("int").alias("id"), "text"))
TEXTS = Fixture("id int, text string", [(1, "How to configure the Hooks API?"), (2, "创建技能 with the CLI"), (3, "创建第一个技能"), (4, "The the THE"), (5, ""), (6, "foo-bar foo_bar, 42 times; don't stop."), (7, "技能技能技能技能技能技能技能技能技能a"), (8, "   "), (9, "it's an API of the api")])
TECH = ", ".join(f"'{w}'" for w in "api cli sdk http https jwt oauth ssh webhook middleware endpoint token auth config deploy hooks async sync json xml yaml yml".split())


@query_on(rf"""
WITH w AS (SELECT id, i, ws[i] AS k FROM (SELECT id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS ws FROM <<texts>>))),
f AS (SELECT id, k, min(i) AS i FROM w WHERE regexp_matches(k, '{T.CJK_RE}') OR k IN ({TECH}) OR k NOT IN ({STOP}) GROUP BY id, k)
SELECT t.id, coalesce(string_agg(k, ' ' ORDER BY i), '') AS keywords FROM <<texts>> t LEFT JOIN f USING (id) GROUP BY t.id""", texts=(QUESTIONS, TEXTS))
def query_keywords(spark, texts):
    """Keywords of queries in their order."""
    return texts.select("id", F.array_join(T.keywords(F.col("text")), " ").alias("keywords"))


@query_on(rf"""
WITH c AS (SELECT id, text, trim(regexp_replace(regexp_replace(text, '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g')) AS c FROM <<texts>>)
SELECT id,
  (CASE WHEN c = '' THEN 0 WHEN regexp_matches(c, '{T.CJK_RE}') THEN len(regexp_extract_all(c, '{T.CJK_RE}')) + len(list_filter(string_split(c, ' '), lambda x: regexp_full_match(x, '[a-zA-Z]+'))) ELSE len(string_split(c, ' ')) END)::INT AS n_words,
  CASE WHEN length(trim(text)) > 0 AND (length(text) - length(regexp_replace(text, '{T.CJK_RE}', '', 'g')))::DOUBLE / length(trim(text)) >= 0.9 THEN 'zh' ELSE 'en' END AS lang
FROM c""", texts=(QUESTIONS, TEXTS))
def mixed_words_and_language(spark, texts):
    """Word counts and language of mixed texts."""
    return texts.select("id", T.count_words(F.col("text")).alias("n_words"), T.language(F.col("text")).alias("lang"))


@query(rf"""
SELECT source, count(*) FILTER (lang2 = 'en') AS n_en, sum(n)::BIGINT AS n_words FROM (
  SELECT source, 'en' AS lang2, CASE WHEN c = '' THEN 0 ELSE len(string_split(c, ' ')) END AS n FROM (
    SELECT source, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g')) AS c FROM documents)) GROUP BY source""")
def language_by_source(spark, read):
    """Language and word counts of the documents by source."""
    d = read("documents").select("source", T.language(F.coalesce("text", F.lit(""))).alias("l"), T.count_words(F.col("text")).alias("n"))
    return d.groupBy("source").agg(F.count_if(F.col("l") == "en").alias("n_en"), F.sum("n").alias("n_words"))


NOUNS, VERBS = ["hooks", "技能"], ["create", "use", "创建"]


@query_on(rf"""
SELECT id, CASE WHEN text = '' OR contains(lower(text), 'hook') OR contains(lower(text), '技能') THEN text
  ELSE trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\bcreate\b', '', 'gi'), '\buse\b', '', 'gi'), '创建', '', 'g'), '\s+', ' ', 'g')) END AS text,
  coalesce(contains(lower(text), 'hook') OR contains(lower(text), '技能'), false) AS has_noun,
  trim(regexp_replace(regexp_replace(regexp_replace(trim(text), 'how to', '', 'gi'), 'the', '', 'gi'), '\s+', ' ', 'g')) AS filtered
FROM (SELECT * FROM <<texts>> UNION ALL SELECT 10, 'Create and use agents' UNION ALL SELECT 11, 'reuse 创建 agents')""", texts=(QUESTIONS, TEXTS))
def rerank_texts(spark, texts):
    """Verbs go from texts without a noun; words are filtered from queries."""
    t = texts.unionByName(spark.createDataFrame([(10, "Create and use agents"), (11, "reuse 创建 agents")], "id int, text string"))
    return t.select("id", T.for_rerank(F.col("text"), NOUNS, VERBS).alias("text"), T.has_noun(F.col("text"), NOUNS).alias("has_noun"), T.without_keywords(F.col("text"), ["how to", "the"]).alias("filtered"))


#: All texts that land, by a key that tells their tables apart.
LANDING = {"documents": ("concat('d', doc_id)", "text"), "benchmark": ("concat('b', item_id)", "text"), "conversations": ("concat('c', conv_id, '.', turn)", "text")}
LANDED = " UNION ALL ".join(f"SELECT {key} AS key, {text} AS text FROM {table}" for table, (key, text) in LANDING.items())


@query(f"""
WITH landed AS (SELECT key, max(text) AS text FROM ({LANDED}) WHERE key IS NOT NULL GROUP BY key),
tf AS (SELECT key, term, count(*) AS tf FROM {terms_sql(False, r"(SELECT key, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')) AS w FROM landed)", "key")} GROUP BY ALL),
st AS (SELECT count(*) AS n FROM landed)
SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, round(ln((any_value(n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1::DOUBLE), 6) AS idf FROM tf, st GROUP BY term""")
def streamed_term_stats(spark, read):
    """Terms of an index that three tables are streamed into, one after the other."""
    folder, p = own_folder(spark, "index"), bm25.Params(stemmed=False)
    for table, (key, text) in LANDING.items():
        indexing.run(read.stream(table).selectExpr(f"{key} AS key", f"{text} AS text"), f"{folder}/index", f"{folder}/{table}", "key", "text", p).awaitTermination()
    return bm25.term_stats(growing.index(spark, f"{folder}/index", p)).withColumn("idf", F.round("idf", 6))
