"""Operators on lines, headings and budgets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.catalog.base import Derived, Fixture, query, query_on
from lakeloom.functions import text as T
from lakeloom.operators import lines as L

DOC1 = """# Title page
Intro text here.

## 1. Install: https://h.example.com/i
Step one.
```
# not a heading in code
run it
```
### Details
More detail about hooks.

## [Use](https://h.example.com/u)
Use text.
---
## Next  steps
After the end."""
DOC2 = """No heading at all
second line
## Only
third"""
ROWS = [("a@1", "one", i, s) for i, s in enumerate(DOC1.split("\n"), 1)] + [("a@1", "two", i, s) for i, s in enumerate(DOC2.split("\n"), 1)]
LINES = Fixture("doc_set string, title string, line_no int, line string", ROWS)
TITLE = "trim(regexp_extract(html, '<title>([^<]*)</title>', 1))"
#: Turns of conversations as lines of a page: system turns are its titles, those of the
#: user numbered sections, long answers end it.
TURN_LINES = Derived(
    """SELECT 'conversations' AS doc_set, conv_id::VARCHAR AS title, turn::INT + 1 AS line_no, min(CASE role WHEN 'system' THEN '# ' WHEN 'user' THEN '## ' || turn || '. ' ELSE CASE WHEN length(text) > 300 THEN 'See also: ' ELSE '' END END || trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'))) AS line
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL GROUP BY conv_id, turn""",
    lambda read: read("conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL").groupBy("conv_id", "turn")
    .agg(F.min(F.concat(F.when(F.col("role") == "system", "# ").when(F.col("role") == "user", F.concat(F.lit("## "), F.col("turn"), F.lit(". "))).when(F.length("text") > 300, "See also: ").otherwise(""), F.trim(F.regexp_replace("text", r"[ \t\r\n]+", " ")))).alias("line"))
    .select(F.lit("conversations").alias("doc_set"), F.col("conv_id").cast("string").alias("title"), (F.col("turn").cast("int") + 1).alias("line_no"), "line"),
)
#: What each conversation's first user turn asks, without its number.
TURN_WANTED = Derived(
    f"SELECT doc_set, title, regexp_replace(arg_min(line, line_no), '^## [0-9]+[.] ', '') AS heading FROM {TURN_LINES.sql} WHERE starts_with(line, '## ') GROUP BY doc_set, title",
    lambda read: TURN_LINES.df(read).where(F.col("line").startswith("## ")).groupBy("doc_set", "title").agg(F.regexp_replace(F.min_by("line", "line_no"), "^## [0-9]+[.] ", "").alias("heading")),
)
H = r"^(#{1,6})\s+(.+)$"
CLEAN = rf"trim(regexp_replace(regexp_replace(regexp_extract(trim(line), '{H}', 2), '\[([^\[\]]+)\]\([^)]+\)', '\1', 'g'), '：https://[^\s]+|: https://[^\s]+', '', 'g'))"


@query_on(rf"""
SELECT title, line_no, last_value(h IGNORE NULLS) OVER (PARTITION BY doc_set, title ORDER BY line_no ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS heading
FROM (SELECT *, CASE WHEN line_no > 1 AND regexp_matches(trim(line), '{H}') AND {CLEAN} <> '' THEN regexp_extract(trim(line), '{H}', 1) || ' ' || {CLEAN} END AS h FROM <<lines>>)""", lines=(TURN_LINES, LINES))
def heading_context(spark, lines):
    """The heading above each line."""
    return L.with_heading_above(lines, ["doc_set", "title"]).select("title", "line_no", "heading")


@query_on(rf"""
SELECT title, line_no,
  coalesce(max(m) OVER (PARTITION BY doc_set, title ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, 1) AS section_from,
  coalesce(min(m) OVER (PARTITION BY doc_set, title ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - 1, max(line_no) OVER (PARTITION BY doc_set, title)) AS section_to
FROM (SELECT *, CASE WHEN regexp_matches(trim(line), '{H}') THEN line_no END AS m FROM <<lines>>)""", lines=(TURN_LINES, LINES))
def section_bounds(spark, lines):
    """The section around each line."""
    return L.with_section_bounds(lines, ["doc_set", "title"]).select("title", "line_no", "section_from", "section_to")


WANTED = Fixture("doc_set string, title string, heading string", [("a@1", "one", "install"), ("a@1", "one", "1. Details"), ("a@1", "two", "Only"), ("a@1", "two", "Missing")])
CORE = r"lower(trim(regexp_replace(regexp_replace(regexp_replace(trim({0}), '^[0-9.]+[)\-]?\s*', ''), '^[0-9.]+\s*', ''), '[：:]\s*https?://\S*$', '')))"


@query_on(rf"""
WITH h AS (SELECT *, length(regexp_extract(line, '^(#+)\s+', 1)) AS level, {CORE.format(r"regexp_replace(line, '^#+\s+', '')")} AS core FROM <<lines>> WHERE regexp_matches(line, '^(#+)\s+')),
s AS (SELECT h.doc_set, h.title, heading, min(line_no) AS a, arg_min(level, line_no) AS lvl FROM h JOIN <<wanted>> w ON h.doc_set = w.doc_set AND h.title = w.title AND core = {CORE.format("heading")} GROUP BY ALL),
e AS (SELECT s.doc_set, s.title, heading, a, min(h.line_no) AS z FROM s LEFT JOIN h ON s.doc_set = h.doc_set AND s.title = h.title AND h.line_no > a AND h.level <= lvl GROUP BY ALL)
SELECT l.title, heading, line_no, line FROM <<lines>> l JOIN e ON l.doc_set = e.doc_set AND l.title = e.title WHERE line_no >= a AND line_no < coalesce(z, 1000000)""", lines=(TURN_LINES, LINES), wanted=(TURN_WANTED, WANTED))
def section_extract(spark, lines, wanted):
    """Sections by their headings."""
    lines = lines.withColumnRenamed("title", "page")
    wanted = wanted.withColumnRenamed("title", "page").withColumnRenamed("heading", "title")
    return L.sections(lines, ["doc_set", "page"], wanted).select(F.col("page").alias("title"), F.col("title").alias("heading"), "line_no", "line")


@query("""
WITH t AS (SELECT DISTINCT conv_id, turn, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS level FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)
SELECT conv_id, turn, level, (SELECT min(u.turn) FROM t u WHERE u.conv_id = t.conv_id AND u.turn > t.turn AND u.level <= t.level) AS section_end FROM t""")
def turn_sections(spark, read):
    """Where the section that each turn of a conversation opens ends."""
    level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3)
    turns = read("conversations").where("conv_id is not null and turn is not null").select("conv_id", "turn", level.alias("level")).distinct()
    return L.with_section_end(turns, ["conv_id"], no="turn").select("conv_id", "turn", "level", "section_end")


@query("""
WITH l AS (SELECT conv_id, turn AS line_no, CASE role WHEN 'system' THEN '# ' WHEN 'user' THEN '## ' ELSE '' END || regexp_replace(text, '\\s+', ' ', 'g') AS line, role FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL),
a AS (SELECT conv_id, min(line_no) AS a FROM l WHERE starts_with(line, '## ') GROUP BY conv_id),
z AS (SELECT a.conv_id, a, min(line_no) AS z FROM a LEFT JOIN l ON l.conv_id = a.conv_id AND line_no > a AND regexp_matches(line, '^#+ ') AND length(regexp_extract(line, '^#+')) <= 2 GROUP BY ALL)
SELECT l.conv_id, line_no, length(line) AS n_chars FROM l JOIN z ON l.conv_id = z.conv_id WHERE line_no >= a AND (z IS NULL OR line_no < z)""")
def first_user_section(spark, read):
    """The turns of the section that a conversation's first user turn opens, asked for by its own words."""
    mark = F.when(F.col("role") == "system", "# ").when(F.col("role") == "user", "## ").otherwise("")
    rows = read("conversations").where("conv_id is not null and turn is not null and text is not null")
    rows = rows.select("conv_id", F.col("turn").alias("line_no"), F.concat(mark, F.regexp_replace("text", r"\s+", " ")).alias("line"))
    first = rows.where(F.col("line").startswith("## ")).groupBy("conv_id").agg(F.min(F.struct("line_no", "line")).alias("f"))
    wanted = first.select("conv_id", F.regexp_replace("f.line", r"^#+\s+", "").alias("title"))
    return L.sections(rows, ["conv_id"], wanted).select("conv_id", "line_no", F.length("line").alias("n_chars"))


#: Turns as entries of a table of contents: long answers stand below short ones.
TURN_LEVELS = Derived(
    "SELECT conv_id::VARCHAR AS page, turn::INT AS pos, max(CASE WHEN role = 'system' THEN 1 WHEN role = 'user' THEN 2 WHEN length(text) < 200 THEN 3 ELSE 4 END)::INT AS level FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn",
    lambda read: read("conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy(F.col("conv_id").cast("string").alias("page"), F.col("turn").cast("int").alias("pos"))
    .agg(F.max(F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).when(F.length("text") < 200, 3).otherwise(4)).alias("level")),
)
ANCHORS = Fixture("page string, pos int, level int", [("p", i, v) for i, v in enumerate([1, 2, 2, 3, 4, 2, 1, 3, 3, 2, 4, 1])] + [("q", 0, 3), ("q", 1, 1), ("q", 2, 3), ("q", 3, 4)])


@query_on(f"""
WITH a AS (SELECT *, sum((level = 1)::INT) OVER (PARTITION BY page ORDER BY pos) AS c1 FROM <<anchors>>),
b AS (SELECT *, sum((level = 2)::INT) OVER (PARTITION BY page, c1 ORDER BY pos) AS c2 FROM a),
c AS (SELECT *, sum((level = 3)::INT) OVER (PARTITION BY page, c1, c2 ORDER BY pos) AS c3 FROM b),
d AS (SELECT *, sum((level = 4)::INT) OVER (PARTITION BY page, c1, c2, c3 ORDER BY pos) AS c4 FROM c)
SELECT page, pos, c1::VARCHAR || CASE WHEN level >= 2 THEN '.' || c2 ELSE '' END || CASE WHEN level >= 3 THEN '.' || c3 ELSE '' END || CASE WHEN level >= 4 THEN '.' || c4 ELSE '' END AS number FROM d""", anchors=(TURN_LEVELS, ANCHORS))
def hierarchy_numbers(spark, anchors):
    """Numbers of a table of contents."""
    return L.numbered(anchors, ["page"]).select("page", "pos", "number")


@query_on(rf"""
SELECT title, line_no, line FROM (SELECT *, min(CASE WHEN regexp_matches(line, '^(##+\s*)?([0-9]+\.\s*)?(Next\s+steps|See\s+also|third)') THEN line_no END) OVER (PARTITION BY doc_set, title) AS z FROM <<lines>>)
WHERE z IS NULL OR line_no < z""", lines=(TURN_LINES, LINES))
def end_marker_cut(spark, lines):
    """Lines before an end mark."""
    return L.cut_at_mark(lines, ["doc_set", "title"], ["Next steps", "See also", "third"]).select("title", "line_no", "line")


def titled(read):
    return read("pages").select("page_id", "url", T.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("t"), F.regexp_extract("url", "^[^:]+://([^/?#]*)", 1).alias("page"))


#: The pages of a host as its table of contents: levels by the parts of their paths, links after the text. Pages of one URL stand
#: in the order of their ids; the SQL leaves it open, and DuckDB orders them anew in each run.
PAGE_TOC = Derived(
    f"""SELECT page, row_number() OVER (PARTITION BY page ORDER BY url)::INT AS line_no, repeat('#', least(6, len(string_split(url, '/')) - 2)::INT) || ' ' || page_id || '. ' || t || '：' || url AS line
  FROM (SELECT page_id, url, {TITLE} AS t, regexp_extract(url, '^[^:]+://([^/?#]*)', 1) AS page FROM pages)""",
    lambda read: titled(read).select("page", F.row_number().over(Window.partitionBy("page").orderBy("url", "page_id")).alias("line_no"), F.concat(F.repeat(F.lit("#"), F.least(F.lit(6), F.size(F.split("url", "/")) - 2)), F.lit(" "), "page_id", F.lit(". "), "t", F.lit("："), "url").alias("line")),
)
TOC = Fixture("page string, line_no int, line string", [
    ("p", 1, "# Guide"), ("p", 2, "## 1. Overview：https://h.example.com/p#overview"), ("p", 3, "### 1.1. Set up: https://h.example.com/p#set-up"), ("p", 4, "text"), ("p", 5, "#### [Deep link](https://h.example.com/p#deep)"),
    ("q", 1, "  ## Create Your First Skill!  "), ("q", 2, "####### seven"), ("q", 3, "##no space"), ("q", 4, "## Über uns – FAQ"),
])
FULL = f"trim(regexp_extract(trim(line), '{H}', 2))"
ANC = r"：https://[^\s]+|: https://[^\s]+"


@query_on(rf"""
SELECT page, line_no, length(regexp_extract(trim(line), '{H}', 1))::INT AS level,
  CASE WHEN link <> '' THEN link ELSE t END AS text, nullif(regexp_replace(regexp_extract(f, '{ANC}'), '^(：|: )', ''), '') AS anchor,
  trim(regexp_replace(regexp_replace(lower(f), '[^\p{{L}}\p{{N}}_\s-]', '', 'g'), '[-\s]+', '-', 'g'), '-') AS slug
FROM (SELECT *, regexp_extract(t, '\[([^\]]+)\]\([^)]+\)', 1) AS link FROM (SELECT *, {FULL} AS f, trim(regexp_replace({FULL}, '{ANC}', '', 'g')) AS t FROM <<toc>> WHERE regexp_matches(trim(line), '{H}')))""", toc=(PAGE_TOC, TOC))
def toc_parse(spark, toc):
    """Headings of a table of contents with their links."""
    return L.toc(toc, sql=True).select("page", "line_no", "level", "text", "anchor", "slug")


@query_on(rf"""
SELECT page, line_no FROM (SELECT *, min(lv) OVER (PARTITION BY page) AS m FROM (SELECT page, line_no, length(regexp_extract(trim(line), '{H}', 1)) AS lv FROM <<toc>> WHERE regexp_matches(trim(line), '{H}'))) WHERE lv = m""", toc=(PAGE_TOC, TOC))
def lowest_level(spark, toc):
    """Each page's headings nearest the top."""
    return L.lowest_level_only(L.toc(toc, sql=True), ["page"]).select("page", "line_no")


PAGE_HEADINGS = Derived(
    f"SELECT page_id::INT AS id, repeat('#', (page_id % 4)::INT) || CASE WHEN page_id % 4 = 0 THEN '' ELSE ' ' END || page_id || CASE page_id % 3 WHEN 0 THEN '. ' WHEN 1 THEN '.1 ' ELSE ') ' END || '[' || t || '](' || url || ')：' || url AS heading FROM (SELECT page_id, url, {TITLE} AS t FROM pages)",
    lambda read: titled(read).select(F.col("page_id").cast("int").alias("id"), F.concat(F.expr("repeat('#', int(page_id % 4))"), F.expr("if(page_id % 4 = 0, '', ' ')"), "page_id", F.expr("CASE page_id % 3 WHEN 0 THEN '. ' WHEN 1 THEN '.1 ' ELSE ') ' END"), F.lit("["), "t", F.lit("]("), "url", F.lit(")："), "url").alias("heading")),
)
HEADINGS = Fixture("id int, heading string", list(enumerate(["## 1.2. Set up", "1. Overview", "1.2 Sub", "（三）标题", "① circled", "IV. Fourth", "iii. third", "# 3.10. skill：https://h.example.com/t#skill", "2) Item", "Plain", "", "[Link](https://h.example.com)", "###   Wide", "V.I.P. guests", "10 things"])))


@query_on(rf"""
SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(heading), '^#{{1,6}}\s+', ''), '^[0-9]+(\.[0-9]+)*(\.|\s)\s*', ''), '^（[一二三四五六七八九十]+）\s*', ''), '^[①②③④⑤⑥⑦⑧⑨⑩]\s*', ''), '(?i)^(I{{1,3}}|IV|V|VI{{0,3}}|IX|X)\.\s*', '')) AS normal,
  trim(regexp_replace(regexp_replace(regexp_replace(trim(heading), '^[0-9.]+[)\-]?\s*', ''), '^[0-9.]+\s*', ''), '[：:]\s*https?://\S*$', '')) AS core,
  greatest(1, length(regexp_extract(trim(heading), '^(#{{1,6}})\s+', 1)))::INT AS level,
  trim(regexp_replace(regexp_replace(heading, '\[([^\[\]]+)\]\([^)]+\)', '\1', 'g'), '{ANC}', '', 'g')) AS bare FROM <<headings>>""", headings=(PAGE_HEADINGS, HEADINGS))
def heading_forms(spark, headings):
    """Normal text, core title, level and text without URL of headings."""
    h = F.col("heading")
    return headings.select("id", T.normal_heading(h).alias("normal"), T.core_title(h).alias("core"), T.heading_level(h).alias("level"), T.strip_heading_url(h).alias("bare"))


@query("""
SELECT source, doc_id, lines, total_lines, total_lines > 2100 AS over FROM (
  SELECT *, sum(lines) OVER (PARTITION BY source)::BIGINT AS total_lines FROM (SELECT source, doc_id, len(string_split(coalesce(text, ''), chr(10)))::INT AS lines FROM documents))""")
def line_budget(spark, read):
    """Lines of each document and of its source, and whether that is over the threshold."""
    return L.line_counts(read("documents").select("source", "doc_id", "text"), ["source"], "text").select("source", "doc_id", "lines", "total_lines", "over")


ORDER_ITEMS = Derived(
    "SELECT l_orderkey::VARCHAR AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INT AS id, l_discount AS score, floor(l_quantity / 8)::INT AS n FROM lineitem",
    lambda read: read("lineitem").select(F.col("l_orderkey").cast("string").alias("page"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).alias("id"), F.col("l_discount").alias("score"), F.floor(F.col("l_quantity") / 8).cast("int").alias("n")),
)
ITEMS = Fixture("page string, id int, score double, n int", [("p", 1, 0.9, 5), ("p", 2, 0.8, 7), ("p", 3, 0.7, 3), ("p", 4, 0.6, 2), ("q", 1, 0.5, 50), ("q", 2, 0.4, 1), ("r", 1, 0.3, 10)])


@query_on(f"""
WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, id) AS k FROM <<items>>),
f AS (
  SELECT page, id, k, n::BIGINT AS used, true AS taken FROM o WHERE k = 1
  UNION ALL SELECT o.page, o.id, o.k, f.used + CASE WHEN f.used + o.n <= 10 THEN o.n ELSE 0 END, f.used + o.n <= 10 FROM f JOIN o ON o.page = f.page AND o.k = f.k + 1)
SELECT page, id, taken FROM f""", items=(ORDER_ITEMS, ITEMS))
def greedy_pack(spark, items):
    """Sections taken in the order of their scores while they fit into ten lines."""
    return L.packed(items, ["page"], [F.desc("score"), "id"], "n", 10).select("page", "id", "taken")


@query(f"""
WITH RECURSIVE o AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) AS k, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents WHERE source IS NOT NULL),
f AS (
  SELECT source, doc_id, k, n::BIGINT AS used, true AS taken FROM o WHERE k = 1
  UNION ALL SELECT o.source, o.doc_id, o.k, f.used + CASE WHEN f.used + o.n <= 500 THEN o.n ELSE 0 END, f.used + o.n <= 500 FROM f JOIN o ON o.source = f.source AND o.k = f.k + 1)
SELECT doc_id, taken FROM f""")
def budget_by_source(spark, read):
    """Documents of each source taken while they fit into 500 lines, in the order of a hash."""
    d = read("documents").where(F.col("source").isNotNull()).select("doc_id", "source", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n"), F.md5(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    return L.packed(d, ["source"], ["h", "doc_id"], "n", 500).select("doc_id", "taken")


#: A fold over lines: what is kept, n lines of it, whether in a fence (f), whether the last line kept is blank (b).
TRUNCATED = r"""
WITH RECURSIVE l AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL),
w AS (
  SELECT doc_id, s, 1 AS i, ''::VARCHAR AS o, 0 AS n, false AS f, false AS b FROM l WHERE len(s) > 20
  UNION ALL
  SELECT doc_id, s, i + 1, CASE WHEN keep THEN o || CASE WHEN n > 0 THEN chr(10) ELSE '' END || s[i] ELSE o END, n + keep::INT, CASE WHEN fence THEN NOT f ELSE f END, CASE WHEN keep THEN blank ELSE b END
  FROM (SELECT *, fence OR f OR starts_with(t, '#') OR (n < 20 AND NOT (blank AND n > 0 AND b)) AS keep
        FROM (SELECT *, starts_with(t, '```') AS fence, t = '' AS blank FROM (SELECT *, regexp_replace(s[i], '^\s+|\s+$', '', 'g') AS t FROM w WHERE i <= len(s)))))
SELECT doc_id, text FROM documents WHERE text IS NULL OR len(string_split(text, chr(10))) <= 20
UNION ALL SELECT doc_id, CASE WHEN n < len(s) THEN o || chr(10) || chr(10) || chr(10) || '... (' || (len(s) - n) || ' more lines truncated)' ELSE o END FROM w WHERE i = len(s) + 1"""


@query(TRUNCATED)
def smart_truncate(spark, read):
    """Documents cut to twenty lines, headings and code whole."""
    return read("documents").select("doc_id", L.smart_truncate(F.col("text"), 20).alias("text"))


@query()
def context_growth(spark, read):
    """Thirty words around the fifth line; documents without one have none."""
    return read("documents").select("doc_id", L.context(F.col("text"), F.lit(5), 30).alias("context"))


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[1:3], chr(10)) AS preview FROM documents")
def preview_lines(spark, read):
    """The first three lines."""
    return read("documents").select("doc_id", L.first_lines(F.col("text"), 3).alias("preview"))


PAGE_CONTEXTS = Derived(
    f"SELECT page_id::INT AS id, 'See [' || t || '](' || url || ') and <' || url || '> now' || chr(10) || url || chr(10) || t || ': ' || url || chr(10) || 'go `curl ' || url || '` there' AS text FROM (SELECT page_id, url, {TITLE} AS t FROM pages)",
    lambda read: titled(read).select(F.col("page_id").cast("int").alias("id"), F.concat(F.lit("See ["), "t", F.lit("]("), "url", F.lit(") and <"), "url", F.lit("> now\n"), "url", F.lit("\n"), "t", F.lit(": "), "url", F.lit("\ngo `curl "), "url", F.lit("` there")).alias("text")),
)
CONTEXTS = Fixture("id int, text string", [(1, "See [the docs](https://h.example.com/d) and <https://h.example.com/e> now"), (2, "https://h.example.com/alone\nkept line"), (3, "Set up: https://h.example.com/p#s"), (4, "plain"), (5, "go `curl https://h.example.com/x` there")])


@query_on(rf"""
WITH a AS (SELECT id, regexp_replace(text, '\[([^][]+)\]\([^)]+\)', '\1', 'g') AS t FROM <<contexts>>),
b AS (SELECT id, regexp_replace(regexp_replace(t, '<(https?://[^\s<>]+)>', '\1', 'g'), '(：|: )https://\S+', '', 'g') AS t FROM a),
c AS (SELECT id, array_to_string(list_transform(string_split(t, chr(10)), lambda x: CASE WHEN regexp_matches(x, '^\s*https?://\S*\s*$') THEN '' ELSE x END), chr(10)) AS t FROM b),
d AS (SELECT id, regexp_replace(regexp_replace(t, '`[^`]*?https?://\S*?`', '', 'g'), '\s+https?://[^\s<>]+', '', 'g') AS t FROM c)
SELECT id, trim(array_to_string(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^https?://\S+', '')), chr(10)), ' ' || chr(10) || chr(9)) AS text FROM d""", contexts=(PAGE_CONTEXTS, CONTEXTS))
def clean_contexts(spark, contexts):
    """Contexts without URLs."""
    return contexts.select("id", T.clean_context(F.col("text")).alias("text"))
