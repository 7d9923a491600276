"""URL functions over the pages and over cases."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.catalog.base import Derived, Fixture, query, query_on
from lakeloom.functions import urls
from lakeloom.functions.urls import Scope
from lakeloom.operators import report

RX = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(i: int, url: str = "url") -> str:
    return f"regexp_extract({url}, '{RX}', {i})"


@query(f"""
SELECT page_id, lower({part(1)}) AS scheme, {part(2)} AS host, {part(3)} AS path, {part(4)} AS query, {part(5)} AS fragment,
  array_to_string(list_slice(string_split(lower({part(2)}), '.'), -2, -1), '.') AS domain, replace({part(2)}, '.', '_') AS doc_name FROM pages""")
def url_parts(spark, read):
    """Parts, registered domain by the last two labels, and document name of page URLs."""
    u = F.col("url")
    return read("pages").select("page_id", urls.scheme(u).alias("scheme"), urls.host(u).alias("host"), urls.path(u).alias("path"), urls.part(u, 4).alias("query"), urls.part(u, 5).alias("fragment"), urls.domain(u).alias("domain"), urls.doc_name(u).alias("doc_name"))


@query(f"""
SELECT page_id, (host = 'example.com' OR ends_with(host, '.example.com')) AND NOT (host = 'm.example.com' OR ends_with(host, '.m.example.com')) AS mode_0,
  NOT (host = 'm.example.com' OR ends_with(host, '.m.example.com')) AS mode_2, host = 'example.net' OR ends_with(host, '.example.net') AS mode_3
FROM (SELECT page_id, {part(2)} AS host FROM pages)""")
def url_scope(spark, read):
    """Which pages three scopes take."""
    u = F.col("url")
    black = ["m.example.com"]
    return read("pages").select("page_id", urls.in_scope(u, Scope("example.com", 0, blacklist=black)).alias("mode_0"), urls.in_scope(u, Scope("example.com", 2, blacklist=black)).alias("mode_2"), urls.in_scope(u, Scope("", 3, whitelist=["example.net"])).alias("mode_3"))


#: Every page's URL and its first link.
PAGE_LINKS = Derived(
    """SELECT (page_id * 2)::INT AS id, url FROM pages UNION ALL SELECT (page_id * 2 + 1)::INT, regexp_extract(html, '<a href="([^"]*)"', 1) FROM pages""",
    lambda read: read("pages").select(F.expr("int(page_id * 2)").alias("id"), "url").unionByName(read("pages").select(F.expr("int(page_id * 2 + 1)").alias("id"), F.regexp_extract("html", '<a href="([^"]*)"', 1).alias("url"))),
)
CASES = Fixture("id int, url string", list(enumerate([
    "https://example.com/a.js", "http://x.example.com/A/B.PNG?v=1", "ftp://example.com/f.tar.gz", "http://otherexample.com/delete?id=1", "https://example.com:8080/", "https://example.com:99999/", "https://example.com:x/",
    "http://localhost/", "javascript:void(0)", "mailto:a@example.com", "  '/quoted/path'  ", "/a b", "http://e.x/", "https://example.com/" + "a" * 2100, "", None, "//cdn.example.com/x.css", "https://example.com/admin/drop.js", "https://a.example.com/report.final.pdf#p",
])))


@query_on(rf"""
SELECT id, regexp_matches(lower({part(3, 'u')}), '\.(css|jpg|jpeg|png|gif|svg|woff|woff2|ttf|eot|ico|mp4|mp3|avi|mov|pdf|doc|docx|xls|xlsx|ppt|pptx|zip|rar|gz|tar|7z|exe|dll|bin|swf|flv)$') AS skipped,
  contains(lower(u), 'final') AS excluded, contains(lower(u), 'example.com/a') OR contains(lower(u), 'x.css') AS allowed,
  CASE WHEN ends_with(u, '.js') THEN NULL WHEN contains(lower(u), 'delete') THEN 'delete' WHEN contains(lower(u), 'drop') THEN 'drop' END AS danger,
  CASE WHEN contains(f, '.') THEN upper(regexp_extract(f, '[^.]*$')) ELSE '接口' END AS link_type,
  CASE WHEN regexp_matches(trim(u), '^(javascript|data|mailto|tel):') THEN NULL ELSE nullif(trim(regexp_extract(trim(u), '^[a-zA-Z0-9:/?&=._~#%\\-]+'), '''"'), '') END AS precleaned
FROM (SELECT id, coalesce(url, '') AS u, regexp_extract(split_part(coalesce(url, ''), '?', 1), '[^/]*$') AS f FROM <<cases>>)""", cases=(PAGE_LINKS, CASES))
def url_predicates(spark, cases):
    """Extension, exclude, allow and danger tests, link type and preclean of cases."""
    u = F.col("u")
    c = cases.select("id", F.coalesce("url", F.lit("")).alias("u"))
    return c.select("id", urls.has_extension(u, urls.EXTENSIONS).alias("skipped"), urls.excluded(u, ["FINAL"]).alias("excluded"), urls.allowed(u, ["example.com/a", "x.css"]).alias("allowed"), urls.danger_token(u, ["delete", "drop"]).alias("danger"), urls.link_type(u).alias("link_type"), urls.precleaned(u).alias("precleaned"))


@query_on(f"""
SELECT id, lower({part(1, 'u')}) IN ('http', 'https', 'ftp', 'sftp', 'ws', 'wss') AND len(string_split(h, '.')) >= 2 AND length(string_split(h, '.')[-1]) >= 2
  AND (NOT regexp_matches(h, '^[^:]*:[^:]*$') OR coalesce(try_cast(CASE WHEN regexp_matches(split_part(h, ':', 2), '^[0-9]+$') THEN split_part(h, ':', 2) END AS INT) BETWEEN 1 AND 65535, false)) AND length(u) <= 2048 AS ok
FROM (SELECT id, trim(coalesce(url, '')) AS u, {part(2, "trim(coalesce(url, ''))")} AS h FROM <<cases>>)""", cases=(PAGE_LINKS, CASES))
def url_check(spark, cases):
    """Whether cases are URLs at all."""
    return cases.select("id", urls.is_url(F.col("url")).alias("ok"))


#: The first link of every page, as it stands, and as one relative to the page, to its parent or without a root.
RELATIVE_LINKS = Derived(
    """SELECT page_id::INT AS id, url AS base, CASE page_id % 4 WHEN 0 THEN l WHEN 1 THEN '.' || l WHEN 2 THEN '..' || l ELSE ltrim(l, '/') END AS rel FROM (SELECT page_id, url, regexp_extract(html, '<a href="([^"]*)"', 1) AS l FROM pages)""",
    lambda read: read("pages").select("page_id", "url", F.regexp_extract("html", '<a href="([^"]*)"', 1).alias("l")).select(F.col("page_id").cast("int").alias("id"), F.col("url").alias("base"), F.expr("CASE page_id % 4 WHEN 0 THEN l WHEN 1 THEN concat('.', l) WHEN 2 THEN concat('..', l) ELSE ltrim('/', l) END").alias("rel")),
)
RELATIVE = Fixture("id int, base string, rel string", [
    (1, "https://h.example.com/a/b/c.html", "//cdn.example.com/x.js"), (2, "https://h.example.com/a/b/c.html", "#/route"),
    (3, "https://h.example.com/a/b/c.html", "/root/x"), (4, "https://h.example.com/a/b/c.html", "///x"), (5, "https://h.example.com/a/b/c.html", "./d.html"),
    (6, "https://h.example.com/a/b/c.html", "../d.html"), (7, "https://h.example.com/a/b/c.html", "../../../../d.html"), (8, "https://h.example.com/a/b/", "../x/../y"),
    (9, "https://h.example.com/a/b/c.html", "http://o.example.com/z"), (10, "https://h.example.com/a/b/c.html", "d//e.html"), (11, "https://h.example.com/a/b/c.html", "?q=1"),
    (12, "https://h.example.com/a/b/c.html", "d/../e/./f"), (13, "https://h.example.com", "x"), (14, "https://h.example.com/a/", "./"), (15, "https://h.example.com/a/b", ".."),
])


ROOT = "regexp_extract(base, '^https?://[^/?#]+')"
BASE_PATH = "regexp_extract(base, '^https?://[^/?#]+([^?#]*)', 1)"


@query_on(rf"""
WITH RECURSIVE p AS (SELECT id, base, rel, {ROOT} AS root, {BASE_PATH} AS path, regexp_extract(rel, '^[^?#]*') AS rp, substr(rel, length(regexp_extract(rel, '^[^?#]*')) + 1) AS tail FROM <<links>>),
m AS (SELECT *, string_split(CASE WHEN starts_with(rp, '/') THEN rp ELSE regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '[^/]*$', '') || rp END, '/') AS s FROM p),
w AS (
  SELECT id, s, 2 AS i, ['']::VARCHAR[] AS acc FROM m
  UNION ALL SELECT id, s, i + 1, CASE s[i] WHEN '.' THEN acc WHEN '..' THEN acc[1:greatest(len(acc) - 1, 1)] ELSE list_append(acc, s[i]) END FROM w WHERE i <= len(s)),
j AS (SELECT id, regexp_replace(array_to_string(acc, '/') || CASE WHEN s[-1] IN ('.', '..') THEN '/' ELSE '' END, '/+', '/', 'g') AS flat FROM w WHERE i = len(s) + 1),
up AS (
  SELECT id, list_filter(string_split(regexp_replace(path, '[^/]*$', ''), '/'), lambda x: x <> '') AS f, len(list_filter(string_split(rel, '/'), lambda x: x = '..')) AS n, list_filter(string_split(rel, '/'), lambda x: x NOT IN ('..', '.', '')) AS t FROM p)
SELECT p.id, CASE WHEN starts_with(rel, '//') THEN split_part(base, ':', 1) || ':' || rel WHEN starts_with(rel, '#/') THEN root || path || rel WHEN starts_with(rel, '/') THEN root || '/' || ltrim(rel, '/')
  WHEN starts_with(rel, './') THEN root || regexp_replace(path, '/[^/]*$', '') || '/' || ltrim(substr(rel, 3), '/')
  WHEN starts_with(rel, '../') THEN root || '/' || array_to_string(list_concat(f[1:greatest(0, len(f) - n)], t), '/')
  WHEN regexp_matches(rel, '^https?://') THEN rel WHEN rp = '' THEN root || path || tail ELSE root || flat || tail END AS resolved
FROM p JOIN j USING (id) JOIN up USING (id)""", links=(RELATIVE_LINKS, RELATIVE))
def url_resolve(spark, links):
    """Links of every kind against a base."""
    return links.select("id", urls.resolved(F.col("base"), F.col("rel")).alias("resolved"))


BASES = Fixture("base string", [("https://api.example.com/",), ("https://b.example.com",)])
ROUTES = Fixture("route string", [("/v1/",), ("",)])
RELS = Fixture("rel string", [("/users",), ("http://o.example.com/x",)])


@query(f"""
SELECT DISTINCT CASE WHEN regexp_matches(rel, '^https?://') THEN rel WHEN trim(route, '/') = '' THEN rtrim(base, '/') || '/' || ltrim(rel, '/')
  ELSE rtrim(base, '/') || '/' || trim(route, '/') || '/' || ltrim(rel, '/') END AS url FROM {BASES.sql}, {ROUTES.sql}, {RELS.sql}""")
def url_routes(spark, read):
    """Bases, routes and paths put together."""
    return urls.routes(BASES.df(spark), ROUTES.df(spark), RELS.df(spark))


KEY = f"regexp_replace(lower({part(2)}), '^(www|m)\\.', '') || regexp_replace({part(3)}, '/+$', '')"


@query(f"SELECT page_id, row_number() OVER (PARTITION BY {KEY} ORDER BY page_id) > 1 AS is_duplicate FROM pages")
def url_dedupe(spark, read):
    """Pages whose URL came before, but for scheme, www. or m., query and fragment."""
    p = read("pages").withColumn("key", urls.same_page_key(F.col("url")))
    return report.with_duplicates(p, "page_id", "key").select("page_id", "is_duplicate")


@query(f"SELECT DISTINCT {part(2)} AS url FROM pages WHERE page_id % 3 <> 0 EXCEPT SELECT {part(2)} FROM pages WHERE page_id % 3 = 0")
def unvisited_hosts(spark, read):
    """Hosts of some pages that are not among those of others."""
    h = read("pages").select("page_id", urls.host(F.col("url")).alias("url"))
    return report.unvisited(h.where("page_id % 3 <> 0"), h.where("page_id % 3 = 0"))


#: What a bundler would say of a page: its chunk by a hash of its text, where it was found.
PAGE_BUNDLES = Derived(
    """SELECT page_id::INT AS id, '{"chunk-' || substr(md5(url), 1, (page_id % 5)::INT + 1) || '":"' || substr(md5(html), 1, 8) || '"} of ' || url || ' , see https://b.example.com/' || page_id AS text FROM pages""",
    lambda read: read("pages").select(F.col("page_id").cast("int").alias("id"), F.concat(F.lit('{"chunk-'), F.expr("substr(md5(url), 1, int(page_id % 5) + 1)"), F.lit('":"'), F.expr("substr(md5(html), 1, 8)"), F.lit('"} of '), "url", F.lit(" , see https://b.example.com/"), "page_id").alias("text")),
)
#: Calls as a script would make them with the first link of a page.
PAGE_CALLS = Derived(
    """SELECT page_id::INT AS id, 'fetch("' || l || '"); axios.get(`' || l || '/' || page_id || '`); router.push("' || l || '?p=1"); x = import("./m' || page_id || '")' AS text FROM (SELECT page_id, regexp_extract(html, '<a href="([^"]*)"', 1) AS l FROM pages)""",
    lambda read: read("pages").select("page_id", F.regexp_extract("html", '<a href="([^"]*)"', 1).alias("l")).select(F.col("page_id").cast("int").alias("id"), F.concat(F.lit('fetch("'), "l", F.lit('"); axios.get(`'), "l", F.lit("/"), "page_id", F.lit('`); router.push("'), "l", F.lit('?p=1"); x = import("./m'), "page_id", F.lit('")')).alias("text")),
)
PAGE_HTML = Derived("SELECT page_id::INT AS id, html AS text FROM pages", lambda read: read("pages").select(F.col("page_id").cast("int").alias("id"), F.col("html").alias("text")))
SCRIPTS = Fixture("id int, text string", [
    (1, """fetch("/api/v1/x"); axios.get('../y'); $.post("z.do")"""), (2, """{"chunk-a2d74a98":"1ea71fd1","chunk-x":"1","chunk-abcdefghijkl":"0123456789abc"}"""), (3, """<a href=/plain>p</a><img src='i.png'>"""),
    (8, "$.get(entrance); $.ajax('/j.json'); axios.post(`/tpl/a b`); x = `./t/${i}`; fetch(api/v2)"), (9, """{"href":"\\/admin\\/list.html"} <Route path="/r"> window.location = '/w'; a.href="/h"; img.src = 'i.png'; window.open("o.html")"""),
    (10, """'/api/v2/users' "/x/y.php?a=1" 'DataInterface.do?m=1' assets/js/app.1.js router.addRoutes('/dyn') router.replace("/rep") "//cdn.example.com/z.js" """), (4, "body{background:url(img/b.gif)} router.push('/home')"), (5, """import("./mod"); require('./api'); {"url": "/u/1"}"""), (6, "see http://a.example.com/1 and https://b.example.com/2?x"), (7, ""),
])
CHUNKS = r'(?i)"(chunk-[\p{L}\p{N}_]+)":"([\p{L}\p{N}_]+)"'


@query_on(f"""
WITH m AS (SELECT id, regexp_extract_all(text, '{CHUNKS}', 1) AS a, regexp_extract_all(text, '{CHUNKS}', 2) AS b FROM <<scripts>>)
SELECT id, 'static/js/' || f AS file FROM (SELECT id, a[i] || '.' || b[i] || '.js' AS f FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM m)) WHERE length(f) BETWEEN 21 AND 27""", scripts=(PAGE_BUNDLES, SCRIPTS))
def chunk_files(spark, scripts):
    """Bundle files named in scripts."""
    return scripts.select("id", F.explode(urls.chunk_files(F.col("text"))).alias("file"))


@query_on(f"SELECT id, unnest(regexp_extract_all(text, 'https?://[^ ]+')) AS url FROM <<scripts>>", scripts=(PAGE_BUNDLES, SCRIPTS))
def full_urls(spark, scripts):
    """Absolute URLs in text."""
    return scripts.select("id", F.explode(urls.full_urls(F.col("text"))).alias("url"))


#: Families as they are called in scripts, in groups that are written anew here: quoted, attributes, assets, calls, assignments, keys.
SCRIPT_PATHS = [
    r"""["'](\.{0,2}/[^"'\s]+)["']""", r"""["'](\\+/[^"'\s]+)["']""", r"""[`'"]((https?:)?//[^\s'"`]+)[`'"]""", r"""['"`](\.{0,2}/[^\s'"`]+)['"`]""", r"""`((https?://|\.{0,2}/)[^`]+)`""",
    r"""\b(?:href|src|action)\s*=\s*["']?([^"'\s>]+)""", r"""(assets/[\w\-./]+\.(js|css|png|jpe?g|svg|gif|woff2?|ttf|eot|mp4|mp3|json|map))""", r"""url\(['"]?([^\s'")]+)""",
    r"""\.(?:get|post|put|delete|patch|options|head|connect)\(['"`]([^\s'"`]+)['"`]""", r"""(?:window\.open|fetch)\(['"`]([^\s'"`]+)['"`]""", r"""(?:window\.location|\.src|\.href|\.action)\s*=\s*['"`]([^\s'"`]+)['"`]""",
    r"""['"`](?:url|src|href)['"`]\s*:\s*['"`]([^\s'"`]+)['"`]""", r"""router\.(?:push|replace)\(['"`]([^\s'"`]+)['"`]""", r"""router\.addRoutes?\s*\(\s*['"`]([^\s'"`]+)['"`]""", r"""<Route\s+path=['"`]([^\s'"`]+)['"`]""",
    r"""(?:\.get|\.post|\.ajax|fetch)\s*\(\s*['"`]?([\w/-]+)""", r"""['"`](/?DataInterface\.do(?:\?[^\s'"`]*)?)['"`]""", r"""\$\.(?:get|post|ajax)\s*\(\s*['"`]([^\s'"`]+)['"`]""", r"""(?:require|import)\s*\(\s*['"`](\.[^\s'"`]+)['"`]""",
]


def script_paths_sql(table: str, key: str, text: str) -> str:
    return " UNION ".join(f"SELECT {key}, unnest(regexp_extract_all(coalesce({text}, ''), '(?i)" + p.replace("'", "''") + f"', 1)) AS path FROM {table}" for p in SCRIPT_PATHS)


@query_on(script_paths_sql("<<scripts>>", "id", "text"), scripts=(PAGE_CALLS, SCRIPTS))
def script_paths(spark, scripts):
    """Distinct paths in scripts and markup, by families of patterns."""
    return scripts.select("id", F.explode(urls.paths_in(F.col("text"))).alias("path"))


@query(script_paths_sql("pages", "page_id", "html"))
def page_paths(spark, read):
    """Distinct paths that the families of patterns find in pages."""
    return read("pages").select("page_id", F.explode(urls.paths_in(F.col("html"))).alias("path"))


MARKUP = Fixture("id int, text string", [
    (1, """<script async src="/a.js"></script><SCRIPT SRC='b.js'></SCRIPT><script src=c.js defer></script>"""), (2, """<link rel=x href="/l.css"><img alt="a" src='i.png'><iframe src=f.html></iframe>"""),
    (3, """<form method=post action="/send"><button formaction='/b'>x</button><input src=i.gif formaction="/c"></form>"""), (4, """<meta name=x content="0;url=/m"><object data=o.swf></object><embed src="e.svg"><applet code=A.class>"""),
    (5, """<video src="v.mp4"><source src='s.webm'><track src=t.vtt></video><audio src="a.mp3"></audio>"""), (6, """<area href="/ar"><base href=/base/><frame src='fr.html'><portal src="p"></portal>"""), (7, """<p title="<no>">text</p> <a name=x>"""), (8, None), (9, "<a\nclass='k'\nhref = \"/multi\">l</a><a href='#f'>"),
])
TAGS = "a:href link:href script:src img:src iframe:src form:action meta:content object:data embed:src source:src audio:src video:src track:src applet:code frame:src portal:src button:formaction input:src input:formaction area:href base:href"


def tag_paths_sql(table: str, key: str, text: str) -> str:
    out = []
    for pair in TAGS.split():
        tag, attr = pair.split(":")
        for value in ('"([^">]+)"', "''([^''>]+)''", "([^\\s\"''>]+)"):
            out.append(f"SELECT {key}, unnest(regexp_extract_all(coalesce({text}, ''), '(?i)<{tag}\\b[^>]*?\\b{attr}\\s*=\\s*{value}', 1)) AS path FROM {table}")
    return " UNION ".join(out)


@query_on(tag_paths_sql("<<markup>>", "id", "text"), markup=(PAGE_HTML, MARKUP))
def tag_paths(spark, markup):
    """Distinct values of attributes that point somewhere, quoted or not."""
    return markup.select("id", F.explode(urls.tag_paths(F.col("text"))).alias("path"))


@query(tag_paths_sql("pages", "page_id", "html"))
def page_tag_paths(spark, read):
    """The same over the pages."""
    return read("pages").select("page_id", F.explode(urls.tag_paths(F.col("html"))).alias("path"))


@query(f"SELECT page_id, path FROM ({script_paths_sql('pages', 'page_id', 'html')}) UNION SELECT page_id, path FROM ({tag_paths_sql('pages', 'page_id', 'html')})")
def page_candidates(spark, read):
    """All that pages may point to, by all extractors; no page holds a bundle's table."""
    return read("pages").select("page_id", F.explode(urls.candidates(F.col("html"), F.col("url"))).alias("path"))


@query(f"SELECT host, n, rank FROM (SELECT *, row_number() OVER (ORDER BY n DESC, host)::INT AS rank FROM (SELECT {part(2)} AS host, count(*) AS n FROM pages GROUP BY 1)) WHERE rank <= 10")
def top_hosts(spark, read):
    """The hosts with most pages."""
    n = read("pages").groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "host").limit(10).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "host")))
