import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeloom.catalog.plans import PAGES, TOCS
from lakeloom.functions import secrets, urls
from lakeloom.functions.urls import Scope
from lakeloom.operators import bm25, crawl, ranking, report, retrieval
from lakeloom.plans import phases, rag, search, steps
from lakeloom.sources import corpus


def one(spark, f, *values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", f(F.col("v")).alias("o")).collect()
    return [r["o"] for r in sorted(rows)]


def test_scope(spark):
    s = Scope("example.com", 0, whitelist=["ok.bad.example.com"], blacklist=["bad.example.com"])
    got = one(spark, lambda c: urls.in_scope(c, s), "http://example.com/", "http://x.example.com:80/", "http://otherexample.com/", "http://bad.example.com/", "http://ok.bad.example.com/", "")
    assert got == [True, True, False, False, True, False]


@given(st.lists(st.sampled_from(["a", "b", "..", ".", "c.html", ""]), min_size=1, max_size=6))
@settings(max_examples=15, deadline=None)
def test_resolved_urls_stay_as_they_are(spark, parts):
    df = spark.createDataFrame([("http://h.example.com/x/y", "/".join(parts) or ".")], "b string, r string")
    once = df.withColumn("u", urls.resolved(F.col("b"), F.col("r")))
    r = once.withColumn("again", urls.resolved(F.col("b"), F.col("u"))).first()
    assert r["u"] == r["again"] and r["u"].startswith("http")


def test_secrets_count_distinct_matches(spark):
    df = spark.createDataFrame([("a@b.org a@b.org c@d.org 192.168.0.1",), (None,)], "t string")
    got = [{x["type"]: x["count"] for x in r["sensitive"]} for r in secrets.findings(df, "t").collect()]
    assert got[0]["邮箱"] == 2 and got[0]["内网IP"] == 1 and got[1] == {}


def test_needs_are_of_families():
    names = {n for n, _ in secrets.PATTERNS}
    assert {*secrets.NEEDS, *secrets.NEEDS_LOWER} <= names and not {*secrets.NEEDS} & {*secrets.NEEDS_LOWER}


def test_needs_lose_no_match(spark):
    """Strings made to match each family are found with and without asking for the needed parts first."""
    k = "a1B2c3D4e5F6a7B8c9D0a1B2c3D4e5F6a7B8c9D0a1B2"
    texts = [
        "11010119900307123X", "192.168.1.10", "10.1.2.3", "00:1A:2b:3C:4d:5E 00-1A-2b-3C-4d-5E", "a@b.org", "Basic abcdef12", "bearer abcdef12", "LTAIabcdefghijkl", "AKID" + "a" * 16, "AK" + "a" * 32, "AKIA" + "A" * 16, "A3TX" + "A" * 16,
        "AIza" + "b" * 35, "AAAAabcdefg:" + "x" * 140, "6L" + "a" * 38, "ya29.abc", "SK" + "a" * 32, "AC" + "a" * 32, "AP" + "a" * 32, "sk_live_" + "a" * 24, "rk_live_" + "a" * 24, "me:tok@github.com", "xoxb-1234567890ab",
        "https://hooks.slack.com/services/T12345678/B12345678/" + "a" * 24, "key-" + "a" * 32, "sqOatp-" + "a" * 22, "sq0csp-" + "a" * 43, "access_token$production$" + "a" * 16 + "$" + "b" * 32, "EAACEdEose0cBAxyz", "FaceBook '1234567890123'",
        "fb '" + "a" * 32 + "'", "TWITTER '" + "a" * 40 + "'", "LinkedIn '" + "a" * 16 + "'", "GitHub '" + k[:36] + "'", "w.oss.aliyuncs.com", "b.s3.amazonaws.com", "s3://bucket", "cloudinary://123456789012345:abc@x", "MySQL://u:p@h:1/d",
        "jdbc:mysql://h:1/d", "eyJh.eyJz.x", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PGP PRIVATE KEY BLOCK-----", "--BEGIN EC PRIVATE KEY--\nabc\n--END EC PRIVATE KEY--", "API_KEY = 'abcdefghij12'", "PASSWD: \"abcdefg\"", "token='abcdefg'", "AccessKeyId", "SECRET_KEY", "c:\\\\dir\\\\f",
        "app_key: 'abcdef12'", "nothing", 'ſecret = "abcdefgh"', 'paſs = "abcdefgh"', "Autheſ TİCKET='abcdefg' admın: 'abcdefg'", "BASİC abcdef12 Authorızation: basıc abc", "TWİTTER '" + "a" * 40 + "' lınkedin '" + "a" * 16 + "'",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    fast = {r["i"]: {x["type"]: x["samples"] for x in r["sensitive"]} for r in secrets.findings(df, "t").collect()}
    slow = df.select("i", *[secrets.matches(F.col("t"), p).alias(n) for n, p in secrets.PATTERNS]).collect()
    assert {r["i"]: {n: r[n] for n, _ in secrets.PATTERNS if r[n]} for r in slow} == fast
    assert len({n for f in fast.values() for n in f}) >= 50


@pytest.mark.parametrize("name", [n for n, _ in secrets.PATTERNS])
def test_secret_patterns_compile(spark, name):
    p = dict(secrets.PATTERNS)[name]
    assert spark.range(1).select(secrets.matches(F.lit("nothing"), p).alias("m")).first()["m"] in ([], ["nothing"])


CORPUS = [("d1", "machine learning is fun"), ("d2", "deep learning uses machine learning models"), ("d3", "custom skill creation for agents"), ("d4", "the weather is nice today"), ("d5", "")]


def test_bm25(spark):
    import math

    docs = spark.createDataFrame(CORPUS, "id string, text string")
    index = bm25.build(docs, "id", "text", bm25.Params(stemmed=False))
    q = spark.createDataFrame([(1, "machine learning"), (2, "skill"), (3, "learning learning")], "query_id int, query string")
    got = {(r["query_id"], r["doc"]): r["score"] for r in bm25.scores(index, q).collect()}
    length = {"d1": 3, "d2": 6, "d3": 4, "d4": 3, "d5": 0}  # without stop words
    avg = sum(length.values()) / 5
    idf = lambda df: math.log((5 - df + 0.5) / (df + 0.5) + 1)
    tf = lambda n, d: n * 2.2 / (n + 1.2 * (0.25 + 0.75 * length[d] / avg))
    assert got[1, "d1"] == pytest.approx(idf(2) * tf(1, "d1") * 2)
    assert got[1, "d2"] == pytest.approx(idf(2) * (tf(1, "d2") + tf(2, "d2")))
    assert got[3, "d1"] == pytest.approx(2 * idf(2) * tf(1, "d1"))
    assert set(d for k, d in got if k == 2) == {"d3"}
    top = bm25.search(index, q.where("query_id = 2"), top_k=3).orderBy("rank").collect()
    assert [r["doc"] for r in top] == ["d3", "d1", "d2"] and [r["score"] for r in top][1:] == [0.0, 0.0]


def test_narrow_index_scores_the_same(spark):
    docs = spark.createDataFrame(CORPUS, "id string, text string")
    q = spark.createDataFrame([(1, "machine learning agents"), (2, "nothing here"), (3, "learning learning")], "query_id int, query string")
    rows = lambda i: sorted((r["query_id"], r["doc"], round(r["score"], 12), r["terms"]) for r in bm25.scores(i, q).collect())
    assert rows(bm25.build(docs, "id", "text")) == rows(bm25.build_for(q, "query_id", "query", docs, "id", "text"))


def test_bm25_tables(spark, tmp_path):
    docs = spark.createDataFrame(CORPUS, "id string, text string")
    index = bm25.build(docs, "id", "text").saved(str(tmp_path))
    q = spark.createDataFrame([(1, "agents")], "query_id int, query string")
    assert [r["doc"] for r in bm25.search(index, q, min_score=1e-9).collect()] == ["d3"]


def test_own_scores_equal_similarity(spark):
    docs = spark.createDataFrame(CORPUS, "id string, text string")
    q = spark.createDataFrame([(1, "machine learning models")], "q int, query string")
    got = {r["id"]: r["score"] for r in bm25.own_scores(docs, ["id"], "text", q, "q", "query", bm25.Params()).collect()}
    want = {r["id"]: r["s"] for r in docs.select("id", bm25.one_doc_similarity("machine learning models", F.col("text")).alias("s")).collect()}
    assert {k: pytest.approx(v) for k, v in want.items() if v} == got


def test_length_normalisation(spark):
    docs = spark.createDataFrame([(1, "term"), (2, "term " + "pad " * 10), (3, "term " + "pad " * 40)], "id int, text string")
    q = spark.createDataFrame([(1, "term")], "query_id int, query string")
    for b, falls in ((0.0, False), (0.5, True), (1.0, True)):
        s = [r["score"] for r in bm25.scores(bm25.build(docs, "id", "text", bm25.Params(b=b)), q).orderBy("doc").collect()]
        assert (s[0] > s[1] > s[2]) == falls and (s[0] == pytest.approx(s[2])) == (not falls)


def test_quantile_cut(spark):
    import random

    r = random.Random(0)
    for n in (1, 2, 7, 100):
        scores = [round(r.uniform(-1, 1), 2) for _ in range(n)]
        df = spark.createDataFrame(list(enumerate(scores)), "id int, s double")
        for ratio in (0.0, 0.6, 1.0):
            cut = sorted(scores, reverse=True)[min(int(n * ratio), n - 1)]
            assert sorted(x["id"] for x in ranking.quantile_cut(df, "s", ratio).collect()) == [i for i, v in enumerate(scores) if v >= cut]


def test_back_fill_after_rerank(spark):
    rows = spark.createDataFrame([("p", 0.1, 1, "a", 0.6), ("p", 0.1, 2, "b", 0.2)], "page string, page_sim double, pos int, heading string, heading_sim double")
    assert [(r["page"], r["heading"]) for r in ranking.after_rerank(rows, 0.5, 3).collect()] == [("p", "a")]


def test_mode_chain(spark):
    t = spark.createDataFrame([("Agent Skills",), ("agent skills guide",), ("Hooks",)], "title string")
    for q, title, mode in (("Agent Skills", "Agent Skills", "exact"), ("agent skills", "Agent Skills", "case_insensitive"), ("guide", "agent skills guide", "partial"), ("Hoks", "Hooks", "fuzzy")):
        r = ranking.first_mode_that_hits(t, q).first()
        assert (r["title"], r["mode"]) == (title, mode)
    assert ranking.first_mode_that_hits(t, "zzz").first() is None


def test_crawl_with_a_fetcher(spark):
    site = {"http://h.example.com/": '<a href="/a">a</a><a href="/bad">b</a>', "http://h.example.com/a": '<a href="/">home</a><a href="/c">c</a>', "http://h.example.com/c": ""}

    def fetch(url):
        if url not in site:
            raise KeyError(url)
        return site[url], 200, None

    done = crawl.crawl(spark.createDataFrame([("http://h.example.com/",), ("not a url",)], "url string"), crawl.from_function(fetch, 2), Scope("example.com"), max_depth=5)
    got = {r["url"].rpartition("/")[2]: (r["depth"], r["error"]) for r in done.collect()}
    assert got == {"": (0, None), "a": (1, None), "bad": (1, "Error(KeyError): 'http://h.example.com/bad'"), "c": (2, None)}
    few = crawl.crawl(spark.createDataFrame([("http://h.example.com/",)], "url string"), crawl.from_function(fetch, 2), Scope("example.com"), max_depth=5, max_urls=2)
    assert few.count() == 2


def test_report_strings(spark):
    df = spark.createDataFrame([("http://h/x.php", 200, None, "T", 3, ["http://a", "http://b"], 1, False)], "url string, status_code int, error string, title string, length int, redirects array<string>, depth int, is_duplicate boolean")
    df = secrets.findings(df.withColumn("t", F.lit("a@b.org 10.0.0.1")), "t", [p for p in secrets.PATTERNS if p[0] in ("邮箱", "IP地址")])
    r = report.rows(df).first().asDict()
    assert list(r) == report.COLUMNS and r["LinkType"] == "PHP" and r["Redirects"] == "http://a → http://b" and r["Types"] == "IP地址|邮箱" and r["Details"] == "IP地址:10.0.0.1|邮箱:a@b.org"


def write(base, files):
    for path, text in files.items():
        p = os.path.join(base, path)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "w", encoding="utf-8") as f:
            f.write(text)


def test_corpus_tree(spark, tmp_path):
    write(tmp_path, {f"{r[0]}/{r[1]}/docContent.md": r[2] for r in PAGES.rows} | {f"{r[0]}/{r[1]}/docTOC.md": r[2] for r in TOCS.rows} | {"nope/x/docContent.md": "no", "docs@latest/a b+c – é/docContent.md": "odd name"})
    pages = corpus.pages(spark, str(tmp_path))
    assert {(r["doc_set"], r["title"]) for r in pages.collect()} == {(r[0], r[1]) for r in PAGES.rows} | {("docs@latest", "a b+c – é")}
    assert corpus.tocs(spark, str(tmp_path), ["other@1.0"]).count() == 1
    assert [r["doc_set"] for r in corpus.doc_sets(pages).collect()] == ["docs@latest", "other@1.0"]
    c = {r["doc_set"]: r for r in corpus.catalog(pages).collect()}
    assert c["other@1.0"]["version"] == "1.0" and c["docs@latest"]["titles"][0] == "Agent skills"
    assert {r["u"] for r in pages.select(corpus.source_url(F.col("content")).alias("u")).collect()} == {"https://h.example.com/guide", "https://h.example.com/skills", ""}
    with pytest.raises(corpus.CorpusError):
        corpus.checked(pages.where("false"))
    corpus.write_pages(pages.withColumn("n", F.length("content")), str(tmp_path / "out"), "n")
    assert spark.read.parquet(str(tmp_path / "out")).where("doc_set = 'other@1.0'").count() == 1


def test_single_file_and_lists(spark, tmp_path):
    write(tmp_path, {"one.md": "\nintro\n## First title\nx", "urls.txt": " http://a \n\nhttp://b\n", "u.csv": 'URL,Status\nhttp://a/1,200\nftp://x,200\n"https://b/2",404\n', "empty.csv": "URL,Status\n", "k.txt": "# note\nalpha\n"})
    assert corpus.single_file(spark, str(tmp_path / "one.md")).first()["title"] == "First title"
    with pytest.raises(corpus.CorpusError):
        corpus.single_file(spark, "x.txt")
    assert [r["url"] for r in corpus.url_list(spark, str(tmp_path / "urls.txt")).collect()] == ["http://a", "http://b"]
    assert [r["url"] for r in corpus.url_csv(spark, str(tmp_path / "u.csv")).collect()] == ["http://a/1", "https://b/2"]
    assert corpus.first_url(spark, str(tmp_path / "u.csv")) == "http://a/1" and corpus.has_content(spark, str(tmp_path / "u.csv")) and not corpus.has_content(spark, str(tmp_path / "empty.csv"))
    assert corpus.keywords(spark, str(tmp_path / "k.txt")) == ["alpha"]


def test_decoding(spark):
    """The declared charset; without one, what the bytes fit, and Windows-1252, in which each byte is a character, at last."""
    df = spark.createDataFrame([(1, "é".encode(), "utf-8"), (2, "é".encode("utf-16-le"), "UTF-16LE"), (3, b"ok \xff", None)], "i int, b binary, c string")
    assert [r["t"] for r in df.select("i", corpus.decoded(F.col("b"), F.col("c")).alias("t")).orderBy("i").collect()] == ["é", "é", "ok ÿ"]


def test_toc_text(spark):
    df = spark.createDataFrame([("p", 1, 1, "1", "A", "u#a"), ("p", 2, 2, "1.1", "B", "u#b"), ("p", 3, 4, "1.1.0.1", "C", "u#c")], "page string, pos int, level int, number string, text string, url string")
    assert corpus.toc_text(df, ["page"]).first()["toc"] == "## 1. A：u#a\n\n### 1.1. B：u#b\n\n- 1.1.0.1. C：u#c\n"


def letters(c):
    """An encoder for tests: counts of letters."""
    return F.array(*[(F.length(c) - F.length(F.replace(F.lower(c), F.lit(x), F.lit("")))).cast("double") for x in "abcdefghijklmnopqrstuvwxyz"])


def test_search(spark):
    pages, tocs = PAGES.df(spark), TOCS.df(spark)
    o = search.Options(nouns=["hooks"])
    found = {r["page_title"]: r for r in search.search(pages, tocs, ["configure hooks"], ["docs@latest"], o).collect()}
    assert [h["text"] for h in found["Guide"]["headings"]][0] == "## 1. Configure hooks"
    assert found["Agent skills"]["headings"][0]["source"] == "FALLBACK_2" and "hooks" in found["Agent skills"]["headings"][0]["related_context"]
    assert "Introduction" not in found
    with pytest.raises(search.LanguageMismatch):
        search.search(pages, tocs, ["配置钩子"], None, o)


def test_search_with_an_encoder(spark):
    o = search.Options(nouns=["hooks"], rerank_scopes=("page_title", "headings"))
    found = search.search(PAGES.df(spark), TOCS.df(spark), ["configure hooks"], ["docs@latest"], o, letters).collect()
    assert all(0 <= h["rerank_sim"] <= 1.0001 for r in found for h in r["headings"]) and found[0]["page_title"] == "Guide"


def test_serial_search_stops_early(spark):
    o = search.Options(nouns=["hooks"], serial=True, least_pages=1)
    found = search.search(PAGES.df(spark), TOCS.df(spark), ["configure hooks"], ["docs@latest"], o).collect()
    assert {h["source"] for r in found for h in r["headings"]} == {"BM25"}


def test_query_filter_needs_nouns():
    assert search.usable_queries(["How to use Hooks", "how to"], search.Options(skipped=["how to"])) == ["How to use Hooks", "how to"]
    assert search.usable_queries(["How to use Hooks", "how to"], search.Options(skipped=["how to"], nouns=["hooks"])) == ["use Hooks"]


def test_phases_of_retrieval(spark):
    pages, tocs = PAGES.df(spark), TOCS.df(spark)
    ask = lambda stop, **k: rag.retrieve("How to configure hooks?", pages, tocs, ["docs@latest"], stop, **k)
    assert ask("0").first()["scene"] == "how_to"
    found = ask("1")
    sections = ask("2").collect()
    assert {"Guide::1. Configure hooks"} <= {r["key"] for r in sections} and all(r["total_lines"] == sum(x["lines"] for x in sections) for r in sections)
    out = ask("4").first()
    assert "https://h.example.com/guide#1. Configure hooks" in out["output"]
    assert rag.missing(found, ask("2")).collect() == []


def test_compression(spark):
    s = spark.createDataFrame([("d", "t", "t::hooks", "## hooks\n" + "x\n" * 50, 51), ("d", "t", "t::other", "## other\n" + "y\n" * 80, 81)], "doc_set string, title string, key string, content string, lines int")
    assert [r["key"] for r in rag.compressed(s, "hooks", 40).collect()] == ["t::hooks"]
    assert all(r["content"].count("\n") < 20 for r in rag.compressed(s, None, 10).collect())


def test_transitions():
    assert sorted(phases.TRANSITIONS) == [("0a", "1"), ("0a+0b", "1"), ("0b", "1"), ("1", "1.5"), ("1", "2"), ("1.5", "2")]
    with pytest.raises(ValueError):
        phases.transition("2", "1")


def test_steps_are_retried(spark):
    df = spark.createDataFrame([("q",)], "p string")

    def ask(prompt):
        return '{"ok": 1}' if "lacked" in prompt else "bad"

    r = df.select(steps.ask_all(F.col("p"), ask, lambda raw: [] if raw.startswith("{") else ["json"]).alias("a")).first()["a"]
    assert r["answer"] == '{"ok": 1}' and r["tries"] == 2 and r["faults"] == []
    assert steps.filled("{a} {b}", {"a": "x"}) == "x {b}"


def test_layered_retrieval(spark):
    pages, tocs = PAGES.df(spark), TOCS.df(spark)
    assert retrieval.by_title(pages, "guide").first()["match_type"] == "exact"
    assert retrieval.by_toc(tocs, "deploy").first()["title"] == "Guide"
    previews = retrieval.by_preview(pages, "folder").collect()
    assert previews[0]["title"] == "Agent skills" and previews[0]["similarity"] == pytest.approx(0.7)
    assert retrieval.match(pages, tocs, "skills").first()["title"] == "Agent skills"
    assert retrieval.expansions("Create agent skills now") == ["create", "agent"]
    assert retrieval.candidates(pages, "Agent skill").first()["title"] == "Agent skills" and retrieval.info(pages, "Guide").first()["doc_set"] == "docs@latest"


def test_landing_stream(spark, tmp_path):
    import datetime

    from lakeloom.streaming import landing

    rows = [("http://h.example.com/a?x=1", "<title>A</title><p>one</p>", datetime.datetime(2024, 1, 1, 0, 0)), ("https://www.h.example.com/a", "<title>A</title>", datetime.datetime(2024, 1, 1, 0, 1)), ("http://h.example.com/b", "<title>B</title>", datetime.datetime(2024, 1, 1, 0, 2))]
    spark.createDataFrame(rows, landing.LANDED).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = landing.extracted(landing.first_seen(landing.landed(spark, str(tmp_path / "in"))))
    landing.run(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r["title"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["A", "B"]
    q = landing.counts(landing.landed(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("per_host").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.awaitTermination(120)
    assert {(r["host"], r["n"]) for r in spark.table("per_host").collect()} == {("h.example.com", 2), ("www.h.example.com", 1)}


def test_corpus_is_built(spark, tmp_path):
    from lakeloom.plans import build

    page = lambda t, body: f"<title>{t}</title><nav class='toc'><a href='#sub-one'>One</a></nav><article>{body}</article>"
    pages = spark.createDataFrame([
        (1, "http://h.example.com/a", page("A: first | Site", "<h1>A</h1><p>x</p>")), (2, "http://h.example.com/b", page("A: first | Site", "<p>later</p>")), (3, "http://h.example.com/c", page("Page Not Found", "<p>no</p>")),
        (4, "http://h.example.com/d", ""), (5, "http://h.example.com/e/f", "<article><p>untitled</p></article>"),
    ], "n int, url string, html string")
    rows = build.converted(pages, version="2", removed=[" | Site"], order="n")
    assert {r["url"][-1]: r["outcome"] for r in rows.collect()} == {"a": "replaced", "b": "ok", "c": "skipped_title", "d": "empty", "f": "ok"}
    kept = {r["title"]: r for r in build.contents(rows).collect()}
    assert set(kept) == {"A first", "f"} and kept["A first"]["doc_set"] == "h_example_com@2"
    assert kept["A first"]["content"] == "# A: first\n\n> **原文链接**: http://h.example.com/b\n\n---\n\nlater"
    toc = build.tables_of_contents(rows).first()
    assert toc["content"].startswith("# A first\n") and "### 0.1. One：http://h.example.com/b#sub-one" in toc["content"]
    build.write_tree(build.contents(rows), str(tmp_path)).collect()
    build.write_tree(build.tables_of_contents(rows), str(tmp_path), "docTOC.md").collect()
    assert corpus.pages(spark, str(tmp_path)).count() == 2 and corpus.tocs(spark, str(tmp_path)).count() == 1


def test_small_helpers(spark):
    assert [tuple(r) for r in retrieval.listing(PAGES.df(spark)).collect()][0] == ("docs@latest", "Agent skills")
    index = bm25.build(spark.createDataFrame(CORPUS, "id string, text string"), "id", "text")
    q = spark.createDataFrame([(1, "machine learning agents")], "query_id int, query string")
    assert retrieval.matched_terms(bm25.search(index, q, min_score=1e-9)).first()["terms"] == ["agent", "learn", "machine"]
    o = search.Options(nouns=["hooks"])
    text = retrieval.as_text(search.search(PAGES.df(spark), TOCS.df(spark), ["configure hooks"], ["docs@latest"], o)).first()["text"]
    assert text.startswith("docs@latest: Guide\n  docs@latest/Guide/docTOC.md\n  - ## 1. Configure hooks")
    r = spark.sql("SELECT 'a.b' AS h, timestamp'2024-01-02 03:04:05' AS t").select(report.file_name(F.col("h"), F.col("t")).alias("n")).first()
    assert r["n"] == "a_b_20240102_030405.csv"


def test_one_doc_similarity_works_out_a_text_once(spark):
    """Words that begin otherwise are not stemmed, and the text is split once, not for each term."""
    import math

    query, texts = "cities women running worthless ox things", ["Women and woman run; running ran to a city of cities. Thing!", "ox oxes oxen worth worthless", "", None, "citing cit w", "thing " * 5 + "éthings things_ 技能things"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = df.select("id", bm25.one_doc_similarity(query, F.col("text")).alias("s"))
    own = {r["id"]: r["t"] for r in df.select("id", bm25.tokens(F.col("text"), bm25.Params()).alias("t")).collect()}
    asked = df.limit(1).select(bm25.tokens(F.lit(query), bm25.Params()).alias("t")).first()["t"]
    for r in got.collect():
        tf = [own[r["id"]].count(t) for t in asked]
        assert r["s"] == pytest.approx(sum(math.log(4 / 3) * n * 2.2 / (n + 1.2) for n in tf))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(lower(coalesce(text") == 1


def test_top_terms_of_rows_are_those_of_the_index(spark):
    """Ids of several rows are summed, nulls too; terms of other rows are not shuffled."""
    rows = [(1, "b a b c"), (2, ""), (3, None), (4, "cc dd dd ee ee"), (4, "cc cc cc"), (None, "zz"), (None, "yy zz"), (5, "one two two")]
    docs = spark.createDataFrame(rows, "id int, text string")
    p = bm25.Params(stemmed=False)
    for df in (docs, docs.where("id <> 4")):
        got = bm25.top_terms_of(df, "id", "text", p, 2)
        want = bm25.top_terms(bm25.build(df, "id", "text", p), 2).select("doc", "term", "tf", "rank")
        assert got.schema.simpleString() == want.schema.simpleString()
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
