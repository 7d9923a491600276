"""Fetching: attempts, budgets, response fields, bytes as text; configuration; what else has no table to run on."""

import json

import pytest
from pyspark.sql import functions as F

from lakeloom.functions import charset, urls
from lakeloom.functions.urls import Scope
from lakeloom.operators import bm25, crawl, lines, ranking, retrieval
from lakeloom.operators.crawl import Response
from lakeloom.plans import config, rag, search
from lakeloom.sources import corpus


class Timeout(OSError):
    pass


class SSLError(ConnectionError):
    pass


class TooManyRedirects(OSError):
    pass


def flaky(url):
    raise Timeout("slow")


def test_attempts():
    calls, waits = [], []

    def fetch(url):
        calls.append(url)
        if len(calls) < 3:
            raise Timeout("slow")
        return Response(b"<title>x</title>", 200, {"Content-Type": "text/html; charset=UTF-8"}, "http://h/y", ["http://h/x"])

    row = crawl.fetched("http://h/x", fetch, 3, 0.5, (), waits.append)
    assert row == ("http://h/x", "<title>x</title>", 200, None, "http://h/y", "text/html; charset=UTF-8", ["http://h/x"], {"Content-Type": "text/html; charset=UTF-8"}, 3)
    assert waits == [0.5, 0.5]
    assert crawl.fetched("u", flaky, 2, 0, ())[3] == "TimeoutError: slow" and crawl.fetched("u", flaky, 2, 0, ())[8] == 2

    def round_and_round(url):
        raise TooManyRedirects("30")

    assert crawl.fetched("u", round_and_round, 5, 0, ("TooManyRedirects",))[8] == 1


@pytest.mark.parametrize("error,text", [(Timeout("a"), "TimeoutError: a"), (TimeoutError("b"), "TimeoutError: b"), (SSLError("c"), "SSLError: c"), (ConnectionResetError("d"), "ConnectionError: d"), (TooManyRedirects("e"), "TooManyRedirects: e"), (KeyError("f"), "Error(KeyError): 'f'")])
def test_error_kinds(error, text):
    assert urls.error_text(error) == text


def test_crawl_with_a_function(spark, tmp_path):
    def site(url):
        pages = {"http://s.example.com/": "<a href='/a'>a</a><a href='/b'>b</a><a href='http://t.example.com/'>t</a>", "http://s.example.com/a": "<a href='/c'>c</a>", "http://s.example.com/b": "", "http://s.example.com/c": "", "http://t.example.com/": ""}
        return (pages[url], 200, None) if url in pages else (None, 404, None)

    seeds = spark.createDataFrame([("http://s.example.com/",)], "url string")
    done = crawl.crawl(seeds, crawl.from_function(site, 2, wait=0), Scope(mode=2), max_depth=3)
    assert {r["url"]: r["depth"] for r in done.collect()} == {"http://s.example.com/": 0, "http://s.example.com/a": 1, "http://s.example.com/b": 1, "http://t.example.com/": 1, "http://s.example.com/c": 2}
    done = crawl.crawl(seeds, crawl.from_function(site, 2, wait=0), Scope(mode=2), max_depth=3, max_requests=2).collect()
    assert sorted((r["url"], r["error"]) for r in done) == [("http://s.example.com/", None), ("http://s.example.com/a", None), ("http://s.example.com/b", crawl.NO_BUDGET), ("http://t.example.com/", crawl.NO_BUDGET)]
    assert done[0]["final_url"] and done[0]["attempts"] == 1
    (tmp_path / "u.csv").write_text("URL,Status\nhttp://s.example.com/,200\nnot a url,1\n")
    one = crawl.crawl_csv(spark, str(tmp_path / "u.csv"), crawl.from_function(site, 2, wait=0))
    assert [r["url"] for r in one.collect()] == ["http://s.example.com/"]
    own = crawl.crawl_csv(spark, str(tmp_path / "u.csv"), crawl.from_function(site, 2, wait=0), max_depth=2)
    assert "http://t.example.com/" not in {r["url"] for r in own.collect()} and own.count() == 4
    assert crawl.within_hosts(own, 2).count() == 2


def test_documents(spark):
    got = spark.createDataFrame([("u", "<title>t</title>", 200, None), ("v", "<title>gone</title>", 404, None), ("w", None, None, "TimeoutError: x"), ("x", "<p class='client-only'>", 200, None)], "url string, html string, status_code int, error string")
    rows = {r["url"]: r for r in crawl.documents(got).collect()}
    assert rows["u"]["title"] == "t" and rows["v"]["error"] == "HTTPError: 404" and rows["v"]["html"] is None and rows["w"]["error"] == "TimeoutError: x" and rows["x"]["needs_rendering"]


TEXT = "数据处理的标题和一些普通的中文内容，用来判断编码。"


@pytest.mark.parametrize("body,declared,text", [
    (TEXT.encode("gbk"), None, TEXT), (TEXT.encode("gb18030"), "ISO-8859-1", TEXT), (TEXT.encode("utf-8"), None, TEXT), (TEXT.encode("utf-8"), "iso-8859-1", TEXT), ("標題與內容的測試文字".encode("big5"), "big5", "標題與內容的測試文字"),
    ("これは日本語のテストです".encode("shift_jis"), None, "これは日本語のテストです"), ("これは日本語のテストです".encode("euc_jp"), "EUC-JP", "これは日本語のテストです"), ("Größe café".encode("cp1252"), None, "Größe café"), ("Привет".encode("cp1251"), "windows-1251", "Привет"),
    (TEXT.encode("utf-16"), None, TEXT), (b"<meta charset='windows-1251'>" + "Привет".encode("cp1251"), None, "<meta charset='windows-1251'>Привет"), (b"plain", "no-such", "plain"), (b"", None, ""), (None, "utf-8", ""), (b"a\xffb", "utf-8", "a�b"), (b"\xef\xbb\xbfmark", None, "mark"),
])
def test_bytes_as_text(body, declared, text):
    assert charset.text_of(body, declared) == text


def test_decoded_column(spark):
    df = spark.createDataFrame([(bytearray(TEXT.encode("gbk")), None), (None, None)], "b binary, c string")
    rows = df.select(corpus.decoded(F.col("b"), F.col("c")).alias("t"), charset.title(F.col("b")).alias("title")).collect()
    assert [r["t"] for r in rows] == [TEXT, None]
    page = f"<title>{TEXT}</title>".encode("gbk")
    assert charset.best_title(page) == TEXT and charset.best_title(b"<title> a\n b </title>") == "a b" and charset.best_title(None) == ""


def test_scope_of_a_start():
    assert [Scope.of_start(u).base_domain for u in ("https://docs.example.com:8443/x", "http://localhost/", "http://10.0.0.1:80/", "http://user@a.b.c.example.org", "")] == ["example.com", "localhost", "10.0.0.1", "example.org", ""]


def test_wanted(spark):
    s = Scope("example.com", 0, blacklist=["bad.example.com"], exclude=["skip"], danger=["delete"], allow=["ok"])
    rows = [("http://example.com/ok", 1), ("http://example.com/ok", 9), ("http://bad.example.com/ok", 1), ("http://example.com/ok.png", 1), ("http://example.com/ok/skip", 1), ("http://example.com/ok/delete", 1), ("http://example.com/other", 1), ("http://o.org/ok", 1)]
    got = spark.createDataFrame(rows, "u string, d int").select(urls.wanted(F.col("u"), s, F.col("d"), 3).alias("w")).collect()
    assert [r["w"] for r in got] == [True] + [False] * 7


def test_config(tmp_path):
    path = str(tmp_path / "c.json")
    (tmp_path / "c.json").write_text(json.dumps({"page_threshold": 0.1, "top_k": 7, "bm25": {"k1": 2.0}, "rerank_scopes": ["headings"], "unknown": 1}))
    o = search.options_from(path, top_k=3)
    assert (o.page_threshold, o.top_k, o.bm25.k1, o.bm25.stemmed, o.rerank_scopes, o.heading_threshold) == (0.1, 3, 2.0, False, ("headings",), 0.25)
    assert search.options_from(None) == search.Options() and search.options_from({"top_k": 1}).top_k == 1
    with pytest.raises(TypeError):
        search.options_from(path, nothing=1)
    with pytest.raises(FileNotFoundError):
        search.options_from(str(tmp_path / "none.json"))
    with pytest.raises(ValueError):
        config.read("settings.yaml")
    c = config.Config({"a": {"b": 1}}).set("a.c.d", 2).merge({"a": {"b": 3}, "e": [1]})
    assert c.get("a.b") == 3 and c.get("a.c.d") == 2 and c.get("a.x", "no") == "no" and c.get("a.b.c") is None
    c.save(str(tmp_path / "d.json"))
    assert config.Config(str(tmp_path / "d.json")).values == {"a": {"b": 3, "c": {"d": 2}}, "e": [1]}
    with pytest.raises(ValueError):
        c.set("a.b.c", 1)


def test_answer_file(spark, tmp_path, monkeypatch):
    found = spark.createDataFrame([("the answer", "s")], "output string, sources string")
    monkeypatch.setenv("LAKELOOM_RESULT_FILE", str(tmp_path / "r.txt"))
    assert rag.write_answer(found) == str(tmp_path / "r.txt") and (tmp_path / "r.txt").read_text() == "the answer"
    assert open(rag.write_answer(found, str(tmp_path / "x.txt"))).read() == "the answer"
    monkeypatch.delenv("LAKELOOM_RESULT_FILE")
    monkeypatch.setattr("tempfile.gettempdir", lambda: str(tmp_path))
    assert rag.write_answer(found.where("false")).startswith(str(tmp_path))


def test_paths_are_restored(spark):
    before = spark.createDataFrame([("a@1", "p", "a@1/p/docTOC.md"), ("a@1", "q", "a@1/q/docTOC.md")], "doc_set string, page_title string, toc_path string")
    found = spark.createDataFrame([("a@1", "p", None), ("a@1", "q", "own"), ("a@1", "r", "")], "doc_set string, page_title string, toc_path string")
    assert sorted((r["page_title"], r["toc_path"]) for r in search.with_paths(found, before).collect()) == [("p", "a@1/p/docTOC.md"), ("q", "own"), ("r", None)]
    assert sorted((r["page_title"], r["toc_path"]) for r in search.with_paths(found.drop("toc_path"), before).collect()) == [("p", "a@1/p/docTOC.md"), ("q", "a@1/q/docTOC.md"), ("r", None)]


def test_heading_total(spark):
    found = spark.createDataFrame([(["a", "b"],), ([],), (None,), (["c"],)], "headings array<string>")
    assert search.heading_total(found).first()["headings"] == 3 and search.heading_total(found.where("false")).first()["headings"] == 0


def symmetric_plain(rows, most):
    left, right = 0, len(rows) - 1
    n = lambda: lines.size_of("\n".join(rows[left : right + 1]))
    while rows and n() > most and left < right:
        if (left + right) % 2:
            right -= 1
        else:
            left += 1
    text = "\n".join(rows[left : right + 1])
    return " ".join(text.split()[:most]) if rows and n() > most and len(text.split()) > most else text


def test_symmetric_cut(spark):
    rows = ["one two three", "four", "five six", "seven eight nine ten", "eleven"]
    for most in range(1, 13):
        assert lines.symmetric(rows, most) == symmetric_plain(rows, most)
    assert lines.symmetric([], 3) == "" and lines.symmetric(["a b c d"], 2) == "a b" and lines.symmetric(rows, 100) == "\n".join(rows)
    df = spark.createDataFrame([("# head\n" + "\n".join(rows),), (None,)], "t string").select(lines.symmetric_cut(F.col("t"), 4).alias("c")).collect()
    assert [r["c"] for r in df] == [symmetric_plain(rows, 4), None]


def test_pages_by_title(spark):
    pages = spark.createDataFrame([("a@1", "P", "text")], "doc_set string, title string, content string")
    assert corpus.content_of(pages, "P") == "text" and corpus.content_of(pages, "P", "a@1") == "text"
    for args in (("Q",), ("P", "b@1")):
        with pytest.raises(corpus.CorpusError):
            corpus.content_of(pages, *args)
    with pytest.raises(ValueError):
        retrieval.extract(pages, pages.select("title"), "no mode")
    assert retrieval.extract(pages, pages.select("title"), "fuzzy").first()["mode"] == "fuzzy"


def test_index_of_files(spark, tmp_path):
    for i, text in enumerate(["alpha beta\n" * 3 + "gamma\n", "beta only\r\nalpha"]):
        (tmp_path / f"{i}.md").write_text(text)
    index = bm25.build_from_files(spark, str(tmp_path / "*.md"), bm25.Params(stemmed=False), most_lines=2)
    got = {(r["doc"][-4:], r["term"]): r["tf"] for r in index.tf.collect()}
    assert got == {("0.md", "alpha"): 2, ("0.md", "beta"): 2, ("1.md", "beta"): 1, ("1.md", "only"): 1, ("1.md", "alpha"): 1}


def test_similarities_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 8)))]
    c = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    q = spark.createDataFrame(rows[::10], "query_id long, v array<double>")
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    sim = x[::10] @ x.T
    for mb in (64, 0.0004):
        got = {(r["query_id"], r["id"]): r["sim"] for r in ranking.in_blocks(q, c, lambda a, m, ids, v: (np.repeat(a, len(ids)), list(ids) * len(a), (m @ v.T).ravel()), "query_id long, id long, sim double", mb).collect()}
        assert len(got) == 30 * 300 and all(abs(got[10 * a, b] - sim[a, b]) < 1e-12 for a in range(30) for b in range(300))
    top = {(r["query_id"], r["rank"]): r["id"] for r in ranking.nearest(q, c, 3).collect()}
    assert all(top[10 * a, k + 1] == int(np.argsort(-np.round(sim[a], 6), kind="stable")[k]) for a in range(30) for k in range(3))
    best = {r["id"]: r["sim"] for r in ranking.most_similar(q, c).collect()}
    assert all(abs(best[i] - sim[:, i].max()) < 1e-12 for i in range(300))


def test_encoder_in_batches(spark):
    from lakeloom.functions import vectors

    def encode(texts):
        assert 0 < len(texts) <= 3 and len(set(texts)) == len(texts)
        return [[len(t), 0.0 if t == "" else 1.0] for t in texts]

    rows = [(i, t) for i, t in enumerate(["a", "bb", None, "a", "", "ccc", "dddd", "bb"])]
    got = {r["i"]: r["v"] for r in spark.createDataFrame(rows, "i int, t string").coalesce(1).select("i", vectors.encoder(encode, 3)(F.col("t")).alias("v")).collect()}
    assert got[2] is None and got[4] == [0.0, 0.0] and got[0] == got[3] == pytest.approx([0.5**0.5] * 2) and got[5] == pytest.approx([3 / 10**0.5, 1 / 10**0.5])


def test_blocks_of_answers(spark):
    from lakeloom.plans import steps

    assert steps.read_blocks("t") == ("t", None) and steps.read_blocks(None) == (None, None)
    assert steps.read_blocks([{"type": "thinking", "thinking": "h"}, {"type": "text", "text": "a"}, {"type": "other"}, {"type": "text", "text": "b"}]) == ("a\nb", "h")
    assert steps.missing_keys("a", "b")('x {"a": 1} y') == ["b"] and steps.missing_keys("a")("none") == ["a"]
    calls = []

    def ask(prompt):
        calls.append(prompt)
        return [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": '{"a": 1}' if "lacked" in prompt else "{}"}]

    row = spark.createDataFrame([("q",)], "t string").select(steps.ask_all(F.col("t"), ask, steps.missing_keys("a")).alias("x")).first()["x"]
    assert (row["answer"], row["faults"], row["tries"], row["thinking"]) == ('{"a": 1}', [], 2, "hm")


@pytest.mark.parametrize("at", [0, 3_000, 80_000])
def test_charset_by_the_whole_body(at):
    """What tells the encoding may stand anywhere: characters, or the page's own word for it."""
    pad = "a" * at
    gbk = (pad + "中文网页内容" * 40).encode("gbk")
    assert charset.text_of(gbk) == pad + "中文网页内容" * 40
    page = (pad + "<meta charset='windows-1251'>Привет").encode("cp1251")
    assert charset.text_of(page) == page.decode("cp1251")
    utf8 = (pad + "é" * 50_000).encode()
    assert charset.text_of(utf8) == utf8.decode()
    assert charset.text_of(utf8 + b"\xff").startswith(pad)


def test_paths_of_many_segments(spark):
    """No segment of a path is dropped, however many there are."""
    from pyspark.sql import functions as F

    long = "/".join(["a", "b", ".."] * 6_000) + "/end"
    got = spark.createDataFrame([("http://h/x/y", long)], "b string, r string").select(urls.joined(F.col("b"), F.col("r")).alias("u")).first()["u"]
    assert got == "http://h/x/" + "a/" * 6_000 + "end"
