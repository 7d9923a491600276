import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeloom.functions import html
from lakeloom.functions.html import Options


def md(page, **o):
    return html.read_page("http://h.example.com/a/b.html", page, Options(**o))[7]


def test_boilerplate_goes():
    page = "<body><nav>menu</nav><div class='sidebar'>side</div><article><h1>T</h1><p>Body text</p><aside>note</aside></article><footer>foot</footer></body>"
    assert md(page) == "# T\n\nBody text"


def test_standard_mode_does_not_look_for_the_main_part():
    assert md("<div><p>one</p></div><nav>x</nav><article><p>two</p></article>", enhanced=False) == "one\n\ntwo"


def test_protection():
    page = "<main><div class='menu-like'><p>kept, as it is inside main</p></div><nav>gone</nav></main>"
    assert md(page) == "kept, as it is inside main"
    assert "kept" not in md(page, force=[".menu-like"])


def test_logs_in_code_go():
    assert md("<article><pre>INFO: started</pre><pre>x = 1</pre></article>") == "```\nx = 1\n```"


def test_markdown():
    page = "<article><p>a <b>b</b> <i>c</i> <a href='../x'>l</a><br>n</p><ul><li>1<ul><li>2</ul><li>3</ul><blockquote>q</blockquote><hr><table><tr><th>h<th>i<tr><td>1<td>2|3</table></article>"
    assert md(page) == "a **b** _c_ [l](http://h.example.com/x)  \nn\n\n  * 1\n    * 2\n  * 3\n\n> q\n\n* * *\n\nh | i\n---|---\n1 | 2\\|3"


def test_scripts_and_entities():
    assert md('<article><script>var t="</p>";</script><p>a &lt;b&gt; &amp; c&nbsp;d</p><style>p{}</style></article>') == "a <b> & c d"


def test_end_marks_and_phrases():
    page = "<article><p>Skip to main content</p><p>text</p><h2>See  also</h2><p>gone</p></article>"
    assert md(page) == "text"
    assert "gone" in md(page, end_marks=[])


def test_images():
    page = "<article><img src='i.png' alt='x'><img data-src='/lazy.png'></article>"
    assert md(page, image_hosts=["lazy"]) == "![x](http://h.example.com/a/i.png)![](http://h.example.com/lazy.png)\nhttp://h.example.com/lazy.png"


def test_diagrams_stay_in_place():
    svg = "<svg class='flowchart'><g class='nodes'><g class='node decision' id='flowchart-A-0'><span class='nodeLabel'><p>Ask [x]</p></span></g><g class='node' id='flowchart-B-1'><text>End</text></g></g><g class='edgeLabels'><g class='edgeLabel'><span class='edgeLabel'>yes</span></g></g><path id='L_A_B_0'></path></svg>"
    got = md(f"<article><p>before</p>{svg}<p>after</p><pre class='mermaid'>graph TD\\nA--&gt;B</pre></article>")
    assert got == 'before\n\n```mermaid\nflowchart TB\n    A{"Ask &#91;x&#93;"}\n    B["End"]\n    A -- "yes" --> B\n```\n\nafter\n\n```mermaid\ngraph TD\nA-->B\n```'


def test_titles():
    page = lambda h, u="http://h.example.com/p/q": html.title_of(html.parse(h), u)
    assert page("<title> T </title><h1>H</h1>") == "T"
    assert page("<title></title><h1>H</h1>") == "H"
    assert page("") == "q"
    assert page("", "http://h.example.com/") == "h.example.com"


@pytest.mark.parametrize("page,needs", [
    ("<template data-nextjs-router='push'></template>", True), ("<div data-component-name='mermaid-container'></div>", True), ("<div data-component-name='mermaid-container'>long enough text</div>", False),
    ("<div data-ice></div>", True), ("<p class='x client-only'>", True), ("<div></div>" * 11, True), ("<div></div>" * 10, False), ("<p>static</p>", False),
])
def test_rendering(page, needs):
    assert html.needs_rendering(html.parse(page)) is needs


@pytest.mark.parametrize("page,inside", [
    ("<ul class='toc'><li><a href='#x'>", True), ("<li class='nav-item'><a href='#x'>", True), ("<a class='toc-link' href='#x'>", True), ("<div id='Sidebar'><p><a href='#x'>", True),
    ("<div class='prose'><a href='#x'>", False), ("<a class='anchor' href='#x'>", False), ("<p><a href='#x'>", False),
])
def test_membership_of_toc(page, inside):
    assert html.in_toc(html.parse(page).all("a")[0]) is inside


def test_anchors_are_filtered():
    page = "<nav class='toc'><a href='#one'>One</a><a href='#two'>Two</a><a href='/x'>x</a></nav>"
    names = lambda **o: [a[0] for a in html.anchors_of(html.parse(page), "u", Options(**o))]
    assert names() == ["one", "two"] and names(toc_exclude=["ONE"]) == ["two"] and names(toc_include=["two"]) == ["two"] and names(toc_include=["#"]) == ["one", "two"]
    assert names(toc_selector=".other") == []


def test_selectors():
    n = html.parse('<div id="a" class="b c" data-x="hello world"></div>').kids[0]
    for s, want in (("div", 1), ("#a", 1), (".b.c", 1), ("div#a.b", 1), ('[data-x*="lo w"]', 1), ('[data-x="hello"]', 0), ("[data-x]", 1), ("span, .c", 1), ("p", 0), ('[data-x^="he"]', 1), ('[data-x$="ld"]', 1), ('[data-x~="world"]', 1)):
        assert html.selector(s)(n) == bool(want), s


def test_options_merge():
    o = Options().merged(fuzzy=["extra"], phrases=["p"])
    assert "extra" in o.fuzzy and "sidebar" in o.fuzzy and Options().merged("replace", fuzzy=["only"]).fuzzy == ["only"]


def test_frameworks():
    assert html.framework_of(html.parse(""), "<div class='VPDoc'>") == "vitepress"
    assert html.framework_of_url("https://x.gitbook.io/a") == "gitbook" and html.framework_of_url("https://x/docs/a") == "docusaurus"


@given(st.text(alphabet="<>/ab='\" pdivul-!&;", max_size=150))
@settings(max_examples=150, deadline=None)
def test_any_markup_is_read(page):
    html.read_page("http://h/", page, Options())


def test_column(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("http://h/", "<title>t</title><a href='#x'>x</a>"), (None, None)], "u string, h string").select(html.page(F.col("u"), F.col("h")).alias("p"))
    rows = [r["p"] for r in df.collect()]
    assert [r["title"] for r in rows] == ["t", ""] and [len(r["links"]) for r in rows] == [1, 0]


def test_deep_pages():
    """Elements nested to any depth are what they are at the top."""
    page = "<article>" + "<div>" * 50_000 + "<p>deep <b>text</b></p>" + "</div>" * 50_000 + "<p>after</p></article>"
    assert md(page) == "deep **text**\n\nafter"
    assert "in" in md("<article>" + "<span>" * 30_000 + "in" + "</span>" * 30_000 + "</article>")
    assert md("<article>" + "<div>" * 200 + "<ul><li>a<ul><li>b</ul></ul><script>x</script>") == "* a\n    * b"
    deep = md("<article>" + "<ul><li>" * 500 + "leaf")
    assert deep.split("\n")[-1] == "  " * 500 + "* leaf" and len(deep.split("\n")) == 500
    quoted = md("<article>" + "<blockquote>" * 300 + "q")
    assert quoted == "> " * 300 + "q"


def test_many_open_elements():
    """End tags of what is not open cost nothing, however many elements are."""
    html.parse("<font>" * 20_000 + "</b>" * 20_000)


COMBINED = "<div id='r'><ul class='nav'><li><b class='item'>1</b></li></ul><p>2</p><span>3</span><i>4</i></div>"


@pytest.mark.parametrize("text,want", [
    (".nav .item", ["b"]), ("#r .item", ["b"]), ("div > p", ["p"]), ("div > .item", []), ("ul > li > b", ["b"]), ("div li > *", ["b"]), ("p + span", ["span"]), ("p + i", []),
    ("p ~ i", ["i"]), ("ul.nav>li", ["li"]), ("p, .nav .item", ["b", "p"]), ("div div", []), ("* > ul ~ span", ["span"]),
])
def test_combinators(text, want):
    assert [n.tag for n in html.parse(COMBINED).walk() if html.selector(text)(n)] == want


@pytest.mark.parametrize("text", ["a:hover", "p::before", ".", "a >", "> a", "a,,b", "[x", "a || b"])
def test_selectors_that_are_not_supported(text):
    with pytest.raises(ValueError):
        html.selector(text)


def test_selectors_take_content_out():
    page = "<article><ul class='list'><li class='item'>out</li></ul><p class='item'>stays</p></article>"
    assert md(page, force=[".list .item"]) == "stays" and md(page, force=["article > .item"]) == "* out"


def test_links_are_rewritten_in_place():
    page = "<a href='../x?a=1&amp;b=2' title='t'>l</a> text <img\n data-src=i.png src = \"/r.png\"><p style=\"color:red;background:url('b.png')\">&amp;</p><script src='//cdn.example.org/s.js'>var a = \"<a href='no'>\";</script><a href='#f'>f</a><a href='mailto:x'>m</a><td background='no.png'><!-- <a href='no'> -->"
    got, n = html.absolute_page("http://h.example.com/a/b.html", page)
    assert got == "<a href='http://h.example.com/x?a=1&amp;b=2' title='t'>l</a> text <img\n data-src=\"http://h.example.com/a/i.png\" src = \"http://h.example.com/r.png\"><p style=\"color:red;background:url(&quot;http://h.example.com/a/b.png&quot;)\">&amp;</p><script src='http://cdn.example.org/s.js'>var a = \"<a href='no'>\";</script><a href='#f'>f</a><a href='mailto:x'>m</a><td background='no.png'><!-- <a href='no'> -->"
    assert n == 5 and html.absolute_page(None, None) == ("", 0)


def test_hooks():
    o = Options(before=lambda h, u: h.replace("old", "new"), after=lambda m, u: m + "\n" + u)
    assert html.read_page("http://h/", "<article><p>old</p></article>", o, ("markdown", "title")) == ("new\nhttp://h/", "h")


def test_options_of_a_file(tmp_path):
    import json

    (tmp_path / "c.json").write_text(json.dumps({"filter": {"fuzzy": ["extra"], "enhanced": False}}))
    o = Options.from_file(str(tmp_path / "c.json"))
    assert not o.enhanced and "extra" in o.fuzzy and "sidebar" in o.fuzzy and Options.from_file(str(tmp_path / "c.json"), "replace").fuzzy == ["extra"]


def test_fields(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("http://h/", "<title>t</title>")], "u string, h string").select(html.page(F.col("u"), F.col("h"), fields=["title"]).alias("p"))
    assert df.schema["p"].dataType.names == ["title"] and df.first()["p"]["title"] == "t"
    with pytest.raises(ValueError):
        html.page(F.col("u"), F.col("h"), Options(remove=["a:hover"]))
