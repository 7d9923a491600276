"""HTML pages: parsing, boilerplate removal, links, table of contents, diagrams, Markdown.

A page is parsed once, in an Arrow-batched UDF that gives a struct with all that later steps read; everything else is
column expressions. Parsing takes any markup: what is not closed ends with its parent.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser
from itertools import islice
from urllib.parse import unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: What an opening tag ends, if it is the innermost one open.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}} | {t: {"p"} for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()}

# Selectors, words and marks that decide what is boilerplate, navigation or content.
SEMANTIC = ["aside", "nav", "footer", "header", "navigation", "banner", "contentinfo", "complementary", '[role="navigation"]', '[role="banner"]', '[role="complementary"]', '[role="contentinfo"]', '[role="directory"]']
GENERAL = [
    "#sidebar", ".sidebar", ".side-bar", ".side-panel", '[class*="sidebar"]', '[class*="sideBar"]', '[class*="side-bar"]',
    "#toc", "#table-of-contents", "#index", "#directory", "#menu", "#navigation", "#ad", "#footer", "#header", "#breadcrumb",
    ".nav", ".navigation", ".navbar", ".nav-bar", '[class*="navigation"]', '[class*="navbar"]', '[class*="nav-bar"]', '[class*="breadcrumb"]', '[class*="breadcrumbs"]', '[class*="menu"]', '[class*="pagination"]',
    ".toc", ".table-of-contents", ".toc-container", '[class*="toc"]', '[class*="TableOfContents"]',
    ".footer", ".page-footer", '[class*="footer"]', ".ad", ".advertisement", ".popup", ".modal", ".banner", '[class*="popup"]', '[class*="modal"]', '[class*="banner"]',
    ".widget", ".toolbox", ".toolbar", '[class*="widget"]', '[class*="toolbar"]', ".btn", '[class*="btn-"]', '[class*="button"]',
    ".prev", ".next", ".pagination", ".pager", '[class*="prevnext"]', '[class*="prev-next"]', ".search", '[class*="search"]', ".feedback", '[class*="feedback"]', ".was-this-helpful", '[class*="helpful"]',
    ".share", '[class*="share"]', '[class*="social"]', ".console", ".terminal", '[class*="console"]', ".toclimit-2", ".toclimit-3", ".mw-workspace-container", '[class*="mintlify-"]', ".mx-auto.flex", ".sticky", ".tooltip", '[class*="new-right"]',
]
FUZZY = ["sidebar", "navigation", "navbar", "menu", "modal", "cookie", "notification", "popup", "tooltip", "pagination", "breadcrumb", "footer", "header", "prevnext", "feedback", "share"]
PRESERVE = ["article", "main", '[role="main"]', ".content", ".post-content", ".article-content", ".markdown-body", ".prose", ".mdx", '[class*="main-content"]', '[class*="article-body"]', '[class*="post-body"]']
UNPROTECTED = ["footer", "aside", "nav"]
LOG_LEVELS = ["INFO:", "info:", "Info:", "DEBUG:", "debug:", "Debug:", "WARNING:", "warning:", "Warning:", "ERROR:", "error:", "Error:", "CRITICAL:", "critical:", "Critical:"]
CODE = ["code", "pre", '[class*="code"]', '[class*="pre"]', '[class*="snippet"]', '[class*="terminal"]', '[class*="console"]']
PHRASES = ["Skip to main content", "__Back to top", "Back to top", "Table of contents", "On this page"]
#: As plain text: a mark matches itself, its blanks any blanks.
END_MARKS = ["Next steps", "Next step", "Further reading", "See also", "References", "Related", "Was this page helpful?", "Was this article helpful?", "Was this doc helpful?", "Did you find this", "Did you like this"]
TOC_END_MARKS = ["See also", "Related articles", "Related article", "Further reading", "External links", "External link", "References", "Related skills", "More skills", "Other skills", "You might also like", "Continue reading", "Next steps", "Next up"]
PRESETS = {
    "mintlify": ['[class*="sidebar"]', '[class*="navigation"]', '[class*="navbar"]', '[class*="pagination"]', '[class*="prevnext"]', '[class*="footer"]', '[class*="toc"]', '[class*="mintlify-"]', ".mx-auto.flex", ".sticky"],
    "docusaurus": ['[class*="sidebar"]', '[class*="navbar"]', '[class*="footer"]', '[class*="toc"]', ".menu", ".table-of-contents"],
    "vitepress": [".VPNav", ".VPSidebar", ".VPFooter", ".VPLocalNav"],
    "gitbook": [".gitbook-sidebar", ".gitbook-navigation", '[class*="navigation"]'],
}
URL_SIGNATURES = {"mintlify": ["mintlify.app", "mintlify.com", "_mintlify"], "docusaurus": ["docusaurus.io", "/docs/"], "vitepress": ["vitepress.dev", "vitepress"], "gitbook": ["gitbook.io", "gitbook.com"]}
TOC_CLASSES = ["toc", "table-of-contents", "navigation", "sidebar", "menu", "directory", "index", "content-side-layout"]
TOC_LINK_CLASSES = ["toc-item", "toc-link", "nav-item", "nav-link", "menu-item", "menu-link", "directory-item"]
TOC_PARENT_CLASSES = ["toc-item", "nav-item", "menu-item"]
GOOD_WORDS = ["content", "article", "post", "main", "body", "markdown", "prose", "mdx", "text"]
BAD_WORDS = ["sidebar", "nav", "menu", "footer", "header", "ad", "banner", "toc", "pagination"]
LINK_ATTRIBUTES = {"a": ["href"], "link": ["href"], "script": ["src"], "img": ["src"], "iframe": ["src"], "form": ["action"], "meta": ["content"], "object": ["data"], "embed": ["src"], "source": ["src"], "audio": ["src"], "video": ["src"], "track": ["src"], "applet": ["code"], "frame": ["src"], "portal": ["src"], "button": ["formaction"], "input": ["src", "formaction"], "area": ["href"], "base": ["href"]}
SHAPES = {"startend": "()", "process": "[]", "decision": "{}", "subroutine": ("[[", "]]"), "inputoutput": ("[/", "/]"), "unknown": "[]"}
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]


@dataclass(frozen=True)
class Options:
    """What is taken out of a page. `merged` adds to the lists or puts others in their place."""

    enhanced: bool = True
    remove: list[str] = field(default_factory=lambda: SEMANTIC + GENERAL)
    fuzzy: list[str] = field(default_factory=lambda: list(FUZZY))
    preserve: list[str] = field(default_factory=lambda: list(PRESERVE))
    force: list[str] = field(default_factory=list)
    unprotected: list[str] = field(default_factory=lambda: list(UNPROTECTED))
    code: list[str] = field(default_factory=lambda: list(CODE))
    levels: list[str] = field(default_factory=lambda: list(LOG_LEVELS))
    phrases: list[str] = field(default_factory=lambda: list(PHRASES))
    end_marks: list[str] = field(default_factory=lambda: list(END_MARKS))
    toc_end_marks: list[str] = field(default_factory=lambda: list(TOC_END_MARKS))
    detect: bool = True
    toc_selector: str = ""
    toc_include: list[str] = field(default_factory=list)
    toc_exclude: list[str] = field(default_factory=list)
    image_hosts: list[str] | None = None
    #: before(html, url) is called on a page before it is read, after(markdown, url) on its finished Markdown.
    before: Callable[[str, str], str] | None = None
    after: Callable[[str, str], str] | None = None

    @classmethod
    def from_file(cls, path: str, how: str = "extend", section: str = "filter") -> Options:
        """Lists and switches of a JSON file, of its section if there is one; lists are added to the usual ones or stand
        in their place, names that are no option are an error."""
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        found = found.get(section, found)
        lists = {k: v for k, v in found.items() if isinstance(v, list)}
        return replace(cls(), **{k: v for k, v in found.items() if k not in lists}).merged(how, **lists)

    def merged(self, how: str = "extend", **lists: list[str]) -> Options:
        return replace(self, **{k: list(dict.fromkeys([*(getattr(self, k) or []), *v])) if how == "extend" else list(v) for k, v in lists.items()})


class Node:
    __slots__ = ("tag", "attrs", "kids", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.kids, self.parent = tag, attrs, [], parent

    def walk(self) -> Iterator[Node]:
        """All nodes below, in the order of the page."""
        stack = [k for k in reversed(self.kids) if isinstance(k, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack += [k for k in reversed(n.kids) if isinstance(k, Node)]

    def up(self) -> Iterator[Node]:
        n = self.parent
        while n is not None and n.tag:
            yield n
            n = n.parent

    def text(self, strip: bool = False) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n.strip() if strip else n)
            elif n is self or n.tag not in ("script", "style", "template"):
                stack += reversed(n.kids)
        return "".join(out)

    def all(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def drop(self) -> None:
        if self.parent is not None:
            self.parent.kids = [k for k in self.parent.kids if k is not self]
            self.parent = None

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    @property
    def id(self) -> str:
        return self.attrs.get("id", "")


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.open: Counter[str] = Counter()

    def leave(self):
        self.open[self.at.tag] -= 1
        self.at = self.at.parent

    def handle_starttag(self, tag, attrs):
        while self.at.tag in ENDS.get(tag, ()):
            self.leave()
        n = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.kids.append(n)
        if tag not in VOID:
            self.at = n
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.open[tag]:
            while self.at.tag != tag:
                self.leave()
            self.leave()

    def handle_data(self, data):
        self.at.kids.append(data)


def closed_references(names: tuple[str, ...], tag: str = "") -> Callable[[str, str], str]:
    """A `before` for Options that leaves only these character references to be decoded, and those only with their semicolon; all
    else stays as it is written. tag: only in the first element of that tag."""
    other = re.compile(f"&(?!(?:{'|'.join(map(re.escape, names))});)")
    inside = re.compile(rf"(?is)(<{re.escape(tag)}(?:\s[^>]*)?>)(.*?)(?=</{re.escape(tag)}\s*>)") if tag else None

    def before(html: str, url: str) -> str:
        if inside is None:
            return other.sub("&amp;", html)
        return inside.sub(lambda m: m[1] + other.sub("&amp;", m[2]), html, count=1)

    return before


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def without(root: Node, gone: set[int]) -> None:
    """Takes the nodes out of the tree whose id() is in `gone`."""
    if gone:
        for n in [root, *root.walk()]:
            if any(id(k) in gone for k in n.kids):
                for k in n.kids:
                    if id(k) in gone:
                        k.parent = None
                n.kids = [k for k in n.kids if id(k) not in gone]


def unrolled(step: Generator):
    """What a recursive function returns that is written as a generator and yields its calls; trees can have any depth."""
    stack, value = [step], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as e:
            stack.pop()
            value = e.value
    return value


_SIMPLE = re.compile(r"""(\*|[a-zA-Z][\w-]*)|#([\w-]+)|\.([\w-]+)|\[\s*([\w-]+)\s*(?:([*^$~|]?=)\s*(?:"([^"]*)"|'([^']*)'|([^"'\]\s]*))\s*)?\]""")
_BETWEEN = re.compile(r"\s*([,>+~])\s*|\s+")


def compound(text: str, at: int):
    """(simple selectors from there on, where they end)."""
    out = []
    while m := _SIMPLE.match(text, at):
        tag, id_, cls, attr, op, *values = m.groups()
        if tag and out:
            break
        out.append((tag and tag.lower(), id_, cls, attr and attr.lower(), op, next((v for v in values if v is not None), "")))
        at = m.end()
    if not out:
        raise ValueError(f"not a selector that is supported here: {text!r}")
    return out, at


def chains(text: str) -> list[list]:
    """[compound, combinator, compound, ...] for each of several selectors with commas between them."""
    text, at, out = text.strip(), 0, [[]]
    while text:
        one, at = compound(text, at)
        out[-1].append(one)
        if at == len(text):
            return out
        m = _BETWEEN.match(text, at)
        if not m:
            raise ValueError(f"not a selector that is supported here: {text!r}")
        at = m.end()
        if m[1] == ",":
            out.append([])
        else:
            out[-1].append(m[1] or " ")
    return []


def fits(n: Node, one: list) -> bool:
    for tag, id_, cls, attr, op, value in one:
        if tag and tag != "*" and n.tag != tag or id_ and n.id != id_ or cls and cls not in n.classes:
            return False
        if attr:
            have = n.attrs.get(attr)
            if have is None:
                return False
            if op and not {"=": have == value, "*=": bool(value) and value in have, "^=": bool(value) and have.startswith(value), "$=": bool(value) and have.endswith(value), "~=": value in have.split(), "|=": have == value or have.startswith(value + "-")}[op]:
                return False
    return True


def chain_fits(n: Node, chain: list) -> bool:
    """Whether n is what a chain of compounds ends with: descendants, children (>), next (+) and later siblings (~)."""
    if not fits(n, chain[-1]):
        return False
    if len(chain) == 1:
        return True
    how, rest = chain[-2], chain[:-2]
    if how in " >":
        return any(chain_fits(u, rest) for u in (n.up() if how == " " else islice(n.up(), 1)))
    before = []
    for k in n.parent.kids if n.parent is not None else ():
        if k is n:
            break
        if isinstance(k, Node):
            before.append(k)
    return any(chain_fits(k, rest) for k in (before if how == "~" else before[-1:]))


@lru_cache(maxsize=256)
def any_of(selectors: tuple[str, ...]) -> Callable[[Node], bool]:
    """A test of nodes for any of the selectors. Single tags, ids, classes and parts of class attributes are looked up;
    what is more is tried one by one."""
    tags, ids, classes, parts, rest = set(), set(), set(), [], []
    for text in selectors:
        for chain in chains(text):
            tag, id_, cls, attr, op, value = chain[0][0]
            single = len(chain) == len(chain[0]) == 1
            if single and tag and tag != "*":
                tags.add(tag)
            elif single and id_:
                ids.add(id_)
            elif single and cls:
                classes.add(cls)
            elif single and attr == "class" and op == "*=" and value:
                parts.append(value)
            else:
                rest.append(chain)
    part = re.compile("|".join(map(re.escape, parts)) if parts else r"(?!)")

    def test(n: Node) -> bool:
        if n.tag in tags:
            return True
        if n.attrs:
            cls = n.attrs.get("class")
            if cls is not None and (part.search(cls) or not classes.isdisjoint(cls.split())) or ids and n.attrs.get("id") in ids:
                return True
        return any(chain_fits(n, c) for c in rest)

    return test


def selector(text: str) -> Callable[[Node], bool]:
    """A test of nodes for a selector, or several with commas between them: tags, ids, classes, attributes, and blanks,
    >, + and ~ between them. Anything else is an error."""
    return any_of((text,))


def title_of(root: Node, url: str) -> str:
    """The title element, else the first h1, else the last part of the path, else the host."""
    for tag in ("title", "h1"):
        for n in root.all(tag):
            if text := n.text().strip():
                return text
            break
    parts = urlsplit(url or "")
    return parts.path.rpartition("/")[2] if parts.path not in ("", "/") and parts.path.rpartition("/")[2] else parts.netloc


def framework_of(root: Node, html: str, url: str = "") -> str:
    low = html.lower()
    marks = {"mintlify": ["mintlify"], "docusaurus": ["docmaincontainer", "docusaurus"], "vitepress": ["vpdoc", "vitepress"], "gitbook": ["gitbook"]}
    return next((k for k, words in marks.items() if any(w in low for w in words) or k == "mintlify" and k in url.lower()), "")


def framework_of_url(url: str) -> str:
    return next((k for k, words in URL_SIGNATURES.items() if any(w in url.lower() for w in words)), "")


def content_scores(root: Node) -> dict[int, int]:
    """By id() of the div, section and article nodes. What stands in a node is summed up from the leaves."""
    order = [root, *root.walk()]
    total = {id(n): [0, 0, 0, 0, 0] for n in order}  # size of the text, p, h1, h2, pre and code
    scores = {}
    for n in reversed(order):
        mine = total[id(n)]
        mine[0] += sum(len(k.strip()) for k in n.kids if isinstance(k, str))
        if n.tag in ("div", "section", "article"):
            size, p, h1, h2, code = mine
            named = " ".join(n.classes).lower() + "\n" + n.id.lower()
            score = sum(10 for w in GOOD_WORDS if w in named) - sum(20 for w in BAD_WORDS if w in named)
            score += 5 if size > 500 else -10 if size < 100 else 0
            scores[id(n)] = max(0, score + 3 * (p > 3) + 5 * (h1 > 0) + 2 * (h2 > 0) + code)
        if n.parent is not None and id(n.parent) in total:
            up = total[id(n.parent)]
            up[0] += mine[0] if n.tag not in ("script", "style", "template") else 0
            for k, tags in enumerate((("p",), ("h1",), ("h2",), ("pre", "code")), 1):
                up[k] += mine[k] + (n.tag in tags)
    return scores


def content_score(n: Node) -> int:
    return content_scores(n)[id(n)]


def main_area(root: Node) -> Node | None:
    """The first article, else main, else role=main, else what scores best, else the body."""
    for tag in ("article", "main"):
        if found := root.all(tag):
            return found[0]
    for n in root.walk():
        if n.attrs.get("role") == "main":
            return n
    scores = content_scores(root)
    best = max(root.all("div", "section", "article"), key=lambda n: scores[id(n)], default=None)
    return best if best is not None and scores[id(best)] > 0 else next(iter(root.all("body")), None)


def prune(root: Node, o: Options, html: str = "", url: str = "") -> Node:
    """The page without what is not content: forced selectors, then selectors and fuzzy names unless they are protected
    (a protected element, or one that stands in or around one; some tags never are)."""
    remove = list(o.remove)
    if o.enhanced:
        if o.detect:
            remove += PRESETS.get(framework_of(root, html, url), [])
        area = main_area(root)
        if area is not None and area.tag != "body":
            without(root, {id(area)})
            area.parent = root = Node("", {}, None)
            root.kids = [area]
        force = any_of(tuple(o.force))
        without(root, {id(n) for n in root.walk() if force(n)})
    order = list(root.walk())
    held = safe = set()
    if o.enhanced:
        keep = any_of(tuple(o.preserve))
        held = {id(n) for n in order if keep(n)}
        for n in [n for n in order if id(n) in held]:
            for u in n.up():
                if id(u) in held:
                    break
                held.add(id(u))
        safe = set()
        for n in order:  # parents come first
            if id(n) in held or id(n.parent) in safe:
                safe.add(id(n))
            if n.tag in o.unprotected and id(n.parent) not in safe:
                safe.discard(id(n))
    test, fuzzy = any_of(tuple(remove)), [w for w in o.fuzzy]
    gone = set()
    for n in order:
        if n.tag not in o.unprotected and id(n) in safe:
            continue
        named = " ".join(n.classes).lower() + "\n" + n.id.lower() if n.attrs else ""
        if test(n) or named and any(w in named for w in fuzzy):
            gone.add(id(n))
    without(root, gone)
    return drop_logs(root, o)


def drop_logs(root: Node, o: Options) -> Node:
    """Code blocks with log output go; without `enhanced` other elements named for logs too."""
    level = re.compile("|".join(map(re.escape, o.levels))) if o.levels else re.compile(r"(?!)")
    code, gone = any_of(tuple(o.code)), set()
    for n in root.walk():
        named = " ".join(n.classes).lower() + "\n" + n.id.lower() if n.attrs else ""
        is_log = code(n) or not o.enhanced and n.tag not in ("code", "pre") and any(w in named for w in ("log", "logging", "debug", "output"))
        if is_log and id(n.parent) not in gone and level.search(n.text()):
            gone.add(id(n))
    without(root, gone)
    return root


def absolute(url: str, base: str) -> str:
    if not url or url.startswith(("http://", "https://", "mailto:", "tel:", "#")):
        return url
    try:
        return urljoin(base, url)
    except ValueError:
        return url


def links_of(root: Node) -> list[tuple[str, str, str]]:
    """(tag, attribute, value) wherever a tag can point somewhere."""
    return [(n.tag, a, n.attrs[a]) for n in root.walk() for a in LINK_ATTRIBUTES.get(n.tag, ()) if a in n.attrs]


def in_toc(a: Node) -> bool:
    """Whether a link is part of a table of contents: by its parent's class, its own, its ancestors' classes and ids; else
    links of the text or in content areas are not, nor is any other."""
    named = lambda n: " ".join(n.classes).lower()
    if a.parent is not None and any(p in named(a.parent) for p in TOC_PARENT_CLASSES) or any(p in named(a) for p in TOC_LINK_CLASSES):
        return True
    return any(p in named(u) or p in u.id.lower() for u in islice(a.up(), 10) for p in TOC_CLASSES)


def anchor_level(name: str, by_id: dict[str, Node], fuzzy: list[str]) -> int:
    n = by_id.get(name)
    if n is not None:
        tag = n.tag
        if tag == "section":
            tag = next((k.tag for k in n.walk() if k.tag in HEADINGS), tag)
        if tag in HEADINGS[1:]:
            return min(4, int(tag[1]) - 1)
    low = name.lower()
    if "#" in fuzzy or any(f.lower() in low for f in fuzzy if f):
        return 1
    for level, words in enumerate((("chapter", "section", "part"), ("sub", "topic"), ("item", "detail", "note")), 1):
        if any(w in low for w in words):
            return level
    return 4


def wanted_anchor(name: str, text: str, o: Options) -> bool:
    both = [name.lower(), text.lower()]
    if any(p and any(p.lower() in b for b in both) for p in o.toc_exclude):
        return False
    include = [p.lower() for p in o.toc_include if p]
    return not include or "#" in include or any(p in b for p in include for b in both)


def cut_at(items: list, marks: list[str], text=lambda x: x, markdown: bool = False) -> list:
    """The items before the first whose text begins with a mark, in its own case; in Markdown after ## and a number."""
    if not marks:
        return items
    start = r"^(?:##+\s*)?(?:\d+\.\s*)?" if markdown else r"^\s*"
    test = re.compile(start + "(?:" + "|".join(r"\s+".join(map(re.escape, m.split())) for m in marks if m.split()) + ")")
    return items[: next((i for i, x in enumerate(items) if test.search(text(x))), len(items))]


def anchors_of(root: Node, url: str, o: Options) -> list[tuple[str, str, str, int]]:
    """(name, text, url, level) of the table of contents, once for each URL, up to an end mark."""
    by_id: dict[str, Node] = {}
    for n in root.walk():
        if n.id:
            by_id[n.id] = by_id[unquote(n.id)] = n
    box = any_of((o.toc_selector,))
    inside = [a for b in root.walk() if box(b) for a in b.all("a")] if o.toc_selector else [a for a in root.all("a") if in_toc(a)]
    out, seen = [], set()
    for a in inside:
        href = a.attrs.get("href", "")
        if not href.startswith("#") or url + href in seen:
            continue
        seen.add(url + href)
        name, text = href[1:], unquote(a.text(strip=True)) or href[1:]
        level = anchor_level(unquote(name), by_id, o.toc_include)
        if wanted_anchor(name, text, o):
            out.append((name, text, url + href, level if level < 4 else anchor_level(name, by_id, o.toc_include)))
    return cut_at(out, o.toc_end_marks, lambda x: x[1].strip())


def numbered(levels: list[int]) -> list[str]:
    """Numbers such as 1.2.1; a level without one above it counts from 0 there."""
    count, out = [0, 0, 0, 0], []
    for level in levels:
        count[level - 1] += 1
        count[level:] = [0] * (4 - level)
        out.append(".".join(map(str, count[:level])))
    return out


def needs_rendering(root: Node, forced: bool = False) -> bool:
    """Whether scripts fill the page: templates that bail out, diagram boxes left empty, client-only or many empty boxes,
    marks of frameworks."""
    if forced:
        return True
    empty = 0
    for n in root.walk():
        if n.tag == "template" and (n.attrs.get("data-nextjs-router") == "push" or "BAILOUT_TO_CLIENT_SIDE_RENDERING" in n.text() + " ".join(n.attrs.values())):
            return True
        if n.attrs.get("data-component-name") == "mermaid-container" and len(n.text(strip=True)) < 10 or "data-ice" in n.attrs and not n.text(strip=True) or any("client-only" in c for c in n.classes):
            return True
        if any(m in n.attrs for m in ("data-astro-slot", "data-svelte", "data-vue", "react-root")) or n.attrs.get("data-server-rendered") == "false":
            return True
        empty += n.tag in ("div", "span") and not n.classes and not any(isinstance(k, Node) for k in n.kids) and not n.text(strip=True)
    return empty > 10


def escaped(text: str) -> str:
    return text.replace('"', '\\"').replace("[", "&#91;").replace("]", "&#93;")


def graph_of(svg: Node) -> tuple[dict[str, tuple[str, str]], list[tuple[str, str, str]]]:
    """nodes {id: (label, type)} and edges (from, to, label) of a flowchart drawn as SVG."""
    group = lambda cls: [g for g in svg.all("g") if cls in g.classes]
    boxes = [g for top in group("nodes") for g in top.all("g") if "node" in g.classes] or [g for g in svg.all("g") if 0 < len(g.text(strip=True)) < 200]
    nodes, edges = {}, []
    for i, g in enumerate(boxes):
        m = re.search(r"flowchart-([A-Za-z0-9_]+)-", g.id)
        key = m[1] if m else g.id.replace("-", "_")[:20] or f"node_{i}"
        label = next((n.text(strip=True) for n in g.walk() if "nodeLabel" in n.classes), "") or max((t.text(strip=True) for t in g.all("text")), key=len, default="") or g.text(strip=True)
        label = re.sub(r"\s+", " ", label).strip()
        if label:
            nodes[key] = (label if len(label) <= 100 else label[:97] + "...", next((c for c in g.classes if c in SHAPES), "unknown"))
    labels = [next((s.text(strip=True) for s in g.all("span") if "edgeLabel" in s.classes), "") for top in group("edgeLabels") for g in top.all("g") if "edgeLabel" in g.classes]
    paths = svg.all("path")
    if not paths:
        names = list(nodes)
        return nodes, [(a, b, "") for a, b in zip(names, names[1:])]
    for i, p in enumerate(paths):
        parts = p.id.split("_")[1:] if p.id.startswith("L_") else p.id.split("-")
        if len(parts) >= 2 and parts[0] in nodes and parts[1] in nodes:
            edges.append((parts[0], parts[1], labels[i] if i < len(labels) else ""))
    return nodes, edges


def graph_source(nodes: dict[str, tuple[str, str]], edges: list[tuple[str, str, str]]) -> str:
    lines = ["flowchart TB"]
    for key, (label, kind) in nodes.items():
        left, right = SHAPES.get(kind, "[]")
        lines.append(f'    {key}{left}"{escaped(label)}"{right}')
    for a, b, label in edges:
        lines.append(f'    {a} -- "{escaped(label)}" --> {b}' if label else f"    {a} --> {b}")
    return "\n".join(lines)


def diagram_source(text: str) -> str:
    """Diagram source as it stands in a page, unescaped."""
    for old, new in (("\\n", "\n"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("\\/", "/"), ("<br>", "\n"), ("<br/>", "\n"), ('\\"', '"')):
        text = text.replace(old, new)
    return text.strip()


def diagram_in(n: Node) -> str | None:
    """The source of the diagram that a node is, if it is one."""
    if n.tag == "svg" and "flowchart" in n.classes:
        nodes, edges = graph_of(n)
        return graph_source(nodes, edges) if nodes or edges else None
    if n.tag in ("pre", "div") and "mermaid" in n.classes:
        code = n.all("code")
        source = diagram_source((code[0] if code else n).text())
        sure = n.tag == "div" and any(c.attrs.get("type") == "mermaid" for c in code)
        return source if source and (sure or "flowchart" in source.lower() or "graph" in source.lower()) else None
    return None


class _Markdown:
    """Markdown of a tree: no line is wrapped, links and images stay, diagrams become fenced blocks where they stand.

    The functions that go down the tree are generators, run by unrolled()."""

    def __init__(self, base: str, root: Node):
        self.base = base
        #: Nodes with a block somewhere below.
        self.around: set[int] = set()
        for n in root.walk():
            if n.tag in _BLOCKS:
                u = n.parent
                while u is not None and id(u) not in self.around:
                    self.around.add(id(u))
                    u = u.parent

    def inline(self, n: Node | str, code: bool = False) -> Generator:
        if isinstance(n, str):
            return n if code else re.sub(r"\s+", " ", n)
        if n.tag in ("script", "style", "template", "head", "noscript", "title"):
            return ""
        if n.tag == "br":
            return "  \n"
        if n.tag == "img":
            src = n.attrs.get("src") or n.attrs.get("data-src", "")
            return f"![{n.attrs.get('alt', '')}]({absolute(src, self.base)})" if src else ""
        inner = yield self.inlines(n.kids, code or n.tag == "code")
        mark = {"b": "**", "strong": "**", "i": "_", "em": "_", "code": "`", "del": "~~", "s": "~~"}.get(n.tag)
        if mark and inner.strip():
            return f"{mark}{inner.strip()}{mark}"
        if n.tag == "a" and n.attrs.get("href") and inner.strip():
            return f"[{inner.strip()}]({absolute(n.attrs['href'], self.base)})"
        return inner

    def inlines(self, kids: list, code: bool = False) -> Generator:
        out = []
        for k in kids:
            if isinstance(k, str):
                out.append(k if code else re.sub(r"\s+", " ", k))
            else:
                out.append((yield self.inline(k, code)))
        return "".join(out)

    def blocks(self, n: Node) -> Generator:
        out, run = [], []

        def flush():
            text = "".join(run).strip(" \n")
            if text.strip():
                out.append(text)
            run.clear()

        for k in n.kids:
            if isinstance(k, str) or not self.is_block(k):
                run.append((yield self.inline(k)))
                continue
            flush()
            if (diagram := diagram_in(k)) is not None:
                out.append(f"```mermaid\n{diagram}\n```")
            elif k.tag in HEADINGS:
                text = (yield self.inlines(k.kids)).strip()
                out += [f"{'#' * int(k.tag[1])} {text}"] * bool(text)
            elif k.tag == "pre":
                lang = next((c.split("-", 1)[1] for x in [k, *k.walk()] for c in x.classes if c.startswith("language-")), "")
                code = k.text().strip("\n")
                out += [f"```{lang}\n{code}\n```"] * bool(code)
            elif k.tag in ("ul", "ol"):
                items = yield self.items(k, 0)
                out += ["\n".join(items)] * bool(items)
            elif k.tag == "blockquote":
                inner = yield self.blocks(k)
                out += ["\n".join(f"> {line}".rstrip() for line in "\n\n".join(inner).split("\n"))] * bool(inner)
            elif k.tag == "hr":
                out.append("* * *")
            elif k.tag == "table":
                rows = yield self.table(k)
                out += ["\n".join(rows)] * bool(rows)
            else:
                out += yield self.blocks(k)
        flush()
        return out

    def is_block(self, n: Node) -> bool:
        return n.tag in _BLOCKS or id(n) in self.around or diagram_in(n) is not None

    def items(self, n: Node, depth: int) -> Generator:
        out = []
        for i, li in enumerate((k for k in n.kids if isinstance(k, Node) and k.tag == "li"), 1):
            own = yield self.inlines([k for k in li.kids if isinstance(k, str) or k.tag not in ("ul", "ol")])
            out.append("  " * (depth + 1) + (f"{i}. " if n.tag == "ol" else "* ") + re.sub(r"\s*\n\s*", " ", own.strip()))
            for k in li.kids:
                if isinstance(k, Node) and k.tag in ("ul", "ol"):
                    out += yield self.items(k, depth + 1)
        return out

    def table(self, n: Node) -> Generator:
        rows = []
        for r in n.all("tr"):
            row = []
            for c in r.kids:
                if isinstance(c, Node) and c.tag in ("td", "th"):
                    row.append(re.sub(r"\s+", " ", (yield self.inline(c))).strip().replace("|", "\\|"))
            if row:
                rows.append(row)
        return [" | ".join(rows[0]), "|".join(["---"] * len(rows[0])), *(" | ".join(r) for r in rows[1:])] if rows else []


_BLOCKS = {"address", "article", "aside", "blockquote", "body", "dd", "div", "dl", "dt", "fieldset", "figure", "figcaption", "footer", "form", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tbody", "td", "th", "thead", "tr", "ul", "details", "summary", *HEADINGS}


def markdown_of(root: Node, url: str) -> str:
    return "\n\n".join(unrolled(_Markdown(url, root).blocks(root)))


_INVISIBLE = dict.fromkeys(map(ord, "​‌‍⁠­﻿"))


def finished(markdown: str, o: Options) -> str:
    """Markdown without invisible characters, what follows an end mark, and set phrases; with image URLs if asked for."""
    text = re.sub(r"(?m)^(#{1,6})\s+(?=[^\s#])", r"\1 ", markdown.translate(_INVISIBLE))
    text = "\n".join(cut_at(text.split("\n"), o.end_marks, markdown=True))
    for p in o.phrases:
        text = re.sub(re.escape(p), "", text, flags=re.I if o.enhanced else 0)
    if o.image_hosts is not None:
        hosts = o.image_hosts
        text = re.sub(r"!\[[^\]]*\]\(([^)]+)\)", lambda m: f"{m[0]}\n{m[1]}" if not hosts or any(h in m[1] for h in hosts) else m[0], text)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def page_text(title: str, url: str, body: str) -> str:
    return f"# {title}\n\n> **原文链接**: {url}\n\n---\n\n{body}"


#: What can be read off a page.
FIELDS = {
    "title": "string", "h1": "string", "framework": "string", "needs_rendering": "boolean", "links": "array<struct<tag string, attr string, value string>>",
    "anchors": "array<struct<name string, text string, url string, level int, number string>>", "text": "string", "markdown": "string",
}


def read_page(url: str | None, html: str | None, o: Options, fields: tuple[str, ...] = tuple(FIELDS)) -> tuple:
    url, html = url or "", html or ""
    html = o.before(html, url) if o.before else html
    root, got = parse(html), {}
    for f in fields:  # what needs the whole page comes before the page is pruned
        if f == "title":
            got[f] = title_of(root, url)
        elif f == "h1":
            got[f] = next((n.text().strip() for n in root.all("h1")), None)
        elif f == "framework":
            got[f] = framework_of(root, html, url)
        elif f == "needs_rendering":
            got[f] = needs_rendering(root)
        elif f == "links":
            got[f] = [dict(zip(("tag", "attr", "value"), x)) for x in links_of(root)]
        elif f == "anchors":
            anchors = anchors_of(root, url, o)
            got[f] = [dict(zip(("name", "text", "url", "level", "number"), (*a, n))) for a, n in zip(anchors, numbered([a[3] for a in anchors]))]
    if "text" in fields or "markdown" in fields:
        body = prune(root, o, html, url)
        if "text" in fields:
            got["text"] = re.sub(r"\s+", " ", body.text()).strip()
        if "markdown" in fields:
            text = finished(markdown_of(body, url), o)
            got["markdown"] = o.after(text, url) if o.after else text
    return tuple(got[f] for f in fields)


def page(url: Column, html: Column, options: Options | None = None, fields: list[str] | tuple[str, ...] = tuple(FIELDS)) -> Column:
    """A struct with the `fields` that are asked for, read off a page in one pass; null urls and pages count as empty ones.
    Selectors that are not supported are an error here, before any page is read."""
    o, names = options or Options(), tuple(fields)
    for s in (o.remove, o.force, o.preserve, o.code, [o.toc_selector]):
        any_of(tuple(s))

    @pandas_udf(", ".join(f"{f} {FIELDS[f]}" for f in names))
    def run(urls: pd.Series, pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_page(u, h, o, names) for u, h in zip(urls, pages)], columns=list(names))

    return run(url, html)


# What is made absolute in a page.
REWRITTEN_TAGS = ["a", "img", "link", "script", "iframe", "form", "source", "track", "video", "audio", "embed", "object"]
REWRITTEN_ATTRIBUTES = ["href", "src", "action", "data-src", "data-href", "cite", "background"]
_STYLE_URL = re.compile(r"""url\(\s*(?:"([^"]*)"|'([^']*)'|([^)'"]*?))\s*\)""", re.I)
_ATTRIBUTE = re.compile(r"""(?<=[\s"'/])([a-zA-Z][\w:-]*)(\s*=\s*)("[^"]*"|'[^']*'|[^\s"'>]+)""")


class _Rewriter(HTMLParser):
    """Collects (from, to, new text) for attributes whose URL changes; all else in the page stays as it is."""

    def __init__(self, text: str, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.edits = base, []
        self.line = [0, *(m.end() for m in re.finditer("\n", text))]
        self.feed(text)
        self.close()

    def style(self, css: str) -> str:
        return _STYLE_URL.sub(lambda m: f'url("{absolute(next(g for g in m.groups() if g is not None), self.base)}")', css)

    def handle_starttag(self, tag, attrs):
        if tag not in REWRITTEN_TAGS and not any(k == "style" for k, _ in attrs):
            return
        row, col = self.getpos()
        at = self.line[row - 1] + col
        for m in _ATTRIBUTE.finditer(self.get_starttag_text()):
            name, raw = m[1].lower(), m[3]
            value = unescape(raw[1:-1] if raw[0] in "\"'" else raw)
            new = value
            if name == "style":
                new = self.style(value)
            elif tag in REWRITTEN_TAGS and name in REWRITTEN_ATTRIBUTES:
                new = absolute(value, self.base)
            if new != value:
                quote = raw[0] if raw[0] in "\"'" else '"'
                self.edits.append((at + m.start(3), at + m.end(3), quote + new.replace("&", "&amp;").replace(quote, "&quot;" if quote == '"' else "&#39;") + quote))


def absolute_page(url: str | None, html: str | None) -> tuple[str, int]:
    """(the page with absolute links where relative ones stood, also in style attributes; how many were changed)."""
    html = html or ""
    out, at = [], 0
    edits = _Rewriter(html, url or "").edits
    for start, end, new in edits:
        out += [html[at:start], new]
        at = end
    return "".join([*out, html[at:]]), len(edits)


def absolute_links(url: Column, html: Column) -> Column:
    """struct(html, changed): pages whose relative links are made absolute in place, and how many those were."""

    @pandas_udf("html string, changed int")
    def run(urls: pd.Series, pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([absolute_page(u, h) for u, h in zip(urls, pages)], columns=["html", "changed"])

    return run(url, html)
