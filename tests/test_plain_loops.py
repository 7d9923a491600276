"""Queries that SQL does not state, against plain loops over the tables."""

import re

from lakeloom import catalog
from lakeloom.functions import secrets
from lakeloom.functions import text as T


def rows(spark, data, table):
    return spark.read.parquet(f"{data}/{table}.parquet").collect()


def test_secrets_of_all_families(spark, data):
    """Every family over every whole text, by Python's patterns, without asking first what a text must hold."""
    want = {}
    for r in rows(spark, data, "documents"):
        types, counts, details = [], [], []
        for name, pattern in secrets.PATTERNS:
            p = re.compile(pattern)
            found = sorted({m[0] if not p.groups else ",".join(g or "" for g in m.groups()) if p.groups > 1 else m[1] or "" for m in p.finditer(r["text"] or "")})
            if found:
                types.append(name)
                counts.append(str(len(found)))
                details.append(f"{name}:{'; '.join(found)}")
        if types:
            want[r["doc_id"]] = ("|".join(types), "|".join(counts), "|".join(details))
    got = {r["doc_id"]: (r["sensitive_types"], r["sensitive_counts"], r["sensitive_details"]) for r in catalog.QUERIES["secret_scan_all"](spark, data).collect()}
    assert len(want) > 5 and got == want


def bare(text):
    for pattern, flags, new in T.URL_PARTS:
        text = re.sub(f"(?{flags}){pattern}" if flags else pattern, new, text)
    return text.strip()


def words(text):
    clean = " ".join(re.sub(r"[^\w\s]", "", text).split())
    cjk = sum("一" <= c <= "鿿" for c in clean)
    return cjk + len(re.findall(r"\b[a-zA-Z]+\b", clean)) if cjk else len(clean.split())


def around(text, line, most):
    """Grown one line at a time from the line that is asked for, within its section."""
    lines = (text or "").split("\n")
    if text is None or line > len(lines):
        return ""
    head = [bool(re.match(r"#{1,6}\s+", x.strip())) for x in lines]
    a = b = line - 1
    while a > 0 and not head[a - 1]:
        a -= 1
    while b + 1 < len(lines) and not head[b + 1]:
        b += 1
    own = {i: re.sub(r"^---+\s*", "", lines[i].strip()) for i in range(a, b + 1) if not head[i]}
    own = {i: x for i, x in own.items() if x}
    if not own:
        return ""
    if words(bare("\n".join(own.values()))) <= most:
        return bare("\n".join(own.values()))
    at = line - 1 if line - 1 in own else min(own)
    keys, used = sorted(own), words(bare(own[at]))
    if used > most:
        return " ".join(own[at].split()[:most])
    taken = [at]
    while True:
        k, j = keys.index(taken[0]), keys.index(taken[-1])
        if k and used + words(bare(own[keys[k - 1]])) <= most:
            taken.insert(0, keys[k - 1])
            used += words(bare(own[taken[0]]))
        elif j + 1 < len(keys) and used + words(bare(own[keys[j + 1]])) <= most:
            taken.append(keys[j + 1])
            used += words(bare(own[taken[-1]]))
        else:
            return "\n".join(own[i] for i in taken)


def test_contexts(spark, data):
    want = {r["doc_id"]: around(r["text"], 5, 30) for r in rows(spark, data, "documents")}
    got = {r["doc_id"]: r["context"] for r in catalog.QUERIES["context_growth"](spark, data).collect()}
    assert got == want and sum(bool(x) for x in want.values()) > 50


def test_markdown_of_pages(spark, data):
    """Pages hold one article of a title and paragraphs; its Markdown is that, whatever else stands around it."""
    got = {r["page_id"]: r["markdown"] for r in catalog.QUERIES["page_markdown"](spark, data).collect()}
    for r in rows(spark, data, "pages"):
        body = re.search(r"(?s)<article>(.*?)</article>", r["html"])[1]
        plain = lambda x: re.sub(r"\s+", "", re.sub(r"&(amp|lt|gt|quot|middot|copy);", "", re.sub(r"<[^>]+>", "", x)))
        text = re.sub(r"\s+", "", re.sub(r"[*#&<>\"]", "", got[r["page_id"]]))
        assert text == re.sub(r"[*#&<>\"]", "", plain(body)), r["page_id"]
        assert got[r["page_id"]].startswith("# ") and "footer" not in got[r["page_id"]]


def test_corpus_and_lines(spark, data):
    """Corpora have the Markdown of their pages under a title and a source; lines stand below their headings."""
    markdown = {r["page_id"]: r["markdown"] for r in catalog.QUERIES["page_markdown"](spark, data).collect()}
    urls = {r["url"]: markdown[r["page_id"]] for r in rows(spark, data, "pages")}
    corpus = catalog.QUERIES["corpus_build"](spark, data).collect()
    assert 0 < len(corpus) <= len(urls)
    for r in corpus:
        url = re.search(r"原文链接\*\*: (\S+)", r["content"])[1]
        head, _, body = r["content"].partition("\n---\n\n")
        assert body == urls[url] and head.startswith("# ") and r["doc_set"].endswith("@latest")
    lines = {}
    for r in catalog.QUERIES["page_lines"](spark, data).collect():
        lines.setdefault(r["page_id"], []).append((r["line_no"], r["line"], r["heading"]))
    for i, own in lines.items():
        assert "\n".join(x for _, x, _ in sorted(own, key=lambda x: x[0])) == markdown[i]
        above = None
        for n, line, heading in sorted(own, key=lambda x: x[0]):
            above = line.strip() if n > 1 and re.match(r"#{1,6}\s+\S", line.strip()) else above
            assert heading == above if n <= 100 else True


def test_answer(spark, data):
    out = catalog.QUERIES["rag_answer"](spark, data).collect()
    sections = catalog.QUERIES["rag_sections"](spark, data).collect()
    assert len(out) == 1 and all(s["content"] in out[0]["output"] for s in sections) and out[0]["output"].endswith(out[0]["sources"])
    assert all(f"**{s['title']}**" in out[0]["sources"] for s in sections)


def test_all_layers(spark, data):
    got = catalog.QUERIES["layered_match"](spark, data).collect()
    assert [r["rank"] for r in sorted(got, key=lambda r: r["rank"])] == list(range(1, len(got) + 1)) and {r["title"] for r in got} >= {"Guide"} and all(0 <= r["similarity"] <= 1 for r in got)
