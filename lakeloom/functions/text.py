"""Text functions on columns: tokens, stems, keywords, headings, word counts, language, query clean-up."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and suffix rules that results depend on.
STOP_WORDS = ["the", "a", "an", "and", "or", "but", "is", "are", "was", "were", "to", "for", "with", "by", "from", "at", "on", "in", "about", "as", "of", "it", "this", "that", "be", "have", "has", "had"]
TECHNICAL_TERMS = ["api", "cli", "sdk", "http", "https", "jwt", "oauth", "ssh", "webhook", "middleware", "endpoint", "token", "auth", "config", "deploy", "hooks", "async", "sync", "json", "xml", "yaml", "yml"]
UNSTEMMED = ["apis", "urls", "ids", "stats", "docs", "apps", "logs", "jobs", "users", "admins", "settings", "agent", "get", "set", "let", "put", "use"]
#: (suffix, what stands in its place, letters that may not come before it)
SUFFIXES = [
    ("ies", "y", ""), ("ves", "f", ""), ("ses", "s", ""), ("xes", "x", ""), ("zes", "z", ""), ("ches", "ch", ""), ("shes", "sh", ""), ("men", "man", ""), ("es", "", "aeiou"), ("s", "", ""),
    ("ying", "ie", ""), ("eed", "ee", ""), ("ed", "", ""), ("ing", "", ""),
    ("ly", "", ""), ("er", "", ""), ("est", "", ""), ("ness", "", ""),
    ("ization", "ize", ""), ("ition", "e", ""), ("ment", "", ""), ("ity", "y", ""), ("ive", "", ""), ("ic", "", ""), ("al", "", ""), ("ful", "", ""), ("less", "", ""),
    ("able", "", ""), ("ible", "", ""), ("ant", "", ""), ("ent", "", ""),
]
#: How many letters of a stem are not those of its word, at most.
MOST_NEW = max(len(new) for _, new, _ in SUFFIXES)

WORD = r"[\p{L}\p{N}_]+"
CJK = r"[\x{4e00}-\x{9fff}]"
#: Python and RE2 spell the same range otherwise.
CJK_RE = "[一-鿿]"
#: What \s stands for in RE2, and what SQL's trim() takes off: the separators of all scripts that are blanks.
BLANKS = r"\t\n\f\r "
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def re2(pattern: str) -> str:
    """The pattern as RE2 reads it: the dot takes all but a line feed, a $ at the end is the end of the text alone, blanks are of ASCII."""
    blanks = re.sub(r"(\[[^\]]*)\\s", lambda m: m[1] + BLANKS, pattern).replace(r"\s", f"[{BLANKS}]")
    return "(?d)" + re.sub(r"(?<!\\)\$$", r"\\z", blanks)


def trim(text: Column) -> Column:
    """As SQL's trim()."""
    return F.btrim(text, F.lit(SPACES))


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores, lower-cased; an empty array for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def stem(word: Column) -> Column:
    """The first rule that leaves at least two letters; short and listed words stay. Rules are asked by last letter, so a
    word meets few of them."""
    groups: dict[str, list] = {}
    for rule in SUFFIXES:
        groups.setdefault(rule[0][-1], []).append(rule)
    out = F.when((F.length(word) < 3) | word.isin(UNSTEMMED), word)
    for last, rules in groups.items():
        own = None
        for suffix, new, barred in rules:
            fits = word.endswith(suffix) & (F.length(word) >= len(suffix) + 2 - len(new))
            if barred:
                fits = fits & ~F.substring(word, -len(suffix) - 1, 1).isin(list(barred))
            cut = F.concat(F.left(word, F.length(word) - len(suffix)), F.lit(new)) if new else F.left(word, F.length(word) - len(suffix))
            own = F.when(fits, cut) if own is None else own.when(fits, cut)
        out = out.when(word.endswith(last), own.otherwise(word))
    return out.otherwise(word)


def usable(token: Column, least: int = 2, most: int | None = 30, stop: list[str] | None = None) -> Column:
    """Whether a token, stemmed before if at all, is indexed."""
    ok = ~token.isin(STOP_WORDS if stop is None else stop) & (F.length(token) >= least)
    return ok if most is None else ok & (F.length(token) <= most)


def tokens(text: Column, stemmed: bool = True, least: int = 2, most: int | None = 30, stop: list[str] | None = None) -> Column:
    """Lower-cased words, stemmed, then without stop words and by length."""
    every = words(text)
    return F.filter(F.transform(every, stem) if stemmed else every, lambda t: usable(t, least, most, stop))


def keywords(query: Column) -> Column:
    """Words of a query in their order, once each: CJK, technical terms, and all that are no stop words."""
    found = words(query)
    return F.array_distinct(F.filter(found, lambda w: w.rlike(CJK) | w.isin(TECHNICAL_TERMS) | ~w.isin(STOP_WORDS)))


def language(text: Column, threshold: float = 0.9) -> Column:
    """zh if that share of the trimmed text is CJK, else en."""
    total = F.length(F.trim(text))
    cjk = F.length(text) - F.length(F.regexp_replace(text, CJK, ""))
    return F.when((total > 0) & (cjk / F.when(total > 0, total) >= threshold), "zh").otherwise("en")


def count_words(text: Column) -> Column:
    """CJK characters and ASCII words; without CJK, runs between blanks after punctuation is dropped."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))
    mixed = F.size(F.regexp_extract_all(clean, F.lit(CJK), F.lit(0))) + F.size(F.regexp_extract_all(clean, F.lit(r"(?<![\p{L}\p{N}_])[a-zA-Z]+(?![\p{L}\p{N}_])"), F.lit(0)))
    return F.when(clean == "", 0).when(clean.rlike(CJK), mixed).otherwise(F.size(F.split(clean, " "))).cast("int")


ANCHOR = r"：https://[^\s]+|: https://[^\s]+"
LINK = r"\[([^\[\]]+)\]\([^)]+\)"


def strip_heading_url(heading: Column, keep_hash: bool = False) -> Column:
    """Markdown links become their text, trailing anchors go; keep_hash puts lost level marks back."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(heading, LINK, "$1"), ANCHOR, ""))
    if not keep_hash:
        return clean
    marks = F.regexp_extract(F.trim(heading), r"^(#{1,6})\s+", 1)
    return F.when(~clean.startswith("#") & (marks != ""), F.concat(marks, F.lit(" "), clean)).otherwise(clean)


# What holds a URL in a context, with the flags of its pattern and what stands in its place.
URL_PARTS = [
    (r"\[([^\[\]]+)\]\([^)]+\)", "", r"\1"),
    (r"<(https?://[^\s<>]+)>", "", r"\1"),
    (r"：https://[^\s]+|: https://[^\s]+", "", ""),
    (r"^\s*https?://[^\s]*\s*$", "m", ""),
    (r"```[^\n]*\n[^\n]*https?://[^\n]*\n```", "s", ""),
    (r"`[^`]*?https?://[^\s]*?`", "", ""),
    (r"\s+https?://[^\s<>]+", "", ""),
    (r"^https?://[^\s]+", "m", ""),
    (r"```\s*```", "", ""),
]


def clean_context(text: Column) -> Column:
    """A context without URLs: links, angle brackets, anchors, bare lines, code that holds them."""
    for pattern, flags, new in URL_PARTS:
        text = F.regexp_replace(text, f"(?{flags}){pattern}" if flags else pattern, new.replace("\\1", "$1"))
    return F.regexp_replace(text, r"^\s+|\s+$", "")


NUMBERING = [r"^#{1,6}\s+", r"^\d+(?:\.\d+)*(?:\.|\s)\s*", r"^（[一二三四五六七八九十]+）\s*", r"^[①②③④⑤⑥⑦⑧⑨⑩]\s*", r"(?i)^(?:I{1,3}|IV|V|VI{0,3}|IX|X)\.\s*"]


def normal_heading(heading: Column) -> Column:
    """A heading without level marks and numbering, for comparison."""
    text = F.trim(F.coalesce(heading, F.lit("")))
    for pattern in NUMBERING:
        text = F.regexp_replace(text, pattern, "")
    return F.trim(text)


def heading_level(heading: Column) -> Column:
    marks = F.length(F.regexp_extract(F.trim(heading), r"^(#{1,6})\s+", 1))
    return F.when(marks == 0, 1).otherwise(marks)


def core_title(heading: Column) -> Column:
    """A heading without numbering and trailing URL."""
    text = F.trim(heading)
    for pattern in (r"^[\d.]+[)\-]?\s*", r"^[\d.]+\s*", r"[：:]\s*https?://\S*$"):
        text = F.regexp_replace(text, pattern, "")
    return F.trim(text)


def slug(title: Column, sql: bool = False) -> Column:
    """sql: as SQL has it, where a sigma is lower-cased alike at the end of words."""
    read = re2 if sql else str
    plain = F.regexp_replace(F.lower(F.translate(title, "Σ", "σ") if sql else title), read(r"[^\p{L}\p{N}_\s-]"), "")
    return F.btrim(F.regexp_replace(plain, read(r"[-\s]+"), "-"), F.lit("-"))


def same_title(heading: Column, title: Column) -> Column:
    """Whether a heading is its page's title: equal cores, in any case."""
    return F.lower(core_title(heading)) == F.lower(core_title(title))


def normal_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(title, r"\s+", " "))


def page_of_path(path: Column) -> Column:
    """The page's name in .../<page>/docTOC.md or docContent.md; other names stand for themselves unless they end in .md."""
    last = F.element_at(F.split(path, "/"), -1)
    held = F.when(last.isin("docTOC.md", "docContent.md") & (F.size(F.split(path, "/")) >= 2), F.get(F.split(path, "/"), F.size(F.split(path, "/")) - 2)).otherwise(last)
    return F.when((held == "") | held.endswith(".md"), "Unknown").otherwise(held)


def doc_set_name(doc_set: Column) -> Column:
    return F.split(doc_set, "@", 2)[0]


def doc_set_version(doc_set: Column) -> Column:
    parts = F.split(doc_set, "@", 2)
    return F.when(F.size(parts) > 1, F.get(parts, F.lit(1))).otherwise("latest")


def without_keywords(query: Column, skipped: list[str]) -> Column:
    """A query without these words, in any case, one after the other; blanks are collapsed."""
    out = F.trim(query)
    for k in skipped:
        if k.strip():
            out = F.regexp_replace(out, "(?iu)" + re.escape(k.strip()), "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def noun_stem(noun: str) -> str:
    """A noun's singular: a final s alone is tried first, so the longer endings count only where it does not fit."""
    for suffix in ("s", "es", "ied", "ies", "ves"):
        if noun.endswith(suffix) and len(noun) > len(suffix) + 2:
            vowel = noun.endswith(("a" + suffix, "e" + suffix))
            if suffix in ("ies", "ied") and not vowel:
                return noun[:-3] + "y"
            return noun[:-3] + "f" if suffix == "ves" else noun[: -len(suffix)]
    return noun


def has_noun(text: Column, nouns: list[str]) -> Column:
    """Whether a text has one of the nouns: CJK as they are, others by their stems."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for n in (x.lower() for x in nouns):
        for part in {n} if re.search(CJK_RE, n) else {n, noun_stem(n)}:
            out = out | low.contains(part)
    return out


def for_rerank(text: Column, nouns: list[str], verbs: list[str], skipped: list[str] = ()) -> Column:
    """A text as it is compared by meaning: verbs go unless one of the nouns is there; nouns that are skipped words stay."""
    kept = {w.lower() for w in set(nouns) & set(skipped)}
    verbs = [v for v in verbs if v.lower() not in kept]
    if not nouns or not verbs:
        return text
    out = text
    for v in verbs:
        edge = "" if re.search(CJK_RE, v) else r"\b"
        out = F.regexp_replace(out, f"(?iU){edge}{re.escape(v)}{edge}", "")
    return F.when(has_noun(text, nouns) | (text == ""), text).otherwise(F.trim(F.regexp_replace(out, r"\s+", " ")))


def without_phrases(text: Column, phrases: list[str], any_case: bool = True) -> Column:
    for p in phrases:
        text = F.regexp_replace(text, ("(?iu)" if any_case else "") + re.escape(p), "")
    return text


def clean_markdown(text: Column) -> Column:
    """Markdown without invisible characters, headings split over lines, and runs of blank lines."""
    text = F.translate(text, "​‌‍﻿­⁠", "")
    text = F.regexp_replace(text, r"(?m)^(#{1,6})[ \t]*\n+[ \t]*(?=[^\s#])", "$1 ")
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def with_image_urls(markdown: Column) -> Column:
    """Each image reference is followed by its URL on a line of its own."""
    return F.regexp_replace(markdown, r"!\[([^\]]*)\]\(([^)\s]+)[^)]*\)", "$0\n$2")


def without_ansi(text: Column) -> Column:
    return F.regexp_replace(text, r"\x1B\[[0-?]*[ -/]*[@-~]", "")


def safe_name(title: Column, most: int = 100, folder: bool = False) -> Column:
    """A title as a file's name; full normalisation of compatible characters is normalised() in similarity.py."""
    name = F.regexp_replace(F.regexp_replace(title, r'[<>:"/\\|?*]', ""), r"\s+", " ")
    name = F.btrim(name, F.lit(". "))
    if folder:
        name, most = F.when(name.rlike(r"^\d+$"), F.concat(F.lit("dir_"), name)).otherwise(name), 200
    name = F.trim(F.left(name, F.lit(most)))
    return F.when(name == "", "untitled").otherwise(name)
