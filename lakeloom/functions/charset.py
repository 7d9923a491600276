"""Bytes of pages as text: the charset that a page declares, else one that its bytes fit."""

from __future__ import annotations

import codecs
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

#: Tried in turn on bytes that are no UTF-8, and the encodings that a title is read by.
ASIAN = ["gb18030", "big5", "shift_jis", "euc_jp", "euc_kr"]
TITLE_ENCODINGS = ["utf-8", "gbk", "gb2312", "utf-16"]
MARKS = [(codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")]
META = re.compile(rb"""<meta[^>]+charset\s*=\s*["']?\s*([a-zA-Z0-9_:.-]+)""", re.I)


def known(name: str | None) -> str | None:
    try:
        return codecs.lookup(name).name if name else None
    except LookupError:
        return None


#: What counts for and against a script, by code points.
GOOD, KANA, BAD = re.compile("[\u4e00-\u9fff\uac00-\ud7a3\u3000-\u303f\uff00-\uff60]"), re.compile("[\u3040-\u30ff]"), re.compile("[\x80-\x9f\ue000-\uf8ff\uff61-\uffdf\U00020000-\U0010ffff]")


def likely(text: str) -> float:
    """How much of what is beyond ASCII reads like some script: common ideographs, kana and hangul count, private and rare
    signs count against."""
    n = sum(map(len, re.findall(r"[^\x00-\x7f]+", text)))
    good, kana, bad = (len(p.findall(text)) for p in (GOOD, KANA, BAD))
    return (good + 2 * kana - 2 * bad) / n if n else 0.0


def sniffed(body: bytes) -> str:
    """The encoding that bytes seem to be in: by their mark, as UTF-8, by the page's own word for it, by what reads best of
    the Asian ones, else Windows-1252, in which any byte is a character. The whole body has to fit; an encoding is left at
    its first error."""
    for mark, name in MARKS:
        if body.startswith(mark):
            return name
    if fits(body, "utf-8") is not None:
        return "utf-8"
    if body.count(0) > len(body) // 4:
        return "utf-16-le" if body[1::2].count(0) > body[::2].count(0) else "utf-16-be"
    said = META.search(body)
    if said and (name := known(said[1].decode("ascii"))) and name not in ("utf-8", "ascii", "iso8859-1"):
        return name
    best, most_likely = "cp1252", 0.5
    for name in ASIAN:
        text = fits(body, name)
        if text is not None and (score := likely(text)) > most_likely:
            best, most_likely = name, score
    return best


def fits(body: bytes, name: str) -> str | None:
    try:
        return body.decode(name)
    except UnicodeDecodeError:
        return None


def text_of(body: bytes | None, declared: str | None = None) -> str:
    """Bytes as text by the declared charset; where none is declared, an unknown one, or the protocol's mere default
    (ISO-8859-1), by what is sniffed. What does not fit becomes replacement characters."""
    if not body:
        return ""
    name = known(declared)
    if name in (None, "iso8859-1"):
        name = sniffed(body)
    return body.decode(name, "replace")


def charset_of(content_type: str | None) -> str | None:
    m = re.search(r"""charset\s*=\s*["']?([^\s;"']+)""", content_type or "", re.I)
    return m[1] if m else None


def decoded(body: Column, charset: Column) -> Column:
    """A page's bytes as text by the charset it names; see text_of()."""

    @pandas_udf("string")
    def run(bodies: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else text_of(bytes(b), n) for b, n in zip(bodies, names)], dtype=object)

    return run(body, charset)


class _Title(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.parts, self.done = False, [], False

    def handle_starttag(self, tag, attrs):
        self.open = self.open or tag == "title" and not self.done

    def handle_endtag(self, tag):
        if tag == "title" and self.open:
            self.open, self.done = False, True

    def handle_data(self, data):
        if self.open:
            self.parts.append(data)


def best_title(body: bytes | None) -> str:
    """The longest title that the page has under the encodings it can be read by, without line ends."""
    best = ""
    for name in dict.fromkeys([*TITLE_ENCODINGS, sniffed(body or b"")]):
        try:
            text = (body or b"").decode(name)
        except (UnicodeDecodeError, UnicodeError):
            continue
        p = _Title()
        p.feed(text)
        title = "".join(p.parts).strip().replace("\n", "").replace("\r", "")
        best = title if len(title) > len(best) else best
    return best


def title(body: Column) -> Column:
    @pandas_udf("string")
    def run(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: best_title(None if b is None else bytes(b)))

    return run(body)
