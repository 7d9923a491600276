"""URL functions on columns: parts, scope, predicates, resolution, validity, extraction of paths from text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.html import LINK_ATTRIBUTES

#: The split of RFC 3986, appendix B; it takes any string.
PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"

# What is skipped unless the caller says otherwise.
EXTENSIONS = [".css", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".woff", ".woff2", ".ttf", ".eot", ".ico", ".mp4", ".mp3", ".avi", ".mov", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".rar", ".gz", ".tar", ".7z", ".exe", ".dll", ".bin", ".swf", ".flv"]
STATUS_CODES = [404, 503, 502, 504, 403, 401, 500]
TITLES = ["Page Not Found"]
NO_TYPE = "接口"
SCHEMES = ["http", "https", "ftp", "sftp", "ws", "wss"]


@dataclass(frozen=True)
class Scope:
    """Which URLs a crawl takes. mode 0 and 1: the base domain; 2: all; 3: the whitelist only."""

    base_domain: str = ""
    mode: int = 0
    whitelist: list[str] = field(default_factory=list)
    blacklist: list[str] = field(default_factory=list)
    extensions: list[str] = field(default_factory=lambda: list(EXTENSIONS))
    exclude: list[str] = field(default_factory=list)
    allow: list[str] = field(default_factory=list)
    danger: list[str] = field(default_factory=list)
    status_codes: list[int] = field(default_factory=lambda: list(STATUS_CODES))
    titles: list[str] = field(default_factory=lambda: list(TITLES))

    @classmethod
    def of_start(cls, url: str, **options) -> Scope:
        """The scope whose base domain is that of a start URL: the last two labels of its host, an address or a single label
        whole, without a port."""
        host = re.match(PARTS, url or "")[2] or ""
        host = re.sub(r":\d*$", "", host.rpartition("@")[2].lower())
        address = host.startswith("[") or re.fullmatch(r"[\d.]+", host)
        return cls(base_domain=host if address else ".".join(host.split(".")[-2:]), **options)


def part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, PARTS, i)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def host(url: Column) -> Column:
    """With the port, as it is written."""
    return part(url, 2)


def path(url: Column) -> Column:
    return part(url, 3)


def domain(url: Column) -> Column:
    """The last two labels of the host, without a port. There is no list of public suffixes."""
    return F.array_join(F.slice(F.concat(F.array(F.lit("")), F.split(F.regexp_replace(F.lower(host(url)), r":\d*$", ""), r"\.")), -2, 2), ".")


def domain_matches(pattern: str, host: Column) -> Column:
    """By labels: a.b is x.a.b's, not xa.b's."""
    return (host == pattern) | host.endswith("." + pattern)


def in_scope(url: Column, s: Scope) -> Column:
    """The whitelist wins over the blacklist, and that over the mode."""
    h, no = host(url), F.lit(False)
    white = no
    for w in s.whitelist:
        white = white | domain_matches(w, h)
    black = no
    for b in s.blacklist:
        black = black | domain_matches(b, h)
    by_mode = {2: F.lit(True), 3: no}.get(s.mode)
    if by_mode is None:
        by_mode = domain_matches(s.base_domain, F.regexp_replace(h, r":\d*$", ""))
    return F.when(white, True).when(black, False).otherwise(by_mode)


def has_extension(url: Column, extensions: list[str]) -> Column:
    if not extensions:
        return F.lit(False)
    return F.lower(path(url)).rlike("(?:" + "|".join(re.escape(e.lower()) for e in extensions) + ")$")


def _any_of(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p.lower())
    return out


def excluded(url: Column, exclude: list[str]) -> Column:
    return _any_of(F.lower(url), exclude)


def allowed(url: Column, allow: list[str]) -> Column:
    return _any_of(F.lower(url), allow) if allow else F.lit(True)


def danger_token(url: Column, danger: list[str]) -> Column:
    """The first token of the list in the URL, null if there is none; .js files never have one."""
    out = F.when(url.endswith(".js"), F.lit(None).cast("string"))
    for d in danger:
        out = out.when(F.lower(url).contains(d.lower()), d)
    return out


def skipped_title(title: Column, titles: list[str]) -> Column:
    return F.coalesce((title != "") & F.lower(title).isin([t.lower() for t in titles]), F.lit(False))


def skipped_status(status: Column, codes: list[int]) -> Column:
    return F.coalesce(status.isin(codes), F.lit(False))


def crawlable(url: Column, s: Scope, prefixes: list[str] = (), fuzzy: list[str] = ()) -> Column:
    """http(s); one of the prefixes or parts if any are given; neither excluded nor of a skipped extension."""
    ok = scheme(url).isin("http", "https") & ~excluded(url, s.exclude) & ~has_extension(url, s.extensions)
    if prefixes or fuzzy:
        some = _any_of(F.lower(url), list(fuzzy))
        for p in prefixes:
            some = some | host(url).startswith(p)
        ok = ok & some
    return ok


def sink_verdict(url: Column, status: Column, title: Column, s: Scope) -> Column:
    """Why a result is not reported, in the order of the tests; null if it is."""
    white, black = F.lit(False), F.lit(False)
    for w in s.whitelist:
        white = white | domain_matches(w, host(url))
    for b in s.blacklist:
        black = black | domain_matches(b, host(url))
    return (
        F.when(F.coalesce(url, F.lit("")) == "", "empty").when(skipped_status(status, s.status_codes), "status").when(black & ~white, "blacklist")
        .when(has_extension(url, s.extensions), "extension").when(danger_token(url, s.danger).isNotNull(), "danger").when(excluded(url, s.exclude), "exclude")
        .when(skipped_title(title, s.titles), "title").when(~allowed(url, s.allow), "allow")
    )


def link_type(url: Column) -> Column:
    """The last path segment's extension in upper case."""
    name = F.element_at(F.split(F.split(F.coalesce(url, F.lit("")), r"\?")[0], "/"), -1)
    return F.when(name.contains("."), F.upper(F.element_at(F.split(name, r"\."), -1))).otherwise(NO_TYPE)


def error_text(error: Exception) -> str:
    """An error as its kind and message: SSL, time-outs, too many redirects, connections, other errors of the protocol, else
    by its class. The kinds are told by the names of its class and of those above, of whatever client it comes from."""
    names = [c.__name__ for c in type(error).__mro__]
    kinds = {"SSLError": ["SSLError"], "TimeoutError": ["TimeoutError", "Timeout"], "TooManyRedirects": ["TooManyRedirects"], "ConnectionError": ["ConnectionError", "URLError", "gaierror"], "RequestError": ["RequestException", "HTTPException", "HTTPError"]}
    kind = next((k for k, of in kinds.items() if any(n in of for n in names)), f"Error({names[0]})")
    return f"{kind}: {error}"


def status_text(status: Column, error: Column) -> Column:
    """The status, or the error as it stands."""
    return F.coalesce(status.cast("string"), error, F.lit(""))


def precleaned(url: Column) -> Column:
    """The longest start of allowed characters, without quotes around; null for script, data, mail and phone links."""
    url = F.trim(url)
    clean = F.btrim(F.regexp_extract(url, r"^[a-zA-Z0-9:/?&=._~#%\\-]+", 0), F.lit("'\""))
    return F.when(url.rlike("^(?:javascript|data|mailto|tel):") | (clean == ""), F.lit(None).cast("string")).otherwise(clean)


def full_urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"https?://[^ ]+"), F.lit(0))


def parent_resolved(base: Column, rel: Column) -> Column:
    """rel with ../ against base: all .. are counted first; more than there are folders end at the root."""
    folders = F.filter(F.split(F.regexp_replace(path(base), r"[^/]*$", ""), "/"), lambda p: p != "")
    steps = F.split(rel, "/")
    up = F.size(F.filter(steps, lambda p: p == ".."))
    names = F.filter(steps, lambda p: ~p.isin("..", ".", ""))
    stay = F.slice(folders, F.lit(1), F.greatest(F.lit(0), F.size(folders) - up))
    return F.concat(scheme(base), F.lit("://"), host(base), F.lit("/"), F.array_join(F.concat(stay, names), "/"))


def joined(base: Column, rel: Column) -> Column:
    """rel against base as RFC 3986 resolves it, with runs of slashes in the path collapsed."""
    b, r = (lambda i: part(base, i)), (lambda i: part(rel, i))
    merged = F.when(path(rel).startswith("/"), path(rel)).otherwise(F.concat(F.regexp_replace(F.when(path(base) == "", "/").otherwise(path(base)), r"[^/]*$", ""), path(rel)))

    def step(acc, seg):
        return F.when(seg == ".", acc).when(seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(seg)))

    segs = F.split(merged, "/")
    flat = F.array_join(F.aggregate(F.slice(segs, F.lit(2), F.size(segs)), F.array(F.lit("")), step), "/")
    flat = F.when(merged.rlike(r"/\.{1,2}$"), F.concat(flat, F.lit("/"))).otherwise(flat)
    query = F.when(r(4) != "", F.concat(F.lit("?"), r(4))).when((path(rel) == "") & (b(4) != ""), F.concat(F.lit("?"), b(4))).otherwise("")
    frag = F.when(r(5) != "", F.concat(F.lit("#"), r(5))).otherwise("")
    whole = F.regexp_replace(F.when(path(rel) == "", path(base)).otherwise(flat), "/{2,}", "/")
    return F.concat(scheme(base), F.lit("://"), host(base), whole, query, frag)


def resolved(base: Column, rel: Column) -> Column:
    """A link as it stands in a page at `base`, by its kind: protocol-relative, hash route, rooted, ./, ../, absolute, other."""
    root = F.concat(scheme(base), F.lit("://"), host(base))
    folder = F.regexp_replace(path(base), r"/[^/]*$", "")
    return (
        F.when(rel.startswith("//"), F.concat(scheme(base), F.lit(":"), rel))
        .when(rel.startswith("#/"), F.concat(root, path(base), rel))
        .when(rel.startswith("/"), F.concat(root, F.lit("/"), F.regexp_replace(rel, "^/+", "")))
        .when(rel.startswith("./"), F.concat(root, folder, F.lit("/"), F.regexp_replace(F.substr(rel, F.lit(3)), "^/+", "")))
        .when(rel.startswith("../"), parent_resolved(base, rel))
        .when(rel.rlike("^https?://"), rel)
        .otherwise(joined(base, rel))
    )


def routes(bases: DataFrame, routes: DataFrame, rels: DataFrame) -> DataFrame:
    """bases (base) x routes (route) x rels (rel) -> url, distinct; absolute ones stand for themselves.

    Bases and routes are lists of options, so they are broadcast if they stay under Spark's own threshold.
    """
    clean = lambda c, pattern: F.regexp_replace(c, pattern, "")
    route = clean(F.col("route"), "^/+|/+$")
    base, rel = clean(F.col("base"), "/+$"), clean(F.col("rel"), "^/+")
    url = F.when(F.col("rel").rlike("^https?://"), F.col("rel")).when(route == "", F.concat_ws("/", base, rel)).otherwise(F.concat_ws("/", base, route, rel))
    return rels.join(bases, F.lit(True)).join(routes, F.lit(True)).select(url.alias("url")).distinct()


def is_url(url: Column) -> Column:
    """A known scheme, a host of two labels at least, a last label of two letters at least, a port that can be one, 2048 characters at most."""
    url = F.trim(F.coalesce(url, F.lit("")))
    labels = F.split(host(url), r"\.")
    port = F.regexp_extract(host(url), r"^[^:]*:([^:]*)$", 1)
    one = host(url).rlike(r"^[^:]*:[^:]*$")
    ok_port = ~one | (port.rlike(r"^\d{1,9}$") & F.coalesce(F.try_to_number(port, F.lit("999999999")).between(1, 65535), F.lit(False)))
    return scheme(url).isin(SCHEMES) & (F.size(labels) >= 2) & (F.length(F.element_at(labels, -1)) >= 2) & ok_port & (F.length(url) <= 2048)


def doc_name(url: Column) -> Column:
    return F.replace(host(url), F.lit("."), F.lit("_"))


def same_page_key(url: Column) -> Column:
    """A URL without scheme, www. or m., query and fragment: what duplicates are told by."""
    return F.concat(F.regexp_replace(F.lower(host(url)), r"^(?:www|m)\.", ""), F.regexp_replace(path(url), "/+$", ""))


def chunk_files(text: Column) -> Column:
    """Script files of a bundle: names of 21 to 27 characters from its chunk table, below static/js/."""
    pattern = F.lit(r'(?i)"(chunk-[\p{L}\p{N}_]+)":"([\p{L}\p{N}_]+)"')
    names = F.zip_with(F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2)), lambda a, b: F.concat(a, F.lit("."), b, F.lit(".js")))
    return F.transform(F.filter(names, lambda n: F.length(n).between(21, 27)), lambda n: F.concat(F.lit("static/js/"), n))


# Where paths stand in scripts and markup, as (pattern, group that is the path).
PATHS = [
    (r"""["'](/[^"'\s]+)["']""", 1),
    (r"""["'](\.{1,2}/[^"'\s]+)["']""", 1),
    (r"""["'](\\+/[^"'\s]+)["']""", 1),
    (r"""`(/[^`\s]+)`""", 1),
    (r"""`(\.{1,2}/[^`\s]+)`""", 1),
    (r"""\b(?:href|src|action)\s*=\s*["']?([^"'\s>]+)""", 1),
    (r"""(assets/[a-zA-Z0-9_\-./]+\.(?:js|css|png|jpg|jpeg|svg|gif|woff2?|ttf|eot|mp4|mp3|json|map))""", 1),
    (r"""['"`]((?:https?://|//)[^\s'"`]+)['"`]""", 1),
    (r"""['"`](/[^\s'"`]+)['"`]""", 1),
    (r"""['"`](\.{1,2}/[^\s'"`]+)['"`]""", 1),
    (r"""url\(['"]?([^\s'")]+)['"]?\)""", 1),
    (r"""\.(?:get|post|put|delete|patch|options|head|connect)\(['"`]([^\s'"`]+)['"`]""", 1),
    (r"""window\.location\s*=\s*['"`]([^\s'"`]+)['"`]""", 1),
    (r"""window\.open\(['"`]([^\s'"`]+)['"`]""", 1),
    (r"""fetch\(['"`]([^\s'"`]+)['"`]""", 1),
    (r"""axios\.(?:get|post|put|delete|patch|options|head|connect)\(['"`]([^\s'"`]+)['"`]""", 1),
    (r"""\.src\s*=\s*['"`]([^\s'"`]+)['"`]""", 1),
    (r"""\.href\s*=\s*['"`]([^\s'"`]+)['"`]""", 1),
    (r"""\.action\s*=\s*['"`]([^\s'"`]+)['"`]""", 1),
    (r"""['"`]url['"`]\s*:\s*['"`]([^\s'"`]+)['"`]""", 1),
    (r"""['"`](?:src|href)['"`]\s*:\s*['"`]([^\s'"`]+)['"`]""", 1),
    (r"""`(https?://[^`]+)`""", 1),
    (r"""`((?:/{1,2}|\.{1,2}/)[^`]+)`""", 1),
    (r"""router\.(?:push|replace)\(['"`]([^\s'"`]+)['"`]""", 1),
    (r"""<Route\s+path=['"`]([^\s'"`]+)['"`]""", 1),
    (r"""['"`](/api/v\d+/[^\s'"`]+)['"`]""", 1),
    (r"""['"`](/\w+/\w+\.(?:php|aspx|jsp)\??[^\s'"`]*)['"`]""", 1),
    (r"""(?:\.get|\.post|\.ajax|fetch|axios\.get|axios\.post)\s*\(\s*['"`]?([a-zA-Z0-9_/-]+)""", 1),
    (r"""['"`](/?DataInterface\.do(?:\?[^\s'"`]*)?)['"`]""", 1),
    (r"""\$\.(?:get|post|ajax)\s*\(\s*['"`]([^\s'"`]+)['"`]""", 1),
    (r"""`(https?://[^`]+|/{1,2}[^`]+|\.{1,2}/[^`]+)`""", 1),
    (r"""router\.(?:addRoute|addRoutes)\s*\(\s*['"`]([^\s'"`]+)['"`]""", 1),
    (r"""require\s*\(\s*['"`](\.[^\s'"`]+)['"`]""", 1),
    (r"""import\s*\(\s*['"`](\.[^\s'"`]+)['"`]""", 1),
]


def found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?i)" + pattern), F.lit(group))


def paths_in(text: Column) -> Column:
    """Distinct path strings of a page or script, families in turn."""
    return F.array_distinct(F.flatten(F.array(*[found(text, p, g) for p, g in PATHS])))


def tag_paths(text: Column) -> Column:
    """Distinct values of the attributes by which tags point somewhere, in double quotes, single ones, or none, wherever in
    the tag the attribute stands."""
    out = []
    for tag, names in LINK_ATTRIBUTES.items():
        start = rf"<{tag}\b[^>]*?\b{'(?:' + '|'.join(names) + ')'}\s*=\s*"
        out += [found(text, start + value) for value in (r'"([^">]*)"', r"'([^'>]*)'", r"""([^\s"'>]+)""")]
    return F.array_distinct(F.filter(F.flatten(F.array(*out)), lambda v: v != ""))


def candidates(text: Column, base: Column) -> Column:
    """All that a page or script may point to, as it stands there: paths, tags' attributes, bundle files at the root."""
    root = F.concat(scheme(base), F.lit("://"), host(base), F.lit("/"))
    return F.array_distinct(F.concat(paths_in(text), tag_paths(text), F.transform(chunk_files(text), lambda f: F.concat(root, f))))


def wanted(url: Column, s: Scope, depth: Column | None = None, max_depth: int | None = None) -> Column:
    """Whether a URL is to be fetched: not too deep; whitelist over blacklist; no skipped extension, excluded part or danger
    token; on the list of what is allowed, if there is one; in the scope."""
    ok = F.lit(True) if depth is None or max_depth is None else depth <= max_depth
    return ok & in_scope(url, s) & ~has_extension(url, s.extensions) & ~excluded(url, s.exclude) & danger_token(url, s.danger).isNull() & allowed(url, s.allow)


def page_links(url: Column, candidates: Column, s: Scope) -> Column:
    """Candidates as they stand in a page -> distinct absolute URLs that the scope takes."""
    clean = F.filter(F.transform(candidates, precleaned), lambda c: c.isNotNull())
    whole = F.transform(clean, lambda c: F.when(c.contains("http"), F.regexp_extract(c, r"https?://[^ ]+", 0)).otherwise(resolved(url, F.replace(c, F.lit("\\"), F.lit("")))))
    return F.array_distinct(F.filter(whole, lambda u: is_url(u) & wanted(u, s)))
