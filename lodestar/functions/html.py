"""HTML and URL functions: built-in expressions for everything but relative resolution and a real HTML tokenizer."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

# What becomes of markup, in order (portable regular expressions).
MARKUP = (
    (r"(?is)<(script|style|noscript)\b[^>]*>.*?</(script|style|noscript)>", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"(?s)<[^>]*>", "\n"),
)
LAYOUT = ((r"[ \t\r]+", " "), (r" ?\n[ \n]*", "\n"), (r"^\n|\n$", ""))
#: Named entities that occur in text; the ampersand comes last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
# Suffixes that are never crawled.
NOT_PAGES = ("jpg", "jpeg", "png", "gif", "css", "js", "pdf", "doc", "docx")


def html_to_text(c: Column) -> Column:
    """Visible text: scripts and styles dropped, tags as line breaks, entities decoded, white space squeezed line by line."""
    for pattern, by in MARKUP:
        c = F.regexp_replace(c, pattern, by)
    for entity, by in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(by))
    for pattern, by in LAYOUT:
        c = F.regexp_replace(c, pattern, by)
    return c


def html_title(c: Column) -> Column:
    """The title element's text."""
    return F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1)


def hrefs(c: Column) -> Column:
    """Targets of all anchors, in order."""
    return F.regexp_extract_all(c, F.lit(r"""(?is)<a\b[^>]*?\bhref=["']([^"']*)["']"""), F.lit(1))


def markdown_links(c: Column) -> Column:
    """(text, url) pairs of markdown links: the fall-back of list pages."""
    return F.regexp_extract_all(c, F.lit(r"\]\((https?://[^)\s]+)\)"), F.lit(1))


@F.pandas_udf(S.ArrayType(S.StringType()))
def resolve(base: pd.Series, links: pd.Series) -> pd.Series:
    """Links made absolute against their page (RFC 3986 needs a parser)."""
    def one(b: str, xs: list) -> list:
        out = []
        for x in xs if xs is not None else []:
            try:
                out.append(urljoin(b or "", x))
            except ValueError:
                pass
        return out

    return pd.Series([one(b, xs) for b, xs in zip(base, links, strict=True)])


URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def normalize_url(c: Column) -> Column:
    """Scheme and host lower-cased, an empty path as ``/``, the query kept, the fragment dropped."""
    part = lambda k: F.regexp_extract(c, URL, k)
    scheme = F.when(part(1) == "", "https").otherwise(F.lower(part(1)))
    path = F.when(part(3) == "", "/").otherwise(part(3))
    query = F.when(part(4) == "", "").otherwise(F.concat(F.lit("?"), part(4)))
    return F.concat(scheme, F.lit("://"), F.lower(part(2)), path, query)


def url_host(c: Column) -> Column:
    return F.regexp_extract(c, URL, 2)


def url_path(c: Column) -> Column:
    return F.regexp_extract(c, URL, 3)


def url_scheme(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, URL, 1))


def crawlable(path: Column) -> Column:
    """Whether a path looks like a page: a page suffix, a folder, or a last part without a dot."""
    low = F.lower(path)
    return ~low.rlike(rf"\.({'|'.join(NOT_PAGES)})$") & (low.rlike(r"(\.html?|/)$") | low.rlike(r"(^|/)[^/.]*$"))


def client_redirect(html: Column) -> Column:
    """Raw target of a meta refresh or a location assignment; empty if there is none."""
    meta = F.regexp_extract(html, r"""(?i)<meta[^>]+http-equiv=["']?refresh["']?[^>]+content=["'][^"']*url=([^"'>]+)""", 1)
    script = F.regexp_extract(html, r"""(?i)(?:window\.)?location(?:\.href)?\s*=\s*['"]([^'"]+)['"]""", 1)
    return F.trim(F.when(meta != "", meta).otherwise(script))


def discover_links(base: Column, html: Column, same_domain: bool = True, domains: tuple[str, ...] = ()) -> Column:
    """Normalised page links of a document, distinct, in order."""
    links = resolve(base, hrefs(html))
    def allowed(u: Column) -> Column:
        ok = url_scheme(u).isin("http", "https") & crawlable(url_path(u))
        if domains:
            return ok & url_host(u).isin(*domains)
        return ok & (url_host(u) == url_host(base)) if same_domain else ok

    return F.array_distinct(F.transform(F.filter(links, allowed), normalize_url))


def repair_url(c: Column, secure_host: str = "") -> Column:
    """A hand-written url: quotes and punctuation off the ends, a missing scheme added; on ``secure_host`` https and a closing slash."""
    c = F.regexp_replace(F.trim(c), "^[\"'，,。；;)]+|[\"'，,。；;)]+$", "")
    c = F.when(c.startswith("//"), F.concat(F.lit("https:"), c)).otherwise(c)
    if secure_host:
        c = F.when(c.startswith(secure_host + "/"), F.concat(F.lit("https://"), c)).otherwise(c)
        c = F.when(F.lower(url_host(c)) == secure_host, F.regexp_replace(c, "^http:", "https:")).otherwise(c)
        leaf = F.regexp_extract(url_path(c), "([^/]*)$", 1)
        c = F.when((F.lower(url_host(c)) == secure_host) & (leaf != "") & ~leaf.contains("."), F.regexp_replace(c, r"^([^?#]*)", "$1/")).otherwise(c)
    return c


def repeated_unquote(c: Column, rounds: int = 3) -> Column:
    """Percent escapes decoded up to ``rounds`` times."""
    for _ in range(rounds):
        c = F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)
    return c


def query_map(url: Column) -> Column:
    """The query string's parameters; the first value of a repeated one."""
    q = F.regexp_extract(url, URL, 4)
    cut = lambda p: F.instr(p, "=")
    pairs = F.transform(F.split(q, "&"), lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.when(cut(p) > 0, F.substring(p, cut(p) + 1, F.length(p))).otherwise("").alias("value")))
    first = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda x: x["key"]), p["key"]) == i + 1)
    return F.when(q == "", F.create_map().cast("map<string,string>")).otherwise(F.map_from_entries(first))


def page_count(total: Column, rows: int) -> Column:
    """Pages of ``rows`` rows; one at least."""
    return F.greatest(F.lit(1), F.ceil(total / rows)).cast("int")
