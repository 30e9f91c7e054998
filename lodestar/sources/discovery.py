"""Seed discovery over fetched list pages and service responses: pure functions of their text."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import html as H
from ..functions import text as T

# Keys under which services tell how many records there are, and who a record is about.
TOTAL_KEYS = ("total", "totalCount", "allCount", "recordCount", "count")
NAME_KEYS = ("name", "title", "teacherName", "cnName")
SEEDS = S.ArrayType(S.StructType([S.StructField("name", S.StringType()), S.StructField("url", S.StringType()), S.StructField("record", S.StringType())]))


def static_cards(html: Column, css_class: str = "news_box") -> Column:
    """(href, text) of the anchors of a class."""
    whole = F.regexp_extract_all(html, F.lit(rf"""(?is)(<a\b[^>]*class=["'][^"']*\b{css_class}\b[^"']*["'][^>]*>.*?</a>)"""), F.lit(1))
    return F.transform(whole, lambda a: F.struct(F.regexp_extract(a, r"""(?is)href=["']([^"']*)["']""", 1).alias("href"), T.squeeze(H.html_to_text(a)).alias("text")))


def clean_name(c: Column, suffixes: tuple[str, ...] = ("访问",)) -> Column:
    """A display name without white-space runs and without what follows a suffix word."""
    return F.trim(F.regexp_replace(T.squeeze(c), rf"\s+(?:{'|'.join(map(re.escape, suffixes))}).*$", ""))


def walk(node: Any, pattern: re.Pattern, name: str = "") -> Iterator[tuple[str, str, str]]:
    """(name in force, url, record) of every url in a JSON value; a record's name holds for what it contains."""
    if isinstance(node, dict):
        name = next((str(node[k]) for k in NAME_KEYS if node.get(k)), name)
        record = json.dumps(node, ensure_ascii=False)
        for v in node.values():
            yield from ((name, u, record) for u in pattern.findall(v)) if isinstance(v, str) else walk(v, pattern, name)
    elif isinstance(node, list):
        for v in node:
            yield from walk(v, pattern, name)
    elif isinstance(node, str):
        yield from ((name, u, node) for u in pattern.findall(node))


def json_seeds(text: Column, host: str) -> Column:
    """Seeds (name, url, record) in a JSON response, each url once; none if it is not JSON."""
    pattern = re.compile(rf"(?:(?:https?:)?//)?{re.escape(host)}/[A-Za-z0-9_\-./%]+")

    @F.pandas_udf(SEEDS)
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list:
            first: dict[str, tuple] = {}
            try:
                for n, u, r in walk(json.loads(t or ""), pattern):
                    first.setdefault(u, (n, u, r))
            except json.JSONDecodeError:
                return []
            return list(first.values())

        return texts.map(one)

    return run(text)


def total_pages(text: Column, rows: int) -> Column:
    """Pages of a JSON response: the first number under a key that tells the total, over the rows of a page; 1 at least."""
    keys = "|".join(TOTAL_KEYS)
    found = F.regexp_extract(text, rf'"(?:{keys})"\s*:\s*"?(\d+)', 1)
    return H.page_count(F.when(found == "", 0).otherwise(found.try_cast("int")), rows)


def query_payload(config: Column, page: Column, rows: int) -> Column:
    """The request body of a paged service: paging, conditions of the configuration's map, returned fields."""
    conditions = F.transform(F.map_entries(config), lambda e: F.struct(e["key"].alias("field"), e["value"].alias("value"), F.lit("=").alias("judge")))
    return F.to_json(F.struct(page.alias("page"), F.lit(rows).alias("rows"), conditions.alias("conditions"), F.array(F.lit("title"), F.lit("url")).alias("returnInfos")))


def page_diagnostics(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Size, title and counts of anchors and forms of pages, for a look at what was fetched."""
    h = T.text(html_col)
    return pages.withColumns({"title": H.html_title(h), "bytes": F.octet_length(h), "anchors": F.size(H.hrefs(h)), "forms": T.occurrences(F.lower(h), "<form")})
