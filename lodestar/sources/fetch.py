"""Pages from the network, in Arrow batches; needs a network, so nothing else depends on it."""

from __future__ import annotations

import re
import time
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

BAD = ("�", "鍛", "瑙", "鐮", "绠", "瀛", "涓", "嗗", "俓n")  # fixed values: characters that wrong decodings leave


def decode(data: bytes, declared: str | None = None) -> str:
    """The decoding with the fewest signs of damage among UTF-8, the declared charset, the page's own and the Chinese ones."""
    own = re.search(rb"charset\s*=\s*['\"]?([A-Za-z0-9_\-]+)", data[:4096], re.IGNORECASE)
    options = dict.fromkeys(c.lower() for c in ("utf-8", declared, own and own.group(1).decode(), "gb18030", "gbk") if c)
    texts = []
    for charset in options:
        try:
            texts.append(data.decode(charset))
        except (LookupError, UnicodeDecodeError):
            continue
    return min(texts, key=lambda t: sum(map(t.count, BAD)), default=data.decode("utf-8", "replace"))


def fetch_pages(urls: DataFrame, timeout: float = 15, pause: float = 1.0, agent: str = "lodestar/0.1", plain_hosts: tuple[str, ...] = ()) -> DataFrame:
    """(url, final_url, html, status_code, error) of a table of urls; ``plain_hosts`` are tried without https when that fails."""

    def get(url: str) -> tuple:
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout) as r:
                return url, r.geturl(), decode(r.read(), r.headers.get_content_charset()), r.status, None
        except Exception as e:  # the ledger keeps what went wrong
            host = url.split("://", 1)[-1].split("/", 1)[0]
            if url.startswith("https://") and host in plain_hosts:
                return (url, *get("http://" + url[len("https://") :])[1:])
            return url, url, "", 0, str(e)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for u in b["url"]:
                rows.append(get(u))
                time.sleep(pause)
            yield pd.DataFrame(rows, columns=["url", "final_url", "html", "status_code", "error"])

    return urls.select("url").mapInPandas(run, "url string, final_url string, html string, status_code int, error string")
