"""Fetching pages over HTTP, for crawls that aren't over stored pages."""

from __future__ import annotations

import gzip
import time
import urllib.error
import urllib.request
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.urls import authority


def download(url: str, agent: str = "quern", retries: int = 3, timeout: float = 5.0, pause: float = 0.2) -> str | None:
    """The page as text: gzip is inflated, server errors are tried again up to `retries` times, after a pause that doubles; None when it fails."""
    for again in range(retries + 1):
        if again:
            time.sleep(pause * 2 ** (again - 1))
        try:
            request = urllib.request.Request(url, headers={"User-Agent": agent, "Accept-Encoding": "gzip"})
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                data = answer.read()
                if answer.headers.get("Content-Encoding") == "gzip":
                    data = gzip.decompress(data)
                return data.decode(answer.headers.get_content_charset() or "utf-8", errors="replace")
        except urllib.error.HTTPError as error:
            if not 500 <= error.code < 600:
                return None
        except (OSError, ValueError, EOFError, LookupError, zlib.error):
            return None
    return None


def fetched(urls: DataFrame, delay: float = 0.0, agent: str = "quern", retries: int = 3, timeout: float = 5.0) -> DataFrame:
    """(url, html, fetched_at) of each row of (url): html is null where fetching fails.

    Urls are dealt to tasks by host, so that no host is asked by two tasks at a time, and a task waits `delay` seconds between two
    pages of one host. Waiting for one host is the limit on its speed, whatever its number of pages.
    """

    def fetch(batches):
        last: dict[str, float] = {}
        for pdf in batches:
            pages, times = [], []
            for url, host in zip(pdf["url"], pdf["host"]):
                wait = last.get(host, 0.0) + delay - time.monotonic() if host in last else 0.0
                if wait > 0:
                    time.sleep(wait)
                last[host] = time.monotonic()
                pages.append(download(url, agent, retries, timeout) if isinstance(url, str) else None)
                times.append(pd.Timestamp.now(tz="UTC"))
            yield pd.DataFrame({"url": pdf["url"], "html": pages, "fetched_at": pd.Series(times, dtype="datetime64[ns, UTC]")})

    rows = urls.select("url", F.coalesce(F.lower(authority(F.col("url"))), F.lit("")).alias("host"))
    return rows.repartition("host").mapInPandas(fetch, "url string, html string, fetched_at timestamp")
