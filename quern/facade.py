"""What a web server needs around search(): request lines in, pages out. Serving itself is left to any HTTP server."""

from __future__ import annotations

from urllib.parse import unquote_plus

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.search import rendered, search, with_pages
from quern.sources.tables import freed


def request_path(line: str) -> str | None:
    """The path of a GET request line; None for anything else."""
    parts = line.split()
    return parts[1] if len(parts) >= 2 and parts[0] == "GET" else None


def route(path: str) -> tuple[str, str]:
    """('search', query) where the path has a parameter, else ('file', path), `/` being `/index.html`."""
    if "=" in path:
        return "search", unquote_plus(path.split("=", 1)[1], errors="replace")
    return "file", "/index.html" if path == "/" else path


def results_page(index: DataFrame, store: DataFrame, query: str, limit: int = 100) -> str:
    """The first results as an html page; a note where nothing is found."""
    with freed():
        found = search(index.withColumnRenamed("page_id", "doc_id"), query, limit=limit).withColumnRenamed("doc_id", "page_id")
        lines = [r["line"] for r in rendered(with_pages(found, store)).orderBy(F.col("rank")).collect()]
    return "<html><body>" + ("".join(lines) or "no record") + "</body></html>"
