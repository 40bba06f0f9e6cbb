"""Crawling over stored pages: links, frontier, breadth-first levels, host schedule. Nothing is fetched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import links
from quern.functions.urls import authority, resolved, same_domain
from quern.operators.order import ranked, running_sum
from quern.sources.tables import cut


def page_links(pages: DataFrame, strict: bool = False, pattern: str | None = None, key: str = "page_id") -> DataFrame:
    """(key, link) of every link as written, one row each time, if it matches the pattern."""
    rows = pages.select(key, F.explode(links(F.col("html"), strict)).alias("link"))
    return rows.filter(F.col("link").rlike(pattern)) if pattern else rows


def link_graph(pages: DataFrame, strict: bool = False, within_site: bool = False) -> DataFrame:
    """(source, target): absolute urls of pages and of what they link to, each pair once."""
    rows = pages.filter("url is not null").select("url", F.explode(links(F.col("html"), strict)).alias("link"))
    rows = rows.select(F.col("url").alias("source"), resolved(F.col("url"), F.col("link")).alias("target")).distinct()
    return rows.filter(same_domain(F.col("source"), F.col("target"))) if within_site else rows


def new_links(graph: DataFrame, seen: DataFrame) -> DataFrame:
    """(link): targets that aren't among the seen urls, each once."""
    return graph.select(F.col("target").alias("link")).distinct().join(seen.select(F.col("url").alias("link")), "link", "left_anti")


def crawl_levels(graph: DataFrame, seeds: DataFrame, cap: int = 10001) -> DataFrame:
    """(url, depth): what a breadth-first crawl from the seeds reaches over stored links, until cap urls are reached or nothing is new.

    The links are written once. Each level is a join of the last one with them, less what was seen, written once; the cap falls on
    whole levels and, in the last one, on the first urls.
    """
    graph = cut(graph.select("source", "target"))
    seen = last = cut(seeds.select("url").filter("url <> ''").distinct().withColumn("depth", F.lit(0)))
    n = total = seen.count()
    before = None
    while n and total < cap:
        step = graph.join(last.select(F.col("url").alias("source")), "source", "left_semi").select(F.col("target").alias("url")).distinct()
        depth = last.first()["depth"] + 1
        before, last = seen, cut(step.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)))
        n = last.count()
        total += n
        seen = before.union(last)
    if total <= cap:
        return seen
    some = ranked(last, [F.col("url")]).filter(F.col("rank") <= cap - (total - n)).drop("rank")
    return some if before is None else before.union(some)


def host_schedule(pages: DataFrame, delay: float = 0.0, key: str = "page_id") -> DataFrame:
    """(key, host, slot, at): each page's place among its host's in order of the key, and the seconds after which it may be fetched.

    Pages without a host have none and aren't scheduled. Places are counted inside ranges and across them, so that a host
    with a large part of all pages isn't gathered into one task.
    """
    rows = pages.select(key, F.lower(authority(F.col("url"))).alias("host")).filter("host is not null")
    rows = running_sum(rows, F.lit(1), key, "slot", "host")
    return rows.select(key, "host", F.col("slot").cast("int").alias("slot"), ((F.col("slot") - 1) * F.lit(float(delay))).alias("at"))


def host_counts(pages: DataFrame) -> DataFrame:
    """(host, n_pages)."""
    rows = pages.select(F.lower(authority(F.col("url"))).alias("host")).filter("host is not null")
    return rows.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"))


def assigned_ids(urls: DataFrame, order: list[str]) -> DataFrame:
    """urls with page_id 0, 1, ... in the order given."""
    return ranked(urls, [F.col(c) for c in order], name="page_id").withColumn("page_id", F.col("page_id") - 1)
