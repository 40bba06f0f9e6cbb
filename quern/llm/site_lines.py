"""Lines repeated across one site's pages (problem 3).

Normalised lines are hashed; the distinct pages per (site, hash) are counted (a page's own repeats fall together inside its
row, before any shuffle), those above the share threshold are kept, joined back on (site, hash), and pages are rebuilt without
them. The key (site, hash) spreads a site with a large part of all pages over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.urls import site
from quern.operators.latest import current_pages
from quern.sources.tables import cut

MIN_PAGES, MIN_SHARE = 6, 0.03


def normalised(line: Column) -> Column:
    """Lower case, each run of blanks, tabs and carriage returns one blank, trimmed, each run of digits one 0."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(line), r"[ \t\r]+", " ")), r"[0-9]+", "0")


def page_lines(pages: DataFrame) -> DataFrame:
    """(page_id, site, hashes): of each current page its site (null without url) and the hash of each line, null for empty ones."""
    lines = F.transform(F.split("raw_text", "\n", -1), normalised)
    hashes = F.transform(lines, lambda x: F.when(F.length(x) > 0, F.xxhash64(x)))
    return current_pages(pages, "url", "raw_text").select("page_id", site(F.col("url")).alias("site"), hashes.alias("hashes"))


def frequent_lines(lines: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(site, h, n): hashes on at least min_pages distinct pages and at least min_share of the site's pages."""
    known = lines.filter(F.col("site").isNotNull())
    counts = known.select("site", F.explode(F.array_distinct("hashes")).alias("h")).filter("h is not null")
    counts = counts.groupBy("site", "h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    sizes = known.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    return counts.join(sizes, "site").filter(F.col("n") >= min_share * F.col("pages")).select("site", "h", "n")


def repeated_lines(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(page_id, line_no): every line of a current page that is repeated on its site.

    Pages without url have no site and so no repeated lines; pages with null raw_text count as pages only; empty lines never
    count; older fetches and copies are left out; an empty table gives no rows; further columns don't matter.
    """
    lines = cut(page_lines(pages))  # read twice, and much smaller than the texts
    frequent = frequent_lines(lines, min_pages, min_share)
    each = lines.filter(F.col("site").isNotNull()).select("page_id", "site", F.posexplode("hashes").alias("line_no", "h"))
    return each.filter("h is not null").join(frequent, ["site", "h"], "left_semi").select("page_id", "line_no")


def without_repeated(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(page_id, text, removed): every current page's text without its repeated lines, and how many those were.

    A text that is null stays null.
    """
    dropped = repeated_lines(pages, min_pages, min_share).groupBy("page_id").agg(F.collect_set("line_no").alias("dropped"))
    rows = current_pages(pages, "raw_text").join(dropped, "page_id", "left")
    kept = F.filter(F.split("raw_text", "\n", -1), lambda x, i: ~F.coalesce(F.array_contains("dropped", i), F.lit(False)))
    n = F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped"))
    return rows.select("page_id", F.when(F.col("raw_text").isNotNull(), F.array_join(kept, "\n")).alias("text"), n.alias("removed"))
