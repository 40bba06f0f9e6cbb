"""Per-key results where a few keys hold most rows (problem 6).

Every per-key figure is an algebraic aggregate (counts, sums, minima, maxima), so each map task folds its rows into one
small state per key, in Spark's bounded and spilling hash table, and only these states are shuffled: a key with a third of
all rows sends one row per map task, like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.latest import current_postings


def page_summary(postings: DataFrame) -> DataFrame:
    """(page_id, n_rows, occurrences, first_pos, last_pos) over the current postings of each page.

    Null words and page_ids are left out, copies and older postings count once, null positions don't count (a page with none
    has null first_pos and last_pos), an empty table gives no rows; further columns don't matter.
    """
    return current_postings(postings, positions=True).groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col("cnt").cast("bigint")).alias("occurrences"),
        F.min("first_pos").alias("first_pos"),
        F.max("last_pos").alias("last_pos"),
    )


def heavy_pages(postings: DataFrame, share: float = 0.02) -> DataFrame:
    """page_summary of the pages with more than `share` of all current postings."""
    pages = page_summary(postings)
    total = pages.agg(F.sum("n_rows").alias("n")).scalar()
    return pages.filter(F.col("n_rows") > F.lit(share) * total)
