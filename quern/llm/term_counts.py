"""Frequency of every distinct word (problem 1).

Last-seen counters: postings are hash-partitioned by word and record (page) and stand in order of word, page and age, the newest
first. In that order a row opens a new record exactly when its word and page differ from those last seen, so all that is kept
while rows pass is the last word and page; a word's state is its occurrences and its records, no set of pages. The counter is a
filter on row_number, which Spark runs as a group limit: on the map side first, so that a group of copies sends a row per map
task, and again behind the one shuffle of rows. As a word's pages are spread over all tasks, a word that holds a large part of
the rows burdens none, and since a page falls into one task the tasks' states just add up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def new_records(postings: DataFrame) -> DataFrame:
    """(word, cnt) of each row that opens a new record: the first that is seen of its word and page, which is the current posting."""
    size = F.when(F.col("pos").isNotNull(), F.size("pos"))
    rows = postings.filter(F.col("word").isNotNull() & F.col("page_id").isNotNull())
    rows = rows.select("word", "page_id", F.coalesce("count_of_page", size, F.lit(0)).alias("cnt"), F.col("indexed_at").alias("at"))
    seen = F.row_number().over(Window.partitionBy("word", "page_id").orderBy(F.col("at").desc_nulls_last()))
    return rows.withColumn("seen", seen).filter("seen = 1").select("word", "cnt")


def term_counts(postings: DataFrame) -> DataFrame:
    """(word, occurrences, records) of every non-null word, from its current postings.

    Rows with null word or page_id don't count; null counts are taken from pos, and are 0 where that is null too; copies and
    older postings count once; an empty table gives no rows; further columns don't matter.
    """
    return new_records(postings).groupBy("word").agg(F.sum(F.col("cnt").cast("bigint")).alias("occurrences"), F.count(F.lit(1)).alias("records"))


def indexed_pages(postings: DataFrame) -> DataFrame:
    """One row (pages): the distinct pages with current postings."""
    rows = postings.filter(F.col("word").isNotNull() & F.col("page_id").isNotNull())
    return rows.groupBy("page_id").agg(F.lit(1).alias("one")).agg(F.count("one").alias("pages"))


def term_marks(postings: DataFrame, min_records: int = 3, min_occurrences: int = 4, max_share: float = 0.15) -> DataFrame:
    """term_counts with mark: `rare` below either minimum, else `common` above max_share of all pages, else null."""
    pages = indexed_pages(postings).scalar()
    rare = (F.col("records") < min_records) | (F.col("occurrences") < min_occurrences)
    mark = F.when(rare, "rare").when(F.col("records") > F.lit(max_share) * pages, "common")
    return term_counts(postings).withColumn("mark", mark)
