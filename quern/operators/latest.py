"""Current rows of the tables that keep older versions and copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def or_long_ago(at: Column) -> Column:
    """at, or for null a time before all others."""
    return F.coalesce(at, F.lit("0001-01-01 00:00:00").cast("timestamp"))



def latest(df: DataFrame, key: str, at: str) -> DataFrame:
    """One row per key, the one with the greatest `at` (null counts as oldest; of rows that tie, any). Rows with a null key
    are left out.

    The filter on row_number becomes a group limit before the shuffle, so a key with very many rows sends one row per map
    task only.
    """
    rn = "__rn"
    w = Window.partitionBy(key).orderBy(F.col(at).desc_nulls_last())
    return df.filter(F.col(key).isNotNull()).withColumn(rn, F.row_number().over(w)).filter(F.col(rn) == 1).drop(rn)


def current_pages(pages: DataFrame, *columns: str) -> DataFrame:
    """The current row of each page_id, with page_id and the columns named."""
    return latest(pages.select("page_id", *columns, "fetched_at"), "page_id", "fetched_at").drop("fetched_at")


def current_postings(postings: DataFrame, positions: bool = False) -> DataFrame:
    """One row (word, page_id, cnt) per word and page: the posting with the greatest indexed_at (null counts as oldest).

    cnt is count_of_page, or the length of pos where that is null, or 0 where both are. With positions, also first_pos and
    last_pos, null where pos is null or empty. Rows with null word or page_id are left out. The aggregate is algebraic and
    runs on the map side first; its key (word, page_id) spreads hot words and hot pages alike.
    """
    size = F.when(F.col("pos").isNotNull(), F.size("pos"))
    at = or_long_ago(F.col("indexed_at"))
    rows = postings.filter(F.col("word").isNotNull() & F.col("page_id").isNotNull()).select(
        "word", "page_id", at.alias("at"), F.coalesce("count_of_page", size, F.lit(0)).cast("int").alias("cnt"),
        *([F.array_min("pos").alias("lo"), F.array_max("pos").alias("hi")] if positions else []),
    )
    aggs = [F.max_by("cnt", "at").alias("cnt")]
    if positions:
        aggs += [F.max_by("lo", "at").alias("first_pos"), F.max_by("hi", "at").alias("last_pos")]
    return rows.groupBy("word", "page_id").agg(*aggs)
