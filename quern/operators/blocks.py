"""Main-text extraction from blocks of lines.

Blocks are parted at the end of each empty line but the first line. Pages with a null text have no lines. A page's lines and blocks are worked on in one task for each page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def block_lines(pages: DataFrame, text: str, key: str = "page_id") -> DataFrame:
    """(key, line_no, line, block_no, weight) of the lines of a text; weight counts characters other than blanks."""
    lines = pages.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.when((F.col("line") == "") & (F.col("line_no") > 0), 1).otherwise(0)
    block = F.coalesce(F.sum(ends).over(before), F.lit(0)).cast("int")
    return lines.select(key, "line_no", "line", block.alias("block_no"), F.length(F.replace("line", F.lit(" "), F.lit(""))).alias("weight"))


def blocks(lines: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, block_no, lo, hi, weight): the first and last line and the weight of each block."""
    return lines.groupBy(key, "block_no").agg(F.min("line_no").alias("lo"), F.max("line_no").alias("hi"), F.sum("weight").alias("weight"))


def densest(lines: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, block_no, lo, hi, weight): each page's heaviest block, the first of equals."""
    best = F.max_by(F.struct("block_no", "lo", "hi", "weight"), F.struct("weight", -F.col("block_no"))).alias("b")
    return blocks(lines, key).groupBy(key).agg(best).select(key, "b.*")


def main_text(lines: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, text): the lines of the heaviest block and of those two, four, ... further on either side, as far as they have weight."""
    w = Window.partitionBy(key, F.pmod("block_no", F.lit(2))).orderBy("block_no")
    runs = blocks(lines, key).withColumn("run", F.coalesce(F.sum(F.when(F.col("weight") == 0, 1).otherwise(0)).over(w), F.lit(0)))
    best = densest(lines, key).select(key, F.col("block_no").alias("best"))
    home = runs.join(best, key).filter("block_no = best").select(key, "best", F.col("run").alias("home"))
    near = runs.join(home, key).filter("run = home and (weight > 0 or block_no = best) and pmod(block_no - best, 2) = 0").select(key, "block_no")
    kept = lines.join(near, [key, "block_no"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    return kept.groupBy(key).agg(F.array_join(ordered, "\n").alias("text"))


def paragraphs(pages: DataFrame, text: str, key: str = "page_id") -> DataFrame:
    """(key, block_no, weight, text): runs of lines that aren't empty, numbered from 0; weight counts their characters and line ends."""
    lines = pages.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    w = Window.partitionBy(key).orderBy("line_no")
    starts = F.when((F.col("line") != "") & (F.coalesce(F.lag("line").over(w), F.lit("")) == ""), 1).otherwise(0)
    lines = lines.withColumn("starts", starts).withColumn("block_no", (F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    return lines.filter("line <> ''").groupBy(key, "block_no").agg(F.sum(F.length("line") + 1).alias("weight"), F.array_join(ordered, "\n").alias("text"))


def top_half(pages: DataFrame, text: str, key: str = "page_id") -> DataFrame:
    """(key, block_no, weight, rank, text): each page's heavier half of paragraphs, rounded down, heaviest first, earlier ones first of equals."""
    w = Window.partitionBy(key)
    rows = paragraphs(pages, text, key)
    rows = rows.withColumn("rank", F.row_number().over(w.orderBy(F.col("weight").desc(), "block_no"))).withColumn("n", F.count(F.lit(1)).over(w))
    return rows.filter("rank <= floor(n * 0.5)").select(key, "block_no", "weight", "rank", "text")


def top_half_text(pages: DataFrame, text: str, key: str = "page_id") -> DataFrame:
    """(key, text): the paragraphs of top_half joined by blanks, heaviest first."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"])
    return top_half(pages, text, key).groupBy(key).agg(F.array_join(ordered, " ").alias("text"))
