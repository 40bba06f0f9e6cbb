"""Running figures and ranks over whole tables, without gathering a table or a hot key into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.tables import cut


def running_sum(df: DataFrame, value: Column, by: str, name: str, key: str | None = None) -> DataFrame:
    """df with name: the sum of value up to and with each row, in order of the column by, within key if one is given.

    Rows are sorted by ranges of (key, by), written once with the number of their range, and summed up inside ranges; sums of
    ranges are added up across them. A task holds a range of rows, whose number doesn't depend on how by is spread and which split
    a hot key too, or the sums of one key, at most one for each range.
    """
    keys = [key] if key else []
    rows = cut(df.withColumn("__v", value).orderBy(*keys, by).withColumn("__b", F.spark_partition_id()))
    inside = Window.partitionBy(*keys, "__b").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy(*keys, "__b").agg(F.sum("__v").alias("__s"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    sums = sums.select(*keys, "__b", F.coalesce(F.sum("__s").over(before), zero).alias("__before"))
    rows = rows.withColumn("__in", F.sum("__v").over(inside)).join(sums, [*keys, "__b"])
    return rows.withColumn(name, F.col("__before") + F.col("__in")).drop("__v", "__b", "__in", "__before")


def ranked(df: DataFrame, order: list[Column], limit: int | None = None, name: str = "rank") -> DataFrame:
    """df with its rank 1, 2, ... in the order given, which must be total.

    With a limit, the first rows are taken by a top-k of every partition. Without one, rows are sorted by ranges, and a range's
    ranks start after the counts of the ranges before it, so no task sees more than its range.
    """
    if limit is not None:
        top = df.orderBy(*order).limit(limit)
        return top.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    rows = cut(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__part", before.alias("__before"))  # one row per task of the sort
    rows = rows.withColumn("__part", part).join(starts, "__part")
    return rows.withColumn(name, (F.col("__before") + inside + 1).cast("bigint")).drop("__at", "__part", "__before")
