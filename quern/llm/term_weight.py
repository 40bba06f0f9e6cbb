"""How distinctive a word is for a page (problem 4).

Probabilistic relevance weighting: a word's weight in a page is its inverse document frequency times its frequency, which
saturates with k1 and is normalised by the page's length with b. Without k1 the frequency stays linear, which is the limit of
the same formula for a growing k1 with b = 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.term_counts import indexed_pages
from quern.operators.latest import current_postings
from quern.sources.tables import cut

#: Parts of a page's words when its greatest scores are looked for.
SALTS = 16


def document_frequencies(current: DataFrame) -> DataFrame:
    """(word, d): the pages having each word."""
    return current.groupBy("word").agg(F.count(F.lit(1)).alias("d"))


def term_weights(postings: DataFrame, k1: float | None = 1.2, b: float = 0.75, idf: str = "probabilistic") -> DataFrame:
    """(page_id, word, cnt, d, score) of every current posting; score is rounded to 6 digits.

    idf `probabilistic` is ln(1 + (P - d + 0.5) / (d + 0.5)), `log2` is log2(P / d). Null words and pages are left out, copies
    and older postings count once, a count that is null is taken from pos (0 if null too); an empty table gives no rows;
    further columns don't matter. Words are joined to their document frequencies by shuffle, which AQE splits for hot words;
    page lengths are partial sums per page. Current postings are written once, as they are read two or three times.
    """
    pages = indexed_pages(postings).scalar()
    current = cut(current_postings(postings))
    rows = current.join(document_frequencies(current), "word")
    tf = F.col("cnt").cast("double")
    if k1 is not None:
        length = current.groupBy("page_id").agg(F.sum("cnt").alias("length"))
        average = length.agg(F.avg("length").alias("average")).scalar()
        rows = rows.join(length, "page_id")
        tf = tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / average))
    if idf == "log2":
        weight = F.log2(pages / F.col("d"))
    else:
        weight = F.log(1 + (pages - F.col("d") + 0.5) / (F.col("d") + 0.5))
    return rows.select("page_id", "word", F.col("cnt").cast("bigint").alias("cnt"), "d", F.round(tf * weight, 6).alias("score"))


def most_distinctive(weights: DataFrame) -> DataFrame:
    """(page_id, word, score): of each page the words with its greatest score, all that tie.

    Pages are split into parts by a salt of the word. Before any shuffle, each task keeps only what ranks first in its part of a
    page (a rank filter becomes a group limit), so a page with a large part of the rows sends few of them. The parts' firsts are
    then written once and held against the page's greatest score, by a join that AQE splits where very many words tie.
    """
    salt = F.pmod(F.hash("word"), F.lit(SALTS))
    first = F.rank().over(Window.partitionBy("page_id", "salt").orderBy(F.col("score").desc()))
    firsts = cut(weights.select("page_id", "word", "score", salt.alias("salt")).withColumn("first", first).filter("first = 1").select("page_id", "word", "score"))
    top = firsts.groupBy("page_id").agg(F.max("score").alias("score"))
    return firsts.join(top, ["page_id", "score"]).select("page_id", "word", "score")
