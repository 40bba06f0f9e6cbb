"""Searching an index: pages with the phrase, with all words, with some words, each ranked by TF-IDF.

A query is a short list of words on the driver. Its plan reads the words' postings, groups them by document (at most one row
for each word and document), and derives tier, anchor and score from that row alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import idf, snippet
from quern.operators.index import doc_freq, lookup
from quern.operators.order import ranked, running_sum
from quern.operators.tokens import query_words, uses_single_characters
from quern.sources.tables import cut

#: Tiers, and the anchor of a document that has none.
PHRASE, ALL, SOME, NO_ANCHOR = 1, 2, 3, 5


def term_postings(index: DataFrame, words: list[str], key: str = "doc_id") -> DataFrame:
    """(key, tf) of the postings of a one-word query."""
    return lookup(index, words).select(key, "tf")


def word_counts(index: DataFrame, words: list[str]) -> DataFrame:
    """(ord, word, n_pages) of the query's words, rarest first; words that no document has count 0."""
    spark = index.sparkSession
    query = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "ord int, word string")
    rows = F.broadcast(query).join(doc_freq(lookup(index, words)), "word", "left")  # as many rows as the query has words
    return rows.select("ord", "word", F.coalesce("df", F.lit(0)).alias("n_pages")).orderBy("n_pages", "ord")


def _moved(positions: Column, k: int) -> Column:
    return F.transform(positions, lambda p: p - k)


def matches(index: DataFrame, words: list[str], key: str = "doc_id", pages: float = 100, phrase_anchor: int | None = None) -> DataFrame:
    """(key, tier, anchor_pos, phrase_pos, n_words, score) of every document with a word of the query.

    tier 1: the words follow each other somewhere (or there is only one word); 2: all words; 3: some. anchor_pos is where the
    first phrase starts (or phrase_anchor, if one is given), else the first position of the first query word the document has.
    Each distinct word counts once in the score, as tf * log2(pages / df). A query without words matches nothing.
    """
    distinct = list(dict.fromkeys(words))
    rows = cut(lookup(index, words))  # read twice, and all that a query needs of an index
    frequencies = F.broadcast(doc_freq(rows))  # as many rows as the query has words
    rows = rows.join(frequencies, "word").withColumn("s", F.col("tf") * idf(F.col("df"), pages))
    of = rows.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("word", "pos"))).alias("at"), F.sum(F.round("s", 9).cast("decimal(30,9)")).cast("double").alias("score"))

    def positions(word: str) -> Column:
        return F.try_element_at("at", F.lit(word))

    n = F.size("at")
    if not words:
        starts = F.array().cast("array<int>")
    else:
        moved = [_moved(positions(w), k) for k, w in enumerate(words)]
        starts = F.when(n == len(distinct), reduce(F.array_intersect, moved))
    phrase = F.array_min(starts)
    first = F.coalesce(*[F.array_min(positions(w)) for w in words], F.lit(NO_ANCHOR)) if words else F.lit(NO_ANCHOR)
    tier = F.when(phrase.isNotNull(), PHRASE).when(n == len(distinct), ALL).otherwise(SOME)
    anchor = phrase if phrase_anchor is None else F.when(phrase.isNotNull(), phrase_anchor)
    return of.select(key, tier.alias("tier"), F.coalesce(anchor, first).cast("int").alias("anchor_pos"), phrase.alias("phrase_pos"), n.alias("n_words"), F.round("score", 6).alias("score"))


def phrase_starts(hits: DataFrame, words: list[str], key: str = "doc_id") -> DataFrame:
    """(key, start_pos): every place where the words follow each other, from hits; an equi-join on position less place in the query."""
    query = [F.struct(F.lit(i).alias("ord"), F.lit(w).alias("word")) for i, w in enumerate(words)]
    rows = hits.filter(F.col("word").isin(words)).withColumn("q", F.explode(F.filter(F.array(*query), lambda x: x["word"] == F.col("word"))))
    rows = rows.select(key, (F.col("pos") - F.col("q.ord")).alias("start_pos"), F.col("q.ord").alias("ord"))
    return rows.groupBy(key, "start_pos").agg(F.count_distinct("ord").alias("n")).filter(F.col("n") == len(words)).select(key, "start_pos")


def result_code(found: DataFrame, words: list[str]) -> DataFrame:
    """(code) of a search: 7 one word, found; 0 some phrase; -3 all words but no phrase; -2 only some words; -1 nothing."""
    best = found.agg(F.min("tier").alias("tier"))
    one = len(set(words)) == 1 and len(words) == 1
    code = F.when(F.col("tier").isNull(), -1).when(F.lit(one), 7).when(F.col("tier") == PHRASE, 0).when(F.col("tier") == ALL, -3).otherwise(-2)
    return best.select(code.alias("code"))


def search(index: DataFrame, query: str, key: str = "doc_id", pages: float = 100, limit: int | None = None, keep_all: bool = False) -> DataFrame:
    """(rank, key, tier, anchor_pos, score): phrase, then all words, then some, each by score downwards and key upwards.

    With keep_all the query is split as it is written: a word that texts can't have, such as an empty one, leaves only tier 3.
    """
    words = query_words(query, keep_all)
    found = matches(index, words, key, pages).select(key, "tier", "anchor_pos", "score")
    return ranked(found, [F.col("tier"), F.col("score").desc(), F.col(key)], limit)


def search_either(pairs: DataFrame, singles: DataFrame, query: str, key: str = "doc_id", pages: float = 100, limit: int | None = None) -> DataFrame:
    """search in the 1-gram index for a query of one CJK character, else in the 2-gram index."""
    return search(singles if uses_single_characters(query_words(query)) else pairs, query, key, pages, limit)


def running_scores(index: DataFrame, words: list[str], key: str = "doc_id", pages: float = 100) -> DataFrame:
    """(key, running_score): scores as running sums in order of the key."""
    found = matches(index, words, key, pages).select(key, F.col("score").cast("decimal(30,6)").alias("s"))
    rows = running_sum(found, F.col("s"), key, "r")
    return rows.select(key, F.col("r").cast("double").alias("running_score"))


def with_pages(results: DataFrame, store: DataFrame, key: str = "page_id") -> DataFrame:
    """Results with url, title and snippet of the page store; a page the store lacks keeps its row with nulls."""
    rows = results.join(store.select(key, "url", "title", "text"), key, "left")
    return rows.withColumn("snippet", snippet(F.col("text"), F.col("anchor_pos"))).drop("text")


def rendered(rows: DataFrame) -> DataFrame:
    """(rank, line): a result as a line of html; missing fields are empty."""

    def safe(c: str) -> Column:
        x = F.coalesce(F.col(c), F.lit(""))
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            x = F.replace(x, F.lit(a), F.lit(b))
        return x

    line = F.concat(F.lit('<a href="'), safe("url"), F.lit('">'), F.col("rank").cast("string"), F.lit(": "), safe("title"), F.lit("</a><br>"), safe("snippet"), F.lit("<br>"))
    return rows.select("rank", line.alias("line"))
