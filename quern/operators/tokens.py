"""Tokenizers: texts to (word, position), queries to words.

A word is a run of letters, a pair of adjacent CJK characters, or in the 2-gram tokenizer a CJK character that stands alone. A
word that reaches the end of the text isn't ended there and is left out, unless flush_tail is set.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import CJK, clean


def line_words(line: Column) -> Column:
    """The words of a cleaned line as an array."""
    runs = F.regexp_extract_all(line, F.lit(f"[A-Za-z]+|[{CJK}]+"), F.lit(0))

    def words(run: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
        return F.when((F.length(run) == 1) | (run < "{"), F.array(run)).otherwise(pairs)

    return F.flatten(F.transform(runs, words))


def bigram_hits(docs: DataFrame, key: str = "doc_id", text: str = "text", flush_tail: bool = False) -> DataFrame:
    """(key, word, pos) of every word of every text.

    A position is the number of words before, less one for each earlier line that ended right after a word: line ends don't
    advance it. Null texts have no words. Words are found line by line; only the lines of a text are put in order, in one task
    for each text.
    """
    lines = docs.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.split(clean(F.col(text)), "\n", -1)).alias("line_no", "line"))
    lines = lines.select(key, "line_no", line_words(F.col("line")).alias("words"), F.col("line").rlike("[^ ]$").alias("open"))
    in_order = Window.partitionBy(key).orderBy("line_no")
    step = F.size("words") - F.when(F.col("open") & (F.size("words") > 0), 1).otherwise(0)
    before = F.coalesce(F.sum(step).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    last = F.lead("line_no").over(in_order).isNull()
    rows = lines.select(key, "words", "open", before.alias("before"), last.alias("last"))
    words = F.col("words")
    if not flush_tail:
        words = F.when(F.col("last") & F.col("open") & (F.size(words) > 0), F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(words)
    rows = rows.select(key, "before", words.alias("words")).select(key, "before", F.posexplode("words").alias("i", "word"))
    return rows.select(key, "word", (F.col("before") + F.col("i")).alias("pos"))


def unigram_hits(docs: DataFrame, key: str = "doc_id", text: str = "text", flush_tail: bool = False) -> DataFrame:
    """(key, word, pos) with every CJK character a word of its own; line ends advance the position. No shuffle."""
    rows = docs.filter(F.col(text).isNotNull()).select(key, clean(F.col(text)).alias("c"))
    words = F.regexp_extract_all("c", F.lit(f"[A-Za-z]+|[{CJK}]"), F.lit(0))
    if not flush_tail:
        words = F.when(F.col("c").rlike("[^ \n]$"), F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(words)
    return rows.select(key, words.alias("words")).select(key, F.posexplode("words").alias("pos", "word")).select(key, "word", "pos")


def query_words(query: str, keep_all: bool = False) -> list[str]:
    """The words of a query in order. It is cleaned as texts are, and empty words are dropped; with keep_all, digits 1-9 and
    punctuation stay in words, and a query that ends in a separator has an empty last word."""
    words: list[str] = []
    if not keep_all:
        for run in re.findall("[A-Za-z]+|[㆒-謹]+", re.sub("[^A-Za-z \n㆒-謹]", "", query)):
            words += [run] if run[0] < "{" or len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)]
        return words
    kept = "".join(c for c in query if c in " \n" or "0" < c < "\x80" or c >= "ࠀ")
    for run in re.findall("[1-\x7f]+|[ࠀ-\U0010ffff]+", kept):
        words += [run] if run[0] < "\x80" or len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)]
    return words + ([""] if not kept or kept[-1] in " \n" else [])


def uses_single_characters(words: list[str]) -> bool:
    """Whether a query is looked up in the 1-gram index: it is one CJK character."""
    return len(words) == 1 and len(words[0]) == 1 and words[0] >= "㆒"
