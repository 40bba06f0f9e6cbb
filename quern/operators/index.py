"""The positional inverted index: postings, document frequencies, storage, appending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import idf
from quern.operators.order import running_sum


def postings(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, word, tf, pos): occurrences and ascending positions. Hits that are in order of the key's partitioning aren't shuffled again."""
    return hits.groupBy(key, "word").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.array_sort(F.collect_list("pos")).alias("pos"))


def doc_freq(index: DataFrame) -> DataFrame:
    """(word, df) of postings: in how many documents a word is."""
    return index.groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def running_doc_freq(index: DataFrame, key: str = "doc_id") -> DataFrame:
    """(word, key, df_so_far): how many documents had the word up to and with this one, in order of the key."""
    return running_sum(index.select("word", key), F.lit(1), key, "df_so_far", "word")


def inverse_doc_freq(index: DataFrame, pages: float = 100) -> DataFrame:
    """(word, idf), rounded to 6 digits."""
    return doc_freq(index).select("word", F.round(idf(F.col("df"), pages), 6).alias("idf"))


#: Folders of a stored index at least, and where their number stands.
BUCKETS, BUCKETS_KEY = 64, "buckets"


def bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.hash(word), F.lit(buckets))


def write_index(index: DataFrame, path: str, buckets: int | None = None, mode: str = "overwrite", key: str = "doc_id") -> None:
    """Store postings in folders by a hash of the word, each sorted by word and key, so that a lookup reads few row groups.

    The number of folders, BUCKETS or the shuffle partitions if those are more, stands in the metadata of the column word, where
    lookup finds it. Tasks follow the size of the data: rows are rebalanced by folder, small ones share a task and large ones, such
    as that of a word with very many postings, are split.
    """
    buckets = buckets or max(BUCKETS, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = index.withMetadata("word", {BUCKETS_KEY: buckets}).withColumn("bucket", bucket(F.col("word"), buckets))
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "word", key).write.mode(mode).partitionBy("bucket").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def lookup(index: DataFrame, words: list[str]) -> DataFrame:
    """The postings of these words; of a stored index, only their folders and row groups are read.

    The folders are hashes of literals, which the optimizer folds before it prunes. An index with folders that doesn't say how many
    they are is refused.
    """
    words = sorted(set(words))
    rows = index.filter(F.col("word").isin(words))
    if "bucket" in index.columns:
        buckets = index.schema["word"].metadata.get(BUCKETS_KEY)
        if not buckets:
            raise ValueError("the index doesn't say how many folders it has: write it with write_index")
        rows = rows.filter(F.col("bucket").isin([bucket(F.lit(w), buckets) for w in words])) if words else rows
        rows = rows.drop("bucket")
    return rows


def compacted(spark: SparkSession, paths: list[str], path: str, key: str = "doc_id") -> None:
    """Write the stored indexes of paths, oldest first, as one at path: of a document that several have, the last one's postings."""
    parts = [read_index(spark, p).drop("bucket").withColumn("part", F.lit(k)) for k, p in enumerate(paths)]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    last = rows.groupBy(key).agg(F.max("part").alias("part"))
    write_index(rows.join(last, [key, "part"], "left_semi").drop("part"), path, key=key)


def merged(index: DataFrame, more: DataFrame, key: str = "doc_id") -> DataFrame:
    """The index with the postings of more documents; a document that is in both has its new postings only, so that merging the
    same postings twice changes nothing."""
    return index.join(more.select(key).distinct(), key, "left_anti").unionByName(more)


def encoded(index: DataFrame, key: str = "doc_id") -> DataFrame:
    """(word, key, record): postings as fixed-width text: frequency so far 11, id 11, occurrences 7, each position 7, then `*`; fields
    are filled up with U+0000."""

    def field(x: Column, width: int) -> Column:
        return F.rpad(x.cast("string"), width, "\x00")

    rows = running_doc_freq(index, key).join(index, ["word", key])
    positions = F.array_join(F.transform("pos", lambda p: field(p, 7)), "")
    return rows.select("word", key, F.concat(field(F.col("df_so_far"), 11), field(F.col(key), 11), field(F.col("tf"), 7), positions, F.lit("*")).alias("record"))


def decoded(records: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, word, tf, pos) of encoded records."""

    def number(start: int | Column, width: int) -> Column:
        return F.replace(F.substring("record", start, width), F.lit("\x00"), F.lit("")).cast("bigint")

    size = ((F.length("record") - 30) / 7).cast("int")
    pos = F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1), lambda i: number(i * 7 + 30, 7).cast("int"))).otherwise(F.array().cast("array<int>"))
    return records.select(number(12, 11).alias(key), "word", number(23, 7).cast("int").alias("tf"), pos.alias("pos"))
