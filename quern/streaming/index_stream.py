"""Keeping an index up to date from a stream of documents.

Each micro-batch writes its postings into a folder of its own, named by the batch, with mode overwrite: a batch that is run again
after a failure leaves the same files. A reader takes of each document the postings of the last batch that had it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quern.operators.index import postings
from quern.operators.tokens import bigram_hits
from quern.sources.tables import cut


def index_stream(spark: SparkSession, source: str, schema: StructType, index: str, checkpoint: str, files_per_batch: int = 1000, key: str = "doc_id", text: str = "text") -> StreamingQuery:
    """Index the Parquet files that are in source, and those that come, until nothing is left; returns the started query."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream = stream.select(key, text, F.col("_metadata.file_modification_time").alias("came"), F.col("_metadata.file_path").alias("file"))

    def write(batch: DataFrame, number: int) -> None:
        # of a document that comes twice in one batch, the later file's text counts (of one file's, the greatest)
        docs = batch.filter(F.col(key).isNotNull())
        once = cut(docs.groupBy(key).agg(F.max_by(text, F.struct("came", "file", text)).alias(text)))  # read twice
        postings(bigram_hits(once, key, text), key).write.mode("overwrite").parquet(f"{index}/batch={number}")
        once.select(key).write.mode("overwrite").parquet(f"{index}-documents/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_stream_index(spark: SparkSession, index: str, key: str = "doc_id") -> DataFrame:
    """The postings of each document's last batch. Documents without words take away their older postings too."""
    last = spark.read.parquet(f"{index}-documents").groupBy(key).agg(F.max("batch").alias("batch"))
    return spark.read.parquet(index).join(last, [key, "batch"], "left_semi").drop("batch")
