"""Files: seed lists, directories of texts and pages, the page store, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import schemas


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """(url) of each line of a seed file."""
    return spark.read.text(path).select(F.rtrim("value").alias("url"))


def _named(df: DataFrame, value: str) -> DataFrame:
    name = F.col("_metadata.file_name")
    rows = df.select(F.regexp_extract(name, r"^(\d+)", 1).alias("id"), F.col(value).alias("text"), name.alias("name"))
    return rows.filter(~F.col("name").startswith(".") & (F.col("id") != "")).select(F.col("id").cast("bigint").alias("doc_id"), "text")


def text_directory(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of whole files whose names start with their id; dot files are skipped."""
    return _named(spark.read.text(path, wholetext=True), "value")


def html_directory(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, html) of whole files of bytes, read as UTF-8."""
    rows = spark.read.format("binaryFile").load(path).select("_metadata", F.decode("content", "UTF-8").alias("html"))
    return _named(rows, "html").withColumnsRenamed({"doc_id": "page_id", "text": "html"})


def page_store(pages: DataFrame, text: str = "raw_text") -> DataFrame:
    """(page_id, url, title, text), the title null where a page has none."""
    title = F.when(F.length(F.trim("title")) > 0, F.col("title"))
    return pages.select("page_id", "url", title.alias("title"), F.col(text).alias("text"))


def write_page_store(store: DataFrame, path: str, mode: str = "overwrite") -> None:
    store.select(*schemas.PAGE_STORE.names).write.mode(mode).parquet(path)


def read_page_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PAGE_STORE).parquet(path)


def page_files(store: DataFrame) -> DataFrame:
    """(page_id, text): title and text put together without anything between, as they are indexed."""
    return store.select("page_id", F.concat(F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))).alias("text"))


def write_texts(rows: DataFrame, path: str, ending: str = "") -> None:
    """A file of each row (id, text) under path, named by the id and the ending. Files are put in place when they are whole, so that a
    task that is run again changes nothing; null texts are empty files. path: of the shared folder, as a URI or a local path."""
    where = path if "://" in path else f"file://{path}"

    def write(batches):
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(where)
        store.create_dir(root, recursive=True)
        for pdf in batches:
            for name, text in zip(pdf.iloc[:, 0], pdf.iloc[:, 1]):
                part = f"{root}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(text.encode("utf-8", "replace") if isinstance(text, str) else b"")
                store.move(part, f"{root}/{int(name)}{ending}")
            yield pdf.iloc[:0, :1]

    rows.filter(F.col(rows.columns[0]).isNotNull()).mapInPandas(write, rows.select(rows.columns[0]).schema).write.format("noop").mode("overwrite").save()


def write_visited(urls: DataFrame, path: str, mode: str = "append") -> None:
    """A log of visited urls, a line each."""
    urls.select("url").write.mode(mode).text(path)
