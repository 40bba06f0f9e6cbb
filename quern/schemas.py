"""Schemas of the engine's stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

PAGE_STORE = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("title", T.StringType()), T.StructField("text", T.StringType()),
])
