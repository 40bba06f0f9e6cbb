"""Filling containers of fixed capacity with texts (problem 8).

Sum-of-squares packing: with N(g) open containers having the gap g, each item goes where the sum of N(g)^2 over the gaps
becomes smallest, a new container being one of the choices; ties go to the smallest gap. Texts are dealt by hash into shards
of about SHARD items, and each (kind, shard) is packed on its own, longest items first, so the work is in proportion to the
rows and no task's group grows with the table; what a shard leaves open at its end is a few containers of thousands.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.tokens import FOLDER, VOCABULARY, token_count
from quern.sources.tables import spread

#: Items of one shard, about.
SHARD = 16384
#: More kinds than this are refused, as every text is packed into containers of each.
MAX_KINDS = 1000
SCHEMA = "kind string, container_id bigint, doc_id bigint, piece_no int, tokens bigint"


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container number of each item; every size must be in 1 .. capacity. Best given in descending order."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # open containers by gap; a full one is no longer open
    open_at: dict[int, list[int]] = {}
    placed = np.empty(len(sizes), dtype=np.int64)
    never = np.iinfo(np.int64).max
    bins = 0
    for i, s in enumerate(sizes.tolist()):
        gap, best = capacity, (2 * int(count[capacity - s]) + 1 if s < capacity else 0)
        if s < capacity:
            here, then = count[s:capacity], count[: capacity - s]
            change = np.where(here > 0, 2 * (then - here) + 2, never)
            if here[0] > 0:
                change[0] = 1 - 2 * here[0]
            at = int(change.argmin())
            if change[at] <= best:
                gap = s + at
        if gap == capacity:
            b, bins = bins, bins + 1
        else:
            b = open_at[gap].pop()
            count[gap] -= 1
        if gap > s:
            open_at.setdefault(gap - s, []).append(b)
            count[gap - s] += 1
        placed[i] = b
    return placed


def _pack_shard(rows: pd.DataFrame) -> pd.DataFrame:
    kind, shard, capacity = rows["kind"].iloc[0], int(rows["shard"].iloc[0]), int(rows["capacity"].iloc[0])
    tokens = rows["tokens"].to_numpy(dtype=np.int64)
    pieces = np.maximum(1, -(-tokens // capacity))
    item = np.repeat(np.arange(len(rows)), pieces)
    piece = np.arange(len(item)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    size = np.minimum(capacity, tokens[item] - piece * capacity)
    order = np.lexsort((piece, item, -size))
    order = order[size[order] > 0]
    container = np.full(len(item), -1, dtype=np.int64)
    container[order] = pack(size[order], capacity)
    ids = pd.Series(container + (shard << 32), dtype="Int64").mask(container < 0)
    return pd.DataFrame({"kind": kind, "container_id": ids, "doc_id": rows["doc_id"].to_numpy()[item], "piece_no": piece.astype("int32"), "tokens": size})


def containers(documents: DataFrame, kinds: DataFrame, folder: str = FOLDER, vocabulary: str = VOCABULARY, shard: int = SHARD) -> DataFrame:
    """(kind, container_id, doc_id, piece_no, tokens): for each kind, where every text went.

    A text larger than the capacity is cut into full pieces and a rest, others are piece 0 alone. Null and empty texts take no
    room: they come with 0 tokens and a null container_id. Every row counts as a text of its own, repeated doc_ids too. Kinds
    with a null or non-positive capacity are left out, a repeated kind is one; an empty table gives no rows; further columns
    don't matter.
    """
    n = documents.agg(F.count(F.lit(1)).alias("n")).scalar()
    sizes = spread(documents.select("doc_id", "text")).select("doc_id", token_count(F.col("text"), folder, vocabulary).alias("tokens"))
    sizes = sizes.withColumn("shard", F.pmod(F.xxhash64("doc_id", "tokens"), F.greatest(F.ceil(n / F.lit(shard)), F.lit(1))))
    some = kinds.filter("capacity_tokens > 0 and kind is not null").groupBy("kind").agg(F.max("capacity_tokens").alias("capacity"))
    listed = some.orderBy("kind").limit(MAX_KINDS + 1).collect()
    if len(listed) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds")
    choices = [F.struct(F.lit(r.kind).alias("kind"), F.lit(r.capacity).alias("capacity")) for r in listed]
    if not choices:
        return documents.sparkSession.createDataFrame([], SCHEMA)
    rows = sizes.select("doc_id", "tokens", "shard", F.explode(F.array(*choices)).alias("k")).select("doc_id", "tokens", "shard", "k.kind", "k.capacity")
    return rows.groupBy("kind", "shard").applyInPandas(_pack_shard, SCHEMA)


def faults(packed: DataFrame, documents: DataFrame, kinds: DataFrame) -> DataFrame:
    """(kind, documents, missing, over_full, split): the rows of each kind's texts, how many texts have none, how many containers
    hold more than they can, and how many texts are in pieces though they fit: all 0 but the first when packing is right."""
    some = kinds.filter("capacity_tokens > 0 and kind is not null").groupBy("kind").agg(F.max("capacity_tokens").alias("capacity"))
    texts = packed.groupBy("kind", "doc_id").agg(F.sum(F.when(F.col("piece_no") == 0, 1).otherwise(0)).alias("n"), F.max("piece_no").alias("last"), F.sum("tokens").alias("t"))
    texts = texts.join(some, "kind").groupBy("kind").agg(F.sum("n").alias("documents"), F.sum(F.when((F.col("last") > 0) & (F.col("t") <= F.col("capacity")), 1).otherwise(0)).alias("split"))
    over = packed.filter("container_id is not null").groupBy("kind", "container_id").agg(F.sum("tokens").alias("t")).join(some, "kind")
    over = over.groupBy("kind").agg(F.sum(F.when(F.col("t") > F.col("capacity"), 1).otherwise(0)).alias("over_full"))
    n = documents.agg(F.count(F.lit(1)).alias("n")).scalar()
    rows = some.select("kind").join(texts, "kind", "left").join(over, "kind", "left")
    zero = F.lit(0).cast("bigint")
    return rows.select("kind", F.coalesce("documents", zero).alias("documents"), (n - F.coalesce("documents", zero)).alias("missing"), F.coalesce("over_full", zero).alias("over_full"), F.coalesce("split", zero).alias("split"))


def fill(packed: DataFrame, kinds: DataFrame) -> DataFrame:
    """(kind, containers, tokens, capacity_tokens, fill): how full the containers of each kind are."""
    by = packed.filter("container_id is not null").groupBy("kind", "container_id").agg(F.sum("tokens").alias("t"))
    by = by.groupBy("kind").agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"))
    some = kinds.filter("capacity_tokens > 0 and kind is not null").groupBy("kind").agg(F.max("capacity_tokens").alias("capacity_tokens"))
    return by.join(some, "kind").withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))
