"""Sizes of texts in tokens of a public tokenizer, read from a vocabulary file whose folder is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folder of the public tokenizers' files, the same on every executor.
FOLDER, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"

# Fixed value: the public pattern by which this vocabulary's texts are split before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of the whole text as bigint; 0 for null and empty texts. Batches go to Python over Arrow."""
    path = f"{folder}/{vocabulary}"

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        encode = encoding(path).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)
