"""Exact token counts and token prefixes by a public vocabulary, in Arrow batches."""

from __future__ import annotations

import base64
from functools import lru_cache
from typing import Any

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Vocabulary of a public byte-pair tokenizer: a base64 token and its rank per line.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the splitting pattern that belongs to it.
SPLITS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def encoding_of(content: bytes) -> Any:
    """Of a vocabulary file's content. Made once per worker."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    return tiktoken.Encoding("public", pat_str=SPLITS, mergeable_ranks=ranks, special_tokens={})


def content(vocabulary: str) -> Broadcast[bytes]:
    """A vocabulary file, about a megabyte, read here and shipped with the job: workers need no file of their own."""
    with open(vocabulary, "rb") as f:
        return SparkSession.active().sparkContext.broadcast(f.read())


def token_count(text: Column | str, vocabulary: str = VOCABULARY) -> Column:
    shared = content(vocabulary)

    @F.pandas_udf("int")
    def count(s: pd.Series) -> pd.Series:
        e = encoding_of(shared.value)
        return s.map(lambda t: len(e.encode_ordinary(t)) if t else 0)

    return count(text)


def first_tokens(text: Column | str, n: int, vocabulary: str = VOCABULARY) -> Column:
    """The text's first n tokens as text; a character cut in half at the end is left out."""
    shared = content(vocabulary)

    @F.pandas_udf("string")
    def cut(s: pd.Series) -> pd.Series:
        e = encoding_of(shared.value)
        return s.map(lambda t: t if not t or len(ids := e.encode_ordinary(t)) <= n else e.decode_bytes(ids[:n]).decode("utf-8", "ignore"))

    return cut(text)
