"""Token counts by a public byte-pair vocabulary, beside the word counts of ``text.approx_tokens``."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import approx_tokens

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str):
    """The encoder of a vocabulary file, once a worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    try:
        from public_tokenizers import PATTERN as pattern
    except ImportError:
        pattern = PATTERN
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def bpe_tokens(text: Column, vocabulary: str = VOCABULARY, approximate: bool = True) -> Column:
    """Tokens of a text; zero for null.

    Without the vocabulary's file the words are counted instead, if
    ``approximate`` allows it.  Signs that are no Unicode count as replaced.
    """
    if not os.path.exists(vocabulary):
        if not approximate:
            raise FileNotFoundError(vocabulary)
        return approx_tokens(text)

    @F.pandas_udf("long")
    def count(t: pd.Series) -> pd.Series:
        e = encoding(vocabulary)
        return pd.Series([len(e.encode_ordinary(x.encode("utf-8", "replace").decode("utf-8"))) if isinstance(x, str) else 0 for x in t], dtype="int64")

    return count(text)
