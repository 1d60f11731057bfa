"""Sizes of texts in tokens of a public tokenizer, counted on the executors."""

from __future__ import annotations

import base64
import os
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the public vocabulary files; a parameter, as the files are never part of this repository.
TOKENIZERS = os.environ.get("PASSAGEKG_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenisation pattern that belongs to the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def encoding(folder: str, name: str):
    import tiktoken

    with open(os.path.join(folder, name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def n_tokens(text: Column, folder: str = TOKENIZERS, name: str = VOCABULARY) -> Column:
    """Number of tokens; 0 for null and empty texts.

    Marked as not deterministic only so that a filter on the count is not pushed below it, which would count twice.
    """

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        encode = encoding(folder, name).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count.asNondeterministic()(text)
