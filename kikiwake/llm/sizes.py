"""Sizes of texts in tokens of a public tokenizer. The vocabulary file is a parameter; nothing is trained or copied."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the public split pattern of byte-level BPE vocabularies of this family.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):  # noqa: ANN201
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def n_tokens(text: Column, path: str = VOCABULARY, pattern: str = PATTERN) -> Column:
    """Tokens of the whole text; null and "" have 0."""

    @F.pandas_udf("int")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(path, pattern)
        for s in parts:
            yield s.map(lambda v: len(enc.encode_ordinary(v)) if v else 0).astype("int32")

    return F.coalesce(count(text), F.lit(0))
