"""Sizes of texts in tokens of a public tokenizer, whose files stay where they are."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folder of the public tokenizers' files.
TOKENIZER_DIR = os.environ.get("UTTERMILL_TOKENIZERS", "/opt/tokenizers")
TOKENIZER_FILE = "byte_bpe_50k.tiktoken"
#: The published pre-token pattern of this byte-level vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The tokenizer of a ranks file, read once per worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, folder: str = TOKENIZER_DIR, file: str = TOKENIZER_FILE, pattern: str = PATTERN) -> Column:
    """Number of tokens of the whole text; 0 for null and empty texts."""
    path = os.path.join(folder, file)

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(path, pattern).encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)
