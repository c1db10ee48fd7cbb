"""Byte-level BPE: ids of texts by a vocabulary of ranks, and back."""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Split patterns of two public byte-level vocabularies. The second cuts numbers into digits, keeps a mark with the word after it and line ends apart.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DIGITWISE = r"""(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"""


def load(path: str, special: dict[str, int] | None = None, pattern: str = PATTERN):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special or {})


def encode(df: DataFrame, text: str, path: str, out: str = "ids", pattern: str = PATTERN, composed: bool = False) -> DataFrame:
    """Adds the token ids of a text column; null stays null. Special tokens in a text count as ordinary text. composed: texts are brought to NFC first."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = load(path, pattern=pattern)
        for s in batches:
            yield s.map(lambda x: None if x is None else vocabulary.encode_ordinary(unicodedata.normalize("NFC", x) if composed else x))

    return df.withColumn(out, ids(text))


def decode(df: DataFrame, ids: str, path: str, out: str = "text") -> DataFrame:
    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = load(path)
        for s in batches:
            yield s.map(lambda x: None if x is None else vocabulary.decode([int(i) for i in x]))

    return df.withColumn(out, text(ids))


def with_special(tokens: list[str], size: int, names: dict[str, str], known: dict[str, int] | None = None) -> tuple[dict[str, int], dict[str, int]]:
    """Ids of the special tokens that a vocabulary of this size does not have yet, after its last id; and the ids by role (names: role -> token). known: special tokens that it has, which keep their ids."""
    known, ids = known or {}, {}
    for token in tokens:
        if token not in known:
            ids.setdefault(token, size + len(ids))
    return ids, {role: (known | ids)[token] for role, token in names.items()}
