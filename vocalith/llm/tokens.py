"""Sizes of texts in tokens of a public tokenizer. The vocabulary's path is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The byte-level vocabulary for many languages; VOCALITH_VOCABULARY names another file.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the split pattern that belongs to byte-level vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts are encoded in pieces of at most about so many characters, cut between a word and the blank before the next.
PIECE = 20_000


def vocabulary() -> str:
    return os.environ.get("VOCALITH_VOCABULARY", VOCABULARY)


@cache
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocalith", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str) -> int:
    return sum(len(encoding(path).encode_ordinary(x)) for x in pieces(text or ""))


def pieces(text: str) -> Iterator[str]:
    """A text in pieces whose tokens together are the text's: no token crosses the place between a letter and a blank."""
    at, n = 0, len(text)
    while n - at > PIECE:
        cut = at + PIECE
        while cut < n and not (text[cut] == " " and text[cut - 1].isalnum()):
            cut += 1
        yield text[at:cut]
        at = cut
    if at < n:
        yield text[at:]


def token_count(text: Column | str, path: str | None = None) -> Column:
    """bigint column: tokens of a text; 0 for null and empty texts."""
    path = path or vocabulary()

    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: count_tokens(x, path)).astype("int64")

    return F.pandas_udf(count, T.LongType()).asNondeterministic()(text)


def sized(docs: DataFrame, *keep: str, text: str = "text", path: str | None = None) -> DataFrame:
    """keep + n_tokens, one row a document."""
    return docs.select(*keep, token_count(F.col(text), path).alias("n_tokens"))
