import os

import pytest

from vocalith.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.vocabulary()), reason="no vocabulary file")


def test_pieces_keep_tokens():
    text = ("some words, 12,345 numbers and “quotes” " * 3000).strip()
    whole = tokens.encoding(tokens.vocabulary()).encode_ordinary(text)
    assert tokens.count_tokens(text, tokens.vocabulary()) == len(whole)
    assert "".join(tokens.pieces(text)) == text


def test_column(spark):
    df = spark.createDataFrame([(1, "hello there"), (2, None), (3, ""), (4, "x" * 50_000), (5, "<|endoftext|>")], "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.sized(df, "doc_id").collect()}
    assert got[2] == got[3] == 0 and got[1] >= 2 and got[4] > 0 and got[5] > 1
