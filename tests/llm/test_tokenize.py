"""Encoding against two public libraries, round trips, edge rows."""

import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auditloom.llm import tokenize
from tests.conftest import rows

PATH = f"{tokenize.TOKENIZERS}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")


@pytest.fixture(scope="module")
def tools():
    import tiktoken

    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tokenize.Vocabulary(PATH), tiktoken.Encoding("own", pat_str=tokenize.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("ab \n'", max_size=80), st.lists(st.sampled_from(["the", " cat", "'s", "  ", "1234", "é", "<|endoftext|>", "\t", "日本"]), max_size=12).map("".join)))
def test_against_a_library(tools, text):
    vocabulary, other = tools
    assert tokenize.encode_texts(vocabulary, [text], {}) == [other.encode_ordinary(text) if text else []]


def test_long_pieces(tools):
    vocabulary, other = tools
    for text in ("a" * 5000, "ab" * 3000, "x" * 2047, "y" * 2049, "é" * 4000, "".join(chr(97 + i * i % 26) for i in range(9000))):
        assert tokenize.encode_texts(vocabulary, [text], {}) == [other.encode_ordinary(text)]


def test_rows(spark, tools):
    df = spark.createDataFrame([(1, "Hello, world"), (2, None), (3, ""), (1, "Hello, world"), (4, "<|endoftext|>")], "doc_id long, text string").selectExpr("*", "'x' as ids", "7 as batch")
    found = tokenize.encode(df)
    assert rows(found.select("doc_id", "ids")) == sorted([(1, [15496, 11, 995]), (1, [15496, 11, 995]), (2, []), (3, []), (4, tools[1].encode_ordinary("<|endoftext|>"))], key=str)
    assert "batch" in found.columns and tokenize.encode(df.limit(0)).count() == 0
