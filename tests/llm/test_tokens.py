import base64

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from garimpo.llm import tokens


@pytest.fixture(scope="module")
def both():
    raw, births = tokens.vocabulary_of(tokens.vocabulary_path())
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tokens.encoder_of(raw, births, tokens.PATTERN), tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(enc, text):
    return np.frombuffer(enc.encode(text), np.int32).tolist()


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="thein g'sé12\n\t  \x85\x1c_-", max_size=80))
def test_same_as_merging(both, text):
    text = text.encode("utf-8", "replace").decode()
    assert ids(both[0], text) == both[1].encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 5000, "é" * 3000, " " * 3000, "ab" * 4000, "<|endoftext|>", "don't  stop\n\n", "👩‍💻", "x" * 300 + " " + "y" * 300, "\x00\x01"])
def test_long_and_odd(both, text):
    assert ids(both[0], text) == both[1].encode_ordinary(text)


def test_every_white_space_is_one(both):
    import regex

    assert {chr(c) for c in range(0x3001) if regex.match(r"\s", chr(c))} == tokens.WHITE


def test_table(spark):
    df = spark.createDataFrame([(1, "hello world", 1), (2, None, 2), (3, "", 3), (1, "hello world", 1), (4, " ", 4)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id, r.ids) for r in tokens.encode_table(df, "doc_id", "text").collect())
    assert got == [(1, [31373, 995]), (1, [31373, 995]), (2, []), (3, []), (4, [220])]
    n = {r.doc_id: r.n_tokens for r in tokens.encode_table(df, "doc_id", "text", ids=False).collect()}
    assert n == {1: 2, 2: 0, 3: 0, 4: 1}
    assert tokens.encode_table(df.limit(0), "doc_id", "text").count() == 0
