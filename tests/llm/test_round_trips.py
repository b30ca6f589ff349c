"""Exact round trips and planted tables against SQL."""

import os

import pytest

from garimpo.llm import queries as Q
from garimpo.llm.split import rejoined, split_texts
from garimpo.llm.tokens import decode_table
from oracle import DATA, compare


@pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_matches_sql(spark, name):
    compare(spark, name, Q.QUERIES[name], Q.ORACLE[name], "sf0.001")


def test_pieces_give_the_text_back(spark):
    rows = [(1, "a", "uma frase. " * 900, 1), (2, None, "x" * 7000, 1), (3, "b", None, 1), (4, "c", "", 1), (5, "d::parte_1", "curto", 1)]
    df = spark.createDataFrame(rows, "rid long, id string, doc string, parte int")
    assert sorted((r.chave, r.texto) for r in rejoined(split_texts(df, "rid", "id", "doc")).collect()) == [(r[0], r[2]) for r in rows]
    assert rejoined(split_texts(df.limit(0), "rid", "id", "doc")).count() == 0


def test_decode(spark):
    df = spark.createDataFrame([(1, [72, 105]), (2, []), (3, None)], "k int, ids array<int>")
    got = {r.k: r.texto for r in decode_table(df, "k").collect()}
    assert len(got[1]) > 0 and got[2] == "" and got[3] is None
