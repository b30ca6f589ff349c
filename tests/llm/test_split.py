import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from garimpo.llm.split import cuts, oversized, split_texts

TEXTS = st.text(alphabet="ab é.\n\t  ", max_size=400) | st.text(alphabet="abcd ", max_size=400)


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(3, 30), st.integers(0, 2))
def test_pieces(text, limit, overlap):
    c = cuts(text, limit, overlap)
    assert c[0][0] == 0 and c[-1][1] == len(text)
    assert all(b - a <= limit for a, b, _ in c)
    for (_, b, _), (a2, b2, _) in zip(c, c[1:]):
        assert a2 <= b < b2 and b - a2 <= overlap
    longest = max(map(len, re.split("[ \t\r\n]", text)))
    assert any(k == "forcado" for *_, k in c) == (longest > limit)


def test_cut_at_the_change_of_topic():
    one, two = "The cat sat on the mat with another cat. " * 12, "Stock prices fell as bond markets rose again. " * 12
    (_, end, _), *_ = cuts(one + two, len(one) + 200, 20)
    assert end == len(one)


def test_full_overlap_where_it_fits():
    text = "Uma frase curta. " * 1000
    c = cuts(text)
    assert all(b - a2 == 200 for (_, b, _), (a2, _, _) in zip(c, c[1:]))


def test_table(spark):
    rows = [(1, "i", "x" * 4000, 1), (2, None, "word " * 1000, 2), (3, "k", "y" * 3072, 3), (4, "l", "", 4), (5, "m", None, 5), (6, "n", ("z" * 3072 + " ") * 2, 6), (6, "n", ("z" * 3072 + " ") * 2, 6), (7, "big", "w " * 400_000, 7)]
    df = spark.createDataFrame(rows, "rid long, id string, doc string, parte int")
    p = split_texts(df, "rid", "id", "doc")
    assert {(r.chave, r.corte) for r in oversized(p).collect()} == {(1, "forcado"), (2, "natural"), (6, "natural"), (7, "natural")}
    got = p.where("chave in (2, 3, 4, 5)").collect()
    assert {r.parte_id for r in got if r.chave == 2} == {"2::parte_0", "2::parte_1"}
    assert [(r.parte_id, r.texto) for r in sorted(got, key=lambda r: r.chave) if r.chave > 2] == [("k", "y" * 3072), ("l", ""), ("m", None)]
    assert split_texts(df.limit(0), "rid", "id", "doc").count() == 0
    with pytest.raises(ValueError, match="overlap"):
        split_texts(df, "rid", "id", "doc", 10, 10)
