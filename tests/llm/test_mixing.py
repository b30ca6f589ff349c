import random

import pytest

from garimpo.llm.mixing import mix

random.seed(3)


def _text():
    return " ".join(random.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(random.randrange(1000)) for _ in range(random.randrange(5, 40)))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, _text(), random.choice(["a", "A ", " a"]), 1) for i in range(1200)] + [(2000 + i, _text(), "b", 1) for i in range(300)] + [(3000 + i, _text(), "c", 1) for i in range(60)]
    rows += [(4000, None, "a", 1), (4001, "", "b", 1), (4002, _text(), None, 1), (4003, _text(), "other", 1), (4004, rows[0][1], "a", 1), (4005, rows[0][1], "b", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, fonte int")


def _weights(spark, rows):
    return spark.createDataFrame(rows, "source string, peso double, max_rep int")


def test_shares_caps_and_order(spark, docs):
    m, shares = mix(docs, _weights(spark, [("a", 0.5, 1), ("B", 0.3, 2), ("c", 0.15, 3), ("none", 0.05, 2)]), block=64)
    rows = m.collect()
    assert not {r.doc_id for r in rows} & {4000, 4001, 4002, 4003, 4004, 4005}
    assert len({(r.doc_id, r.uso) for r in rows}) == len(rows)
    most = {"a": 1, "b": 2, "c": 3}
    assert all(r.uso < most[r.fonte] for r in rows)
    s = {r.fonte: r for r in shares.collect()}
    assert s["none"].alcancado == 0 and s["none"].alvo == 0
    for k in "abc":
        assert abs(s[k].alcancado - s[k].alvo) < 0.02
        assert s[k].tokens == sum(r.n_tokens for r in rows if r.fonte == k)
    rows.sort(key=lambda r: (r.posicao, r.ordem))
    half = rows[: len(rows) // 2]
    share = sum(r.n_tokens for r in half if r.fonte == "a") / sum(r.n_tokens for r in half)
    assert abs(share - s["a"].alvo) < 0.05


def test_total_and_repeatable(spark, docs):
    w = _weights(spark, [("a", 1.0, 1), ("b", 1.0, 2)])
    m, shares = mix(docs, w, block=64, total=5000)
    assert 4500 < sum(r.tokens for r in shares.collect()) < 5800
    again, _ = mix(docs.repartition(7), w, block=64, total=5000)
    assert sorted(map(tuple, m.collect())) == sorted(map(tuple, again.collect()))


def test_empty(spark, docs):
    for d, w in ((docs.limit(0), [("a", 1.0, 1)]), (docs, []), (docs, [("a", 0.0, 1)]), (docs, [("a", 1.0, 0), (None, 1.0, 1)])):
        m, shares = mix(d, _weights(spark, w))
        assert m.count() == 0 and all(r.alcancado == 0 for r in shares.collect())
