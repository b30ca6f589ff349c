import datetime as dt
import math
import random

import numpy as np
import pytest

from garimpo.llm.percentiles import Sketch, day_sketches, merge, percentiles

Q = {"p50": 0.5, "p99": 0.99}


def test_exact_while_small_and_bounded_when_large():
    s = Sketch().add(np.array([3.0, 1.0, 2.0]))
    assert s.quantiles([0, 0.5, 1]) == [1.0, 2.0, 3.0] and s.rank_error() == 0
    assert Sketch().quantiles([0.5]) == [None]
    x = np.random.default_rng(1).lognormal(size=300_000)
    parts = [Sketch(256).add(p) for p in np.array_split(x, 60)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.merge(Sketch.from_bytes(p.to_bytes(), 256))
    assert whole.n == len(x) and sum(len(v) << h for h, v in enumerate(whole.levels)) == len(x)
    assert sum(map(len, whole.levels)) < 2000
    for q in (0.01, 0.5, 0.9, 0.99):
        rank = (x <= whole.quantiles([q])[0]).mean()
        assert abs(rank - q) <= whole.rank_error() <= 0.03


def test_tables(spark):
    rng = random.Random(2)
    rows = [(f"s{i}", rng.choice("ab"), rng.choice([None, math.nan, -1.0, 0.0, float(i)]), 1.7e9 + 3600.0 * i, None) for i in range(2000)]
    rows += rows[:300] + [("t", None, 5.0, None, 1), ("u", "c", math.inf, math.nan, 1), ("v", "d", 7.0, math.nan, 1)]
    df = spark.createDataFrame(rows, "id string, name string, ms double, at double, valor int")
    days = day_sketches([(df, "spans", "name", "ms", "at"), (df.limit(0), "none", "name", "ms", "at")])
    got = {r.grupo: r for r in percentiles(merge(days, False), Q).collect()}
    assert set(got) == {"a", "b", None, "d"}
    for g in "ab":
        v = sorted(r[2] for r in set(rows) if r[1] == g and r[2] is not None and r[2] >= 0)
        assert got[g].n == len(v) and sum(x < got[g].p50 for x in v) / len(v) - 0.5 <= got[g].erro and 0.5 - sum(x <= got[g].p50 for x in v) / len(v) <= got[g].erro
    assert got[None].p50 == 5.0 and got["d"].p99 == 7.0
    per_day = percentiles(days, Q).collect()
    assert sum(r.n for r in per_day if r.grupo == "a") == got["a"].n
    assert min(r.dia for r in per_day if r.dia) >= dt.date(2023, 11, 14)
    assert day_sketches([(df.limit(0), "none", "name", "ms", "at")]).count() == 0


@pytest.mark.parametrize("order", [lambda x: x, np.sort, lambda x: np.sort(x)[::-1]])
def test_order_does_not_matter(order):
    x = order(np.random.default_rng(4).normal(size=50_000))
    s = Sketch(512)
    for p in np.array_split(x, 50):
        s.add(p)
    assert abs((x <= s.quantiles([0.9])[0]).mean() - 0.9) <= s.rank_error() < 0.02
