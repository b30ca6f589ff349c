import numpy as np

from garimpo.llm.neighbors import neighbors
from garimpo.llm.queries import p1_neighbors

SCHEMA = "col string, rid long, vec array<float>, r int, c int"


def _df(spark, rows):
    return spark.createDataFrame([(c, r, v, 1, 1) for c, r, v in rows], SCHEMA)


def _data(n=3000, d=32):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n // 4, d))
    x = np.concatenate([x, x + 0.25 * rng.normal(size=x.shape), x + 0.35 * rng.normal(size=x.shape), x * rng.uniform(0.1, 9, (len(x), 1)) + 0.3 * rng.normal(size=x.shape)]).astype(np.float32)
    return x, (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float64)


def test_recall_against_brute_force(spark):
    x, u = _data()
    got = neighbors(_df(spark, [("a", i, v.tolist()) for i, v in enumerate(x)]), "col", "rid", "vec", k=5, depth=24, probes=20, rerank=10).collect()
    mine = {}
    for r in got:
        mine.setdefault(r.r, set()).add(r.vizinho)
        assert abs(r.cos - u[r.r] @ u[r.vizinho]) < 1e-5
    s = u @ u.T
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, axis=1)[:, :5]
    assert np.mean([len(mine[i] & set(top[i].tolist())) / 5 for i in range(len(x))]) >= 0.9
    near = neighbors(_df(spark, [("a", i, v.tolist()) for i, v in enumerate(x)]), "col", "rid", "vec", k=5, least=0.9).collect()
    want = {(i, int(j)) for i in range(len(x)) for j in top[i] if s[i, j] >= 0.9}
    assert len({(r.r, r.vizinho) for r in near} & want) >= 0.98 * len(want) and all(r.cos >= 0.9 for r in near)


def test_unusable_vectors_and_collections(spark):
    nan, one = float("nan"), [1.0, 0.0, 0.0]
    rows = [("a", 1, one), ("a", 2, [1.0, 0.1, 0.0]), ("a", 3, [0.0, 0.0, 0.0]), ("a", 4, [nan, 1.0, 0.0]), ("a", 5, [1.0, 0.0]), ("a", 6, None), ("a", 7, []), ("a", 8, [1.0, None, 0.0]), ("b", 9, one), (None, 10, one), ("a", None, one), ("a", 11, [float("inf"), 0.0, 0.0])]
    got = {(r.r, r.vizinho) for r in neighbors(_df(spark, rows), "col", "rid", "vec").collect()}
    assert got == {(1, 2), (2, 1)}
    assert neighbors(_df(spark, []), "col", "rid", "vec").count() == 0


def test_copies(spark):
    rows = [("a", i, [1.0, 2.0]) for i in range(50)] + [("a", 99, [1.0, 2.1]), ("a", 98, [-1.0, 0.5])]
    got = neighbors(_df(spark, rows), "col", "rid", "vec", k=5).collect()
    of = lambda r: [x.vizinho for x in sorted((x for x in got if x.r == r), key=lambda x: x.ordem)]
    assert of(0) == [1, 2, 3, 4, 5] and of(2) == [0, 1, 3, 4, 5] and of(40) == [0, 1, 2, 3, 4] and of(99) == [0, 1, 2, 3, 4]
    assert len(got) == 5 * 52


def _recall(found, u):
    own = np.arange(0, len(u), 100)
    s = u[own] @ u.T
    s[np.arange(len(own)), own] = -2
    mine = {}
    for r in found.where(f"{found.columns[0]} % 100 = 0").collect():
        mine.setdefault(r[0], set()).add(r[1])
    return np.mean([len(mine[int(i)] & set(t.tolist())) / 5 for i, t in zip(own, np.argsort(-s, axis=1)[:, :5])])


def test_query_recall_with_many_cells(spark, tmp_path):
    x = np.random.default_rng(8).normal(size=(24_000, 32)).astype(np.float32)
    _df(spark, [("a", i, v.tolist()) for i, v in enumerate(x)]).write.parquet(f"{tmp_path}/chunks.parquet")
    assert _recall(p1_neighbors(spark, str(tmp_path)), x / np.linalg.norm(x, axis=1, keepdims=True)) >= 0.9


def test_cells_looked_into_grow(spark):
    rng, n, d = np.random.default_rng(8), 24_000, 32
    x = (2 * rng.normal(size=(40, d))[rng.integers(0, 40, n)] * rng.uniform(0, 1, (n, 1)) + rng.normal(size=(n, d))).astype(np.float32)
    df = _df(spark, [("a", i, v.tolist()) for i, v in enumerate(x)])
    # 169 cells; 8 of them give 0.86
    assert _recall(neighbors(df, "col", "rid", "vec", k=5, rerank=None, cell=150, probes=None), x / np.linalg.norm(x, axis=1, keepdims=True)) >= 0.88
