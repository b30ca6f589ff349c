"""Label resolution: an unbiased estimate, the law of banding, survivors and remapped edges."""

import itertools

import numpy as np

from garimpo.operators import resolution as E


def test_estimate_is_unbiased():
    err = []
    for seed in range(20):
        shared, own = [f"{seed}s{i}" for i in range(60)], lambda s: [f"{seed}{s}{i}" for i in range(20)]  # noqa: B023
        a, b = E.min_hashes([shared + own("a"), shared + own("b")])
        err.append((a == b).mean() - 0.6)
    assert abs(np.mean(err)) < 0.03


def test_order_of_a_set_does_not_matter():
    a, b, c = E.min_hashes([["x", "y", "z"], ["z", "x", "y"], []])
    assert (a == b).all() and (c == 0xFFFFFFFF).all()


def test_survivors(spark):
    rows = [("n10", "Balanca de lote 13g"), ("n2", "balanca de LOTE 13g"), ("n3", "balanca de lote 13gg"), ("n4", "farol auxiliar 131"), ("n5", "aaaaaa"), ("n6", None), (None, "farol auxiliar 131"), ("n7", "")]
    for order in itertools.islice(itertools.permutations(rows), 0, None, 9000):
        got = {r.id: r.sobrevivente for r in E.resolve(spark.createDataFrame(list(order), "id string, label string"), "id", "label").collect()}
        assert got == {"n10": "n2", "n2": "n2", "n3": "n2"}


def test_edges_follow(spark):
    s = spark.createDataFrame([("b", "a"), ("a", "a")], "id string, sobrevivente string")
    e = spark.createDataFrame([("a", "b", "r"), ("b", "c", "r"), ("a", "c", "r"), ("c", "c", "r"), (None, "c", "r")], "source string, target string, relation string")
    assert sorted(tuple(r) for r in E.remap_edges(e, s, "id").select("source", "target", "relation").collect()) == [("a", "c", "r"), ("c", "c", "r")]
    assert E.resolve(spark.createDataFrame([], "id string, label string"), "id", "label").count() == 0


def test_exact_candidates_lose_nothing(spark):
    import random

    from garimpo.operators.entities import jaro_winkler_of

    r = random.Random(4)
    base = ["".join(r.choice("abcdeioprst 01") for _ in range(r.randrange(4, 18))).strip() for _ in range(60)]
    edit = lambda t: t[: (i := r.randrange(len(t)))] + r.choice(["", "x", t[i] * 2]) + t[i + 1 :]
    labels = sorted({" ".join(x.split()) for b in base for x in (b, edit(b), edit(edit(b)), b[1:], "z" + b) if len(x.strip()) > 1})
    got = {(x.a, x.b) for x in E.similar_labels(spark.createDataFrame([(t,) for t in labels] + [(None,)], "l string"), "l", 0.9, 0.0, exact=True).collect()}
    want = {(a, b) for a in labels for b in labels if a < b and jaro_winkler_of(a, b) >= 0.9}
    assert got == want and len(want) > 100
    few = {(x.a, x.b) for x in E.similar_labels(spark.createDataFrame([(t,) for t in labels], "l string"), "l", 0.9, 0.0).collect()}
    assert few <= want and few


def test_exact_pairs_of_many_labels_write_no_keys(spark):
    import random

    from garimpo.operators.entities import jaro_winkler_of

    r = random.Random(6)
    words = ["cache", "índice", "fila", "ponte", "norte", "索引", "x"]
    labels = sorted({" ".join([*r.choices(words, k=r.randrange(1, 4)), "".join(r.choices("abc19", k=3))]) for _ in range(900)} | {"a" * 70, "a" * 69 + "b"})
    for t in (0.6, 0.75, 0.87, 0.92):
        got = [p for x in E.close_pairs(labels[:120], labels[120:240], t) for p in zip(*x)] + [p for x in E.close_pairs(labels[:120], None, t) for p in zip(*x)]
        want = {(a, b) if a < b else (b, a) for i, a in enumerate(labels[:120]) for b in labels[i + 1 : 240] if jaro_winkler_of(a, b) >= t}
        assert len(got) == len(set(got)) and set(got) == want and want
    rows = spark.createDataFrame([(x,) for x in labels], "l string")
    pairs = E.label_pairs(rows, "l", 0.9, 0.0, exact=True)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and {tuple(p) for p in pairs.collect()} == {(a, b) for i, a in enumerate(labels) for b in labels[i + 1 :] if jaro_winkler_of(a, b) >= 0.9}


def test_resolving_writes_labels_and_pairs_only(spark, monkeypatch):
    from garimpo.operators.entities import jaro_winkler_of

    labels = [f"{a} {b} {i:02d}" for a in ("ponte", "cofre", "norte") for b in ("de busca", "noturno") for i in range(20)]
    written, cut = [], E.checkpoint
    group = {x: x for x in labels}
    for a, b in itertools.combinations(labels, 2):
        if jaro_winkler_of(a, b) >= 0.92 and group[a] != group[b]:
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group |= {x: new for x in labels if group[x] == old}

    def counted(df, *a):
        out = cut(df, *a)
        written.append(out.count())
        return out

    monkeypatch.setattr(E, "checkpoint", counted)
    got = E.resolve(spark.createDataFrame([(f"n{i:03d}", x) for i, x in enumerate(labels)], "id string, label string"), "id", "label", exact=True).collect()
    ids = {x: f"n{i:03d}" for i, x in enumerate(labels)}
    assert {r.id: r.sobrevivente for r in got} == {ids[x]: min(ids[y] for y in labels if group[y] == group[x]) for x in labels}
    assert max(written) <= len(labels) * 20


def test_resolving_takes_only_pairs_that_connect(spark, monkeypatch):
    from garimpo.operators.entities import jaro_winkler_of

    labels = [f"{a} de busca {i:03d}" for a in ("ponte", "cofre") for i in range(150)] + ["norte", "índice fino"]
    group = {x: x for x in labels}
    for a, b in itertools.combinations(labels, 2):
        if jaro_winkler_of(a, b) >= 0.92 and group[a] != group[b]:
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group |= {x: new for x in labels if group[x] == old}
    ids, taken, join = {x: f"n{i:03d}" for i, x in enumerate(labels)}, [], E.components
    want = {(ids[x], min(ids[y] for y in labels if group[y] == group[x])) for x in labels if list(group.values()).count(group[x]) > 1}

    def counted(edges):
        taken.append(edges.count())
        return join(edges)

    monkeypatch.setattr(E, "components", counted)
    nodes = spark.createDataFrame([(ids[x], x) for x in labels], "id string, label string")
    assert {tuple(r) for r in E.resolve(nodes, "id", "label", exact=True).collect()} == want and len(want) == 300
    assert taken[0] <= 10 * len(labels)  # ten cells; all similar pairs are over 20,000
    # what a task forgets gives more pairs and loses none
    for held in (10**6, 1):
        monkeypatch.setattr(E, "HELD", held)
        forest, root = E.Forest(), {x: x for x in labels}
        for x, y in ((labels[:90], None), (labels[90:], None), (labels[:90], labels[90:])):
            for a, b in (p for part in E.close_pairs(x, y, 0.92, forest) for p in zip(*part)):
                assert jaro_winkler_of(a, b) >= 0.92
                root = {k: root[a] if v == root[b] else v for k, v in root.items()}
        assert len(set(root.values())) == len(set(group.values()))


def test_components_never_broadcast_edges(spark, monkeypatch):
    from garimpo.operators import components as C

    plans, cut = [], C.checkpoint
    monkeypatch.setattr(C, "checkpoint", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    got = C.components(spark.createDataFrame([(3, 2), (2, 1), (9, 8)], "src int, dst int")).collect()
    assert {tuple(r) for r in got} == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)}
    assert plans and not any("Broadcast" in p for p in plans)
