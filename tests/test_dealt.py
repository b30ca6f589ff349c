"""Orphan references, change feeds and wide tables: nulls, blanks, long texts, ties, repeats, empty tables, clashing names."""

import datetime as dt

from pyspark.sql import functions as F

from garimpo.operators.changes import apply_changes, latest_changes, rebuild
from garimpo.operators.orphans import Children, Parents, orphan_references, orphan_report
from garimpo.operators.wide import RunStore, cells_of, columns_of, compact, filled_cells, merge_runs, to_deltas, wide_table
from garimpo.plans import dealt

T0 = dt.datetime(2025, 9, 1)
T1 = dt.datetime(2025, 10, 1)


def _orphans(spark, parents, children):
    p = spark.createDataFrame(parents, "k string, dead boolean, __key string")
    c = spark.createDataFrame(children, "k string, at timestamp, periodo string, __n long")
    return orphan_references([Parents(p, "p", F.col("k"), ~F.coalesce("dead", F.lit(False)))], [Children(c, "c", "p", F.col("k"), F.col("at"))])


def test_orphans(spark):
    long = "x" * 100_000
    children = [("a", T0, "z", 1), ("b", T0, None, 1), ("b", T0, None, 1), ("b", T1, None, 1), (None, T0, None, 1), ("", T0, None, 1), (long, None, None, 1), ("gone", T0, None, 1)]
    got = {tuple(r) for r in _orphans(spark, [("a", None, None), ("a", False, None), ("gone", True, None), (None, None, None)], children).collect()}
    assert got == {("c", "b", "2025-09", 2), ("c", "b", "2025-10", 1), ("c", "", "2025-09", 1), ("c", long, None, 1), ("c", "gone", "2025-09", 1)}


def test_orphans_report_and_empty(spark):
    o = _orphans(spark, [], [("a", T0, None, 1), ("b", T0, None, 1), ("b", T0, None, 1)])
    assert [tuple(r) for r in orphan_report(o).collect()] == [("c", "2025-09", 2, 3)]
    assert _orphans(spark, [], []).count() == 0
    assert _orphans(spark, [("a", None, None)], []).count() == 0


FEED = "seq long, col string, rid long, op string, __rank int, __salt int"


def _feed(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], FEED)


def test_changes(spark):
    rows = [(1, "n", 1, "u"), (2, "n", 1, " D "), (1, "n", 1, "u"), (3, "n", 2, "U "), (3, "n", 2, "u"), (None, "n", 2, "d"), (9, "n", None, "d"), (8, "n", 2, None), (8, "n", 2, ""), (5, "n", 3, "d"), (6, "n", 3, "u"), (4, "n", 4, "d"), (7, None, 5, "u"), (2, "m", 1, "u")]
    want = {("n", 2), ("n", 3), (None, 5), ("m", 1)}
    for order in (rows, rows[::-1], rows * 3):
        got = apply_changes(_feed(spark, order), ["col", "rid"]).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_changes_into_base(spark):
    base = spark.createDataFrame([("n", 1, "x"), ("n", 4, "x"), ("n", 9, None), ("n", 9, "again")], "col string, rid long, op string")
    feed = _feed(spark, [(1, "n", 1, "d"), (2, "n", 2, "u"), (3, "n", 4, "u")])
    assert sorted(tuple(r) for r in apply_changes(feed, ["col", "rid"], base).collect()) == [("n", 2), ("n", 4), ("n", 9)]
    assert apply_changes(_feed(spark, []), ["col", "rid"], base).count() == 3
    assert apply_changes(_feed(spark, []), ["col", "rid"]).count() == 0


def test_contradicting_deliveries_delete(spark):
    assert apply_changes(_feed(spark, [(1, "n", 1, "u"), (1, "n", 1, "d")]), ["col", "rid"]).count() == 0


def test_first_arrival_of_last_change(spark):
    df = spark.createDataFrame([(1, 7, "u", T0), (2, 7, "u", T1), (2, 7, "U", T0)], "seq long, rid long, op string, at timestamp")
    assert [tuple(r) for r in latest_changes(df, ["rid"], arrived="at").collect()] == [(7, 2, "u", T0)]


FACTS = "nota string, data string, sujeito string, atributo string, valor string, entidade int, coluna int"


def _facts(spark, rows):
    return spark.createDataFrame([(*r, 1, 1) for r in rows], FACTS)


def _cells(spark, rows, batch=None):
    d = to_deltas(_facts(spark, rows), "sujeito", "atributo", "valor", ["data", "nota"], batch if batch is not None else F.substring("data", 1, 7))
    return {(r.entidade, r.coluna): r.valor for r in filled_cells(compact(d)).collect()}


def test_wide_cells(spark):
    rows = [
        ("a", None, "Balança-13", "Port", "80"), ("a", "2025-01-01", "balanca_13", "`port`", "porta 0081"), ("b", "2025-01-01", "BALANÇA 13", "port", "82"),
        ("a", "2025-01-02", "x", "port", "1 2"), ("a", "2025-01-01", "x", "port", "7"), ("a", "2025-01-01", "", "port", "7"), ("a", "2025-01-01", None, "port", "7"), ("a", "2025-01-01", "x", "***", "7"),
        ("a", "2025-01-01", "x", "setting:enabled", " NÃO "), ("a", "2025-01-01", "x", "setting:cache", "Sim"), ("a", "2025-01-01", "x", "setting temperature", " 1,3 "), ("a", "2025-01-01", "y", "setting-temperature", "1.234"),
        ("a", "2025-01-01", "x", "setting:workers", "000"), ("a", "2025-01-01", "x", "host", " **`h.example`** "), ("a", "2025-01-01", "x", "url", " ' "), ("a", "2025-01-01", "x", "path", None), ("a", "2025-01-01", "x", "owner", "y" * 50_000),
    ]
    want = {("balanca_13", "port"): "82", ("x", "setting_enabled"): "false", ("x", "setting_cache"): "true", ("x", "setting_temperature"): "1.30", ("x", "setting_workers"): "0", ("x", "host"): "h.example", ("x", "owner"): "y" * 50_000}
    assert _cells(spark, rows) == want
    assert _cells(spark, rows[::-1] * 2, F.col("nota")) == want
    assert _cells(spark, []) == {}


def test_runs_compact_in_any_order(spark):
    a = to_deltas(_facts(spark, [("n", "2025-01-01", "s", "host", "one")]), "sujeito", "atributo", "valor", ["data", "nota"], F.lit(1))
    b = to_deltas(_facts(spark, [("n", "2025-02-01", "s", "host", "two"), ("n", "2025-01-01", "s", "port", "5")]), "sujeito", "atributo", "valor", ["data", "nota"], F.lit(2))
    key = lambda c: sorted((r.entidade, r.coluna, r.valor) for r in cells_of(c).collect())
    assert key(compact(a, b)) == key(compact(b, a, a)) == key(compact(compact(b), a)) == [("s", "host", "two"), ("s", "port", "5")]
    w = wide_table(compact(a, b), ["host", "port", "owner"])
    assert dict(w.dtypes) == {"entidade": "string", "host": "string", "port": "decimal(38,0)", "owner": "string"}
    assert [tuple(r) for r in w.collect()] == [("s", "two", 5, None)]


def test_ties_take_the_greatest_value(spark):
    rows = [("n", "2025-01-01", "s", "host", v) for v in ("a", "c", None, "b")]
    assert _cells(spark, rows) == _cells(spark, rows[::-1]) == {("s", "host"): "c"}


def test_wide_table_holds_every_cell(spark, tmp_path):
    facts = [("s", "port", "x 080"), ("s", "Setting: Retries", "3"), ("s", "command", "`run`"), ("s", "device", " "), ("t", "runtime", "py")]
    spark.createDataFrame([("n", "2025-01-01", *f) for f in facts], "nota string, data string, sujeito string, atributo string, valor string").write.parquet(f"{tmp_path}/fatos.parquet")
    w = {r.entidade: r.asDict() for r in dealt.p5_wide_all(spark, str(tmp_path)).collect()}
    cells = {(e, c, str(v)) for e, r in w.items() for c, v in r.items() if c != "entidade" and v is not None}
    assert cells == {tuple(r) for r in dealt.p5_found(spark, str(tmp_path)).collect()}
    assert w["s"] == {"entidade": "s", "command": "run", "device": None, "port": 80, "runtime": None, "setting_retries": "3"} and w["t"]["runtime"] == "py"
    fixed = {r.entidade: r for r in dealt.p5_wide(spark, str(tmp_path)).collect()}
    assert fixed["s"].port == 80 and fixed["s"].outras == "command=run\nsetting_retries=3" and fixed["t"].outras == "runtime=py"


def test_rebuild_keeps_columns(spark):
    base = spark.createDataFrame([("n", 1, "x", 5), ("n", 4, "y", 6), (None, 9, None, 7), ("n", 9, "z", 8), ("n", 9, "z", 8)], "col string, rid long, op string, seq int")
    feed = _feed(spark, [(1, "n", 1, "d"), (2, "n", 2, "u"), (3, "n", 4, "u"), (1, None, 9, "u"), (4, "n", 7, "d")])
    got = sorted(map(tuple, rebuild(feed, ["col", "rid"], base).collect()), key=repr)
    assert got == sorted([("n", 4, "y", 6, "alterada"), (None, 9, None, 7, "alterada"), ("n", 9, "z", 8, "mantida"), ("n", 9, "z", 8, "mantida"), ("n", 2, None, None, "nova")], key=repr)
    assert rebuild(_feed(spark, []), ["col", "rid"], base).count() == 5 and rebuild(feed, ["col", "rid"], base.limit(0)).count() == 3


def test_runs_written_and_compacted_again(spark, tmp_path):
    months = [[("a", f"2025-{m:02d}-0{k}", f"s{k}", f"c{m % 3}", f"v{m}{k}") for k in range(1, 5)] for m in range(1, 12)]
    store = RunStore(spark, str(tmp_path), fan_in=3)
    for m in [months[i] for i in (4, 1, 9, 0, 2, 3, 10, 5, 8, 6, 7)]:
        store.append(to_deltas(_facts(spark, m), "sujeito", "atributo", "valor", ["data", "nota"], F.lit("x")))
    assert len(store.runs(0)) == 2 and len(store.runs(1)) == 0 and len(store.runs(2)) == 1
    of = lambda c: sorted(map(tuple, filled_cells(c).collect()))
    once = to_deltas(_facts(spark, sum(months, [])), "sujeito", "atributo", "valor", ["data", "nota"], F.lit("x"))
    assert of(store.read()) == of(compact(once)) and len(of(store.read())) == 12
    runs = merge_runs(to_deltas(_facts(spark, sum(months, [])), "sujeito", "atributo", "valor", ["data", "nota"], F.substring("data", 1, 7)), F.substring("lote", 1, 6))
    assert of(compact(runs)) == of(compact(once)) and runs.select("corrida").distinct().count() == 2
    assert columns_of(compact(once)) == ["c0", "c1", "c2"]
