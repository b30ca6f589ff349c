"""Classification, policies, labels, budgets, schedules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from garimpo.operators import notes as N


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_slugs_and_kinds(spark):
    got = one(spark, [("Incorporação  Nórtex!",), ("NORTEX",), ("",), (None,)], "c string", N.client_slug(F.col("c"), {"nortex": "nx"}))
    assert got == [("incorporacao-nortex",), ("nx",), ("",), (None,)]
    rows = [("a/graphs/g/x.md", ""), ("s/2025-transcrição.md", ""), ("s/chat-1.md", ""), ("s/x.md", "session-transcript"), ("s/x.md", None)]
    assert [r[0] for r in one(spark, rows, "p string, c string", N.note_subkind(F.col("p"), F.col("c")))] == ["generated", "transcript", "chat", "transcript", "curated"]
    rows = [("x/.gitignore", ""), ("README.md", ""), ("requirements-dev.txt", ""), ("install-do-cliente-novo.md", ""), ("a.md", "Apache License v2"), (None, None)]
    assert [r[0] for r in one(spark, rows, "p string, c string", N.is_junk(F.col("p"), F.col("c")))] == [True, True, True, False, True, False]
    assert one(spark, [("/r/c/x/y",), ("/r/f",), ("/o/c/x",)], "p string", N.client_from_path(F.col("p"), ["/r"])) == [("c",), (None,), (None,)]


def test_policy_order(spark):
    calls = spark.createDataFrame([("a", "t", "write"), ("a", "u", "write"), ("b", "t", "write"), (None, "v", "read")], "cliente string, ferramenta string, classe string")
    rules = spark.createDataFrame([("a", "write", "block"), ("*", "t", "require_approval"), ("a", "t", "allow")], "cliente string, chave string, acao string")
    got = {(r.cliente, r.ferramenta): r.acao for r in N.effective_policy(calls, rules).collect()}
    assert got == {("a", "t"): "allow", ("a", "u"): "block", ("b", "t"): "require_approval", (None, "v"): "allow"}


def test_paths(spark):
    rows = [("/a", "/a/b"), ("/a", "/ab"), ("/a/", "/a"), ("/", "/x"), (None, "/x")]
    assert [r[0] for r in one(spark, rows, "a string, p string", N.within_path(F.col("a"), F.col("p")))] == [True, False, True, True, True]
    df = spark.createDataFrame([(1, "/a/b/"), (2, None)], "k int, p string")
    assert sorted(r.prefixo for r in N.containing_paths(df, "p", "k").collect()) == ["/", "/a", "/a/b"]


def test_shortest_suffixes(spark):
    df = spark.createDataFrame([(1, "a/x/SKILL.md"), (2, "b/x/SKILL.md"), (3, "b/y/SKILL.md"), (4, "z.md"), (5, "z.md")], "k int, p string")
    got = {r.k: r.rotulo for r in N.shortest_suffixes(df, "k", "p").collect()}
    assert got == {1: "a/x/SKILL.md", 2: "b/x/SKILL.md", 3: "y/SKILL.md", 4: "z.md", 5: "z.md"}


def test_budget(spark):
    rows = [("g", 1, 1, 5, 50), ("g", 2, 1, 5, 20), ("g", 3, 1, 5, 9), ("g", 4, 1, 5, 9), ("h", 1, 9, 99, 999)]
    df = spark.createDataFrame(rows, "g string, o int, a int, b int, c int")
    got = {(r.g, r.o): r.nivel for r in N.budget_levels(df, "g", ["o"], ["a", "b", "c"], 35).collect()}
    assert got == {("g", 1): 2, ("g", 2): 3, ("g", 3): 3, ("g", 4): 1, ("h", 1): 1}


@pytest.mark.parametrize(("spec", "want"), [("* * * * *", 4), ("0 9 * * *", 1), ("*/30 * * * *", 3), ("0 0 13 * 5", 1), ("@hourly", 2), ("0 0 * * 7", 0), ("15 10-12/2 * 6 *", 1)])
def test_cron(spark, spec, want):
    times = [(dt.datetime(2025, 6, 13, 0, 0),), (dt.datetime(2025, 6, 13, 9, 0),), (dt.datetime(2025, 6, 14, 9, 30),), (dt.datetime(2025, 6, 14, 10, 15),)]
    assert spark.createDataFrame(times, "t timestamp").where(N.cron_matches(F.col("t"), spec)).count() == want
    with pytest.raises(ValueError, match="range"):
        N.cron_matches(F.lit(None), "61 * * * *")


def test_sections_and_search(spark):
    df = spark.createDataFrame([(1, "intro\n# A\ntext\n## B\nmore\n### C\nsame"), (2, None), (3, "")], "k int, t string")
    assert [(r.parte, r.titulo, r.corpo) for r in N.sections(df, "k", "t").orderBy("parte").collect()] == [(0, None, "intro"), (1, "A", "text"), (2, "B", "more\n### C\nsame")]
    n = spark.createDataFrame([(1, ["load", "graph"]), (2, ["load"]), (3, [])], "id int, termos array<string>")
    assert [r.id for r in N.node_search(n, ["load", "graph"]).collect()] == [1, 2]
