"""Files to texts, inventories and graphs; snapshots, manifests and graphs written and read back."""

import json

import pytest
from pyspark.sql import functions as F

from garimpo.functions import compact as K
from garimpo.operators import queues as Q
from garimpo.sources import extract as X
from garimpo.sources import snapshots as S


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_inventory(spark, tmp_path):
    root = tmp_path / "raiz"
    for name, text in {"a.md": "um dois tres", "b.py": "x = 1", "run": "#!/usr/bin/env python\nprint()", "c.log": "x", "sub/c.csv": "a,b", ".env": "K=1", "big.txt": "w " * 50, "q.bin": "\0"}.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    got = {r.relativo: (r.tipo, r.palavras) for r in X.detect(spark, str(root), [("", "*.log")], limit=60).collect()}
    assert got == {"a.md": ("document", 3), "b.py": ("code", 3), "run": ("code", 3), "sub/c.csv": ("data", None), "big.txt": ("document", None), "q.bin": ("other", None)}


def test_backup_is_verified(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, None, [1.0]), (2, None, [1.0])], "rid long, doc string, vec array<float>")
    f = S.backup(df, str(tmp_path / "b"))
    assert S.verified(spark, f) and rows(S.restored(spark, f)) == rows(df)
    spark.createDataFrame([(3, "x", None)], df.schema).write.mode("append").parquet(f"{f}/rows")
    assert not S.verified(spark, f)
    with pytest.raises(ValueError, match="does not hold"):
        S.restored(spark, f)


def test_manifest(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.txt").write_text("um")
    (tmp_path / "m" / "b.txt").write_text("dois")
    before = S.manifest(spark, str(tmp_path / "m")).collect()
    (tmp_path / "m" / "b.txt").write_text("tres")
    now = S.manifest(spark, str(tmp_path / "m"))
    assert rows(S.manifest_faults(spark.createDataFrame(before), now)) == [("b.txt", "mudou")]


def test_graph_file_and_shrinking(spark, tmp_path):
    g = {"nodes": [{"id": "a", "label": "A"}, {"id": "b"}, {"id": "c"}, {"label": "no id"}], "links": [{"source": "a", "target": "b", "relation": "calls", "weight": 2}, {"source": "a", "target": "gone"}]}
    (tmp_path / "g.json").write_text(json.dumps(g))
    n, e = S.load_graph(spark, str(tmp_path / "g.json"))
    assert rows(n.select("id")) == [("a",), ("b",), ("c",)] and rows(e.select("source", "target", "relation")) == [("a", "b", "calls")]
    S.save_graph(n, e, str(tmp_path / "out"))
    with pytest.raises(ValueError, match="the old one 3"):
        S.save_graph(n.limit(1), e, str(tmp_path / "out"))
    S.save_graph(n.limit(1), e, str(tmp_path / "out"), may_shrink=True)
    assert spark.read.parquet(str(tmp_path / "out/nodes")).count() == 1


def test_folds_are_undone():
    import random

    r = random.Random(2)
    words = ["a", "b", "  1:x", "src/f.py:", "src/f.py:3:y", "... (repeated 2 times)", "... (repeats 3 lines from 4 lines back)", "", "longer line of text here"]
    for _ in range(400):
        text = "\n".join(r.choice(words) for _ in range(r.randrange(1, 40)))
        short, done = K.folded(text)
        assert K.unfolded(short, done) == text and len(short) <= len(text)
    block = "\n".join(f"line {i} of a block" for i in range(6))
    assert len(K.folded("\n".join([block, "x", block, block]))[0]) < 2 * len(block)


def test_schedules_refuse():
    for bad in ("* * * *", "60 * * * *", "*/0 * * * *", "5-1 * * * *", "a * * * *"):
        with pytest.raises(ValueError):
            Q.cron_fields(bad)


def test_graph_of_files_is_empty_for_empty(spark):
    n, e = X.code_graph(spark.createDataFrame([], "path string, texto string"))
    assert n.count() == 0 and e.count() == 0
    assert X.extract(spark.createDataFrame([], "path string, content binary")).count() == 0
    assert X.kept_files(spark.createDataFrame([("a",)], "path string"), []).select(F.count("*")).first()[0] == 1
