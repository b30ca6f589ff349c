"""Streams run to their end on folders of rows; readers and writers round-trip."""

import datetime as dt
import glob
import os

from pyspark.sql import functions as F

from garimpo.sources import files
from garimpo.streaming import stateful


def _run(spark, df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def _stream(spark, path, rows, schema):
    for i, r in enumerate(rows):
        spark.createDataFrame(r, schema).coalesce(1).write.mode("append").parquet(f"{path}/{i}")
        for f in glob.glob(f"{path}/{i}/*.parquet"):
            os.utime(f, (1_700_000_000 + 60 * i,) * 2)  # files are taken in the order of their times
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(path))


def test_counts_and_limits(spark, tmp_path):
    s = _stream(spark, tmp_path / "a", [[("p", 1.0), ("p", 2.0), ("q", 1.0)], [("p", 3.0), (None, 9.0)]], "caminho string, em double")
    got = {tuple(r) for r in _run(spark, stateful.access_counts(s), "complete", "counts").collect()}
    assert got == {("p", 3, 3.0), ("q", 1, 1.0)}
    lim = _run(spark, stateful.limiter(s.where("caminho IS NOT NULL"), "caminho", "em", 1, 10.0), "append", "limits")
    assert sum(r.espera > 0 for r in lim.collect()) == 2


def test_alerts(spark, tmp_path):
    rows = [[("k", float(t), on) for t, on in ((0, True), (5, True), (12, True), (20, False), (30, True), (33, False))]]
    s = _stream(spark, tmp_path / "b", rows, "chave string, em double, ativo boolean")
    assert sorted((r.em, r.evento) for r in _run(spark, stateful.alerts(s, 10.0), "append", "alerts").collect()) == [(12.0, "aberto"), (20.0, "resolvido")]


def test_windows_close_once(spark, tmp_path):
    t = lambda m: dt.datetime(2025, 1, 1, 0, m)
    s = _stream(spark, tmp_path / "c", [[(t(1), "a", 1.0), (t(2), "a", 2.0)], [(t(40), "a", 5.0)], [(t(45), "a", 5.0)], [(t(1), "a", 9.0), (t(59), "a", 1.0)]], "ts timestamp, k string, v double")
    got = _run(spark, stateful.windowed(s, "ts", "k", "v", "10 minutes", "5 minutes"), "append", "wins").collect()
    assert (t(0), "a", 2, 3.0) in {tuple(r) for r in got}


def test_change_sink_keeps_the_latest(spark, tmp_path):
    s = _stream(spark, tmp_path / "d", [[(1, 1, "u", "a"), (2, 1, "u", "b"), (5, 9, "D ", None)], [(1, 3, "u", "c"), (2, 0, "u", "old"), (5, 8, "u", "late"), (None, 1, "u", "x")]], "k int, seq int, op string, v string")
    q = stateful.merge_changes(s, str(tmp_path / "out"), "k", "seq", "op", 4).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in stateful.current(spark, str(tmp_path / "out"), "op").select("k", "seq", "v").collect()) == [(1, 3, "c"), (2, 1, "b")]
    assert stateful.current(spark, str(tmp_path / "out")).count() == 3


def test_json_lines_skip_bad_ones(spark, tmp_path):
    p = tmp_path / "l.jsonl"
    p.write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    good, bad = files.json_lines(spark, str(p), "a int")
    assert sorted(r.a for r in good.collect()) == [1, 2]
    assert [r.value for r in bad.collect()] == ["not json"]


def test_csv_and_html(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("a,b\n\n1,x|y\n")
    assert files.csv_markdown(spark, str(p)).first().texto == "| a | b |\n| --- | --- |\n| 1 | x\\|y |"
    df = spark.createDataFrame([("<h1>T</h1><script>no</script><p>a <b>b</b></p><ul><li>c</li></ul>",), (None,), ("",)], "h string")
    assert [r[0] for r in df.select(files.html_text("h")).collect()] == ["# T\na b\n- c", None, ""]


def test_inventory_and_globs(spark, tmp_path):
    for n in ("a.md", "b/c.py", "b/node/d.js", ".env"):
        f = tmp_path / "r" / n
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x")
    got = {r.path.split("/r/")[1]: r.tipo for r in files.inventory(spark, str(tmp_path / "r"), ["node/"]).collect()}
    assert got == {"a.md": "document", "b/c.py": "code"}


def test_export_is_equal(spark, tmp_path):
    df = spark.createDataFrame([(1, "c", "i", "d", "{}", [1.0, 2.0]), (2, "c", "j", None, None, None)], "rid long, col string, id string, doc string, meta string, vec array<float>")
    files.export_collection(df, str(tmp_path / "x"))
    back = spark.read.parquet(str(tmp_path / "x"))
    assert files.verify_copy(df, back).count() == 0
    assert files.verify_copy(df, back.where("rid = 1")).count() == 1


def test_ingest(spark):
    df = spark.createDataFrame([(1, "/a.md", "z" * 4000)], "k int, p string, t string")
    got = files.ingest(df, "k", "p", "t").orderBy("id").collect()
    assert [r.id for r in got] == ["/a.md::chunk_0", "/a.md::chunk_1"]
    assert spark.createDataFrame(got).select(F.get_json_object("meta", "$.total_chunks").alias("t")).distinct().first().t == "2"


def test_versions_are_kept_if_they_changed(spark, tmp_path):
    s = _stream(spark, tmp_path / "v", [[("a", 1.0, "x"), ("a", 2.0, "x"), ("b", 1.0, None)], [("a", 3.0, "x"), ("a", 4.0, "y")], [("a", 6.0, "x"), ("a", 5.0, "y"), ("b", 2.0, "")]], "k string, em double, t string")
    got = _run(spark, stateful.changed_versions(s, "k", "em", "t"), "append", "vers").collect()
    assert sorted((r.k, r.em) for r in got) == [("a", 1.0), ("a", 4.0), ("a", 6.0), ("b", 1.0)]


def test_cache_follows_the_log(spark):
    whole = spark.createDataFrame([(1, "n1"), (2, "b"), (4, "d")], "k int, v string")
    cache = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    log = spark.createDataFrame([(5, 2, "u"), (6, 1, "u"), (7, 3, " D"), (8, 4, "u")], "seq int, k int, op string")
    rows, to, all_ = stateful.refreshed(cache, log, 5, whole, "k")
    assert sorted(map(tuple, rows.collect())) == [(1, "n1"), (2, "b"), (4, "d")] and (to, all_) == (8, False)
    rows, to, all_ = stateful.refreshed(cache, log, 2, whole, "k")
    assert rows is whole and (to, all_) == (8, True)
    assert stateful.refreshed(cache, log, 8, whole, "k")[0] is cache and stateful.refreshed(cache, log.limit(0), 3, whole, "k")[2] is False
