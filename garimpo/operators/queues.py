"""Queues, schedules, locks, caches and what readers have seen: state kept as tables and moved by joins and windows."""

from __future__ import annotations

import datetime as dt
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garimpo.operators.ranking import global_rank
from garimpo.runtime import checkpoint

#: Named schedules, and the years a next time is looked for in.
SHORT = {"@hourly": "0 * * * *", "@daily": "0 0 * * *", "@weekly": "0 0 * * 0", "@monthly": "0 0 1 * *", "@yearly": "0 0 1 1 *"}
YEARS = 5
_RANGES = [(0, 59), (0, 23), (1, 31), (1, 12), (0, 7)]


@lru_cache(maxsize=4096)
def cron_fields(spec: str) -> tuple[frozenset, ...]:
    """Allowed values of the five fields, and whether both day fields are set; raises ValueError for what is no schedule."""
    parts = SHORT.get(spec.strip(), spec).split()
    if len(parts) != 5:
        raise ValueError(f"five fields are needed: {spec}")
    out = []
    for text, (low, high) in zip(parts, _RANGES):
        got: set[int] = set()
        for item in text.split(","):
            body, _, step = item.partition("/")
            a, _, b = body.partition("-")
            first, last = (low, high) if body == "*" else (int(a), int(b or (high if step else a)))
            if not (low <= first <= last <= high) or (step and int(step) < 1):
                raise ValueError(f"{item} is out of range in {spec}")
            got |= set(range(first, last + 1, int(step or 1)))
        out.append(frozenset(got))
    out[4] = frozenset(x % 7 for x in out[4])
    return (*out, frozenset({parts[2] != "*" and parts[4] != "*"}))


def next_fire(spec: str, after: dt.datetime) -> dt.datetime | None:
    """The first minute after ``after`` in which the schedule fires; null if there is none in five years."""
    minutes, hours, days, months, week, both = cron_fields(spec)
    start = after.replace(second=0, microsecond=0) + dt.timedelta(minutes=1)
    day, last = start.date(), start.date() + dt.timedelta(days=366 * YEARS)
    while day <= last:
        w, m = (day.weekday() + 1) % 7 in week, day.day in days
        if day.month in months and ((w or m) if True in both else (w and m)):
            for h in sorted(hours):
                for mi in sorted(minutes):
                    if (at := dt.datetime(day.year, day.month, day.day, h, mi)) >= start:
                        return at
        day += dt.timedelta(days=1)
    return None


@F.pandas_udf(T.TimestampNTZType())
def cron_next(after: pd.Series, spec: pd.Series) -> pd.Series:
    """The next time of each schedule after a time; null for null, or for what is no schedule."""

    def one(a: object, s: str | None) -> dt.datetime | None:
        try:
            return None if pd.isna(a) or s is None else next_fire(s, pd.Timestamp(a).to_pydatetime())
        except ValueError:
            return None

    return pd.Series([one(a, s) for a, s in zip(after, spec)], dtype="datetime64[us]")


def schedule_step(tasks: DataFrame, state: DataFrame, now: str) -> DataFrame:
    """``(nome, devida, ancora, proxima)`` after a look at ``now``: tasks ``(nome, cron, ligada)``, state ``(nome, ancora, rodando)``.

    A task seen for the first time is anchored only. Tasks that run or are off are not due. A due task's anchor moves when it is run, not here.
    """
    at = F.lit(now).cast("timestamp_ntz")
    j = tasks.join(state, "nome", "left")
    anchor = F.coalesce(F.col("ancora").cast("timestamp_ntz"), F.when(F.col("ligada"), at))
    j = j.withColumn("__a", anchor).withColumn("proxima", F.when(F.col("ligada"), cron_next(F.col("__a"), F.col("cron"))))
    due = F.col("ligada") & F.col("ancora").isNotNull() & ~F.coalesce("rodando", F.lit(False)) & (F.col("proxima") <= at)
    return j.select("nome", F.coalesce(due, F.lit(False)).alias("devida"), F.col("__a").alias("ancora"), "proxima")


def claim_order(tasks: DataFrame) -> DataFrame:
    """Queued tasks ``(id, prioridade, criada, estado)`` with ``vez``: greatest priority first, then the oldest, then the id."""
    return global_rank(tasks.where("estado = 'queued'"), [F.desc_nulls_last("prioridade"), F.asc("criada"), F.asc("id")], "vez")


def next_runnable(tasks: DataFrame, by: str, now: float) -> DataFrame:
    """``(by, id)``: the oldest runnable task of each queue; scheduled ones are runnable once due."""
    ready = tasks.where((F.col("estado") == "queued") | ((F.col("estado") == "scheduled") & F.coalesce(F.col("depois") <= now, F.lit(False))))
    return ready.groupBy(by).agg(F.min(F.struct("criada", "id")).alias("m")).select(by, F.col("m.id").alias("id"))


def open_questions(q: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """Open questions with ``vez``: by severity, unknown ones last, then age, then id."""
    level = F.lit(len(ranks))
    for k, v in ranks.items():
        level = F.when(F.lower("gravidade") == k, v).otherwise(level)
    return global_rank(q.where("estado = 'aberta'").withColumn("__l", level), [F.asc("__l"), F.asc("criada"), F.asc("id")], "vez").drop("__l")


def locked(asks: DataFrame, most: int = 4, ttl: float = 300.0) -> DataFrame:
    """``(grupo, em, agente, acao, concedido)``: locks asked for and given back, in order; at most ``most`` at a time in a group, one per agent, each until ``ttl``.

    ``asks``: (grupo, em, agente, acao) with acao ``pede`` or ``solta``. A state machine: rows stream by group and time, the locks held are the state.
    """
    src = asks.select("grupo", "em", "agente", "acao").repartition("grupo").sortWithinPartitions("grupo", "em", "agente", "acao")
    kind = src.schema["grupo"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = object(), {}
        for b in batches:
            out = []
            for g, at, who, what in zip(*[c.to_pylist() for c in b.columns]):
                if g != group:
                    group, held = g, {}
                held = {k: v for k, v in held.items() if at - v <= ttl}
                if what == "solta":
                    out.append(held.pop(who, None) is not None)
                else:
                    out.append(who not in held and len(held) < most)
                    if out[-1]:
                        held[who] = at
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.bool_())], [*b.schema.names, "concedido"])

    return src.mapInArrow(run, f"grupo {kind}, em double, agente string, acao string, concedido boolean")


def within_budget(steps: DataFrame, by: str, order: str, most: int = 25) -> DataFrame:
    """``steps`` with ``volta`` and ``dentro``: which round of its session a step is, and whether the session may go on."""
    return steps.withColumn("volta", F.row_number().over(Window.partitionBy(by).orderBy(order))).withColumn("dentro", F.col("volta") <= most)


def cached_results(calls: DataFrame, by: list[str], at: str, ttl: float) -> DataFrame:
    """``calls`` with ``do_cache``: whether a result of the same call was at hand, made at most ``ttl`` before and not renewed by being used.

    Greedy along time, so rows of a call stream in order and one time is held.
    """
    src = calls.where(F.col(at).isNotNull()).repartition(*by).sortWithinPartitions(*by, at)
    keys, place = [src.columns.index(c) for c in by], src.columns.index(at)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema) + ", do_cache boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, made = object(), None
        for b in batches:
            out = []
            for *key, now in zip(*[b.column(k).to_pylist() for k in keys], b.column(place).to_pylist()):
                if key != last:
                    last, made = key, None
                hit = made is not None and now - made <= ttl
                made = made if hit else now
                out.append(hit)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.bool_())], [*b.schema.names, "do_cache"])

    return src.mapInArrow(run, schema)


def consumed_approvals(events: DataFrame, ttl: float) -> DataFrame:
    """``events`` (cliente, ferramenta, args, em, acao) with ``resultado``: acao ``aprova`` or ``usa``; an approval is good for one use within ``ttl``.

    A use finds the oldest approval that has not run out. Arguments are told apart by their hash.
    """
    src = events.select("cliente", "ferramenta", F.sha2(F.coalesce("args", F.lit("")), 256).alias("h"), "em", "acao").repartition("cliente", "ferramenta", "h").sortWithinPartitions("cliente", "ferramenta", "h", "em", "acao")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, open_ = object(), deque()
        for b in batches:
            out = []
            for *key, now, what in zip(*[c.to_pylist() for c in b.columns]):
                if key != last:
                    last, open_ = key, deque()
                while open_ and now - open_[0] > ttl:
                    open_.popleft()
                if what == "aprova":
                    open_.append(now)
                    out.append("aprovado")
                else:
                    out.append("usado" if open_ else "pendente")
                    if open_:
                        open_.popleft()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, "resultado"])

    return src.mapInArrow(run, "cliente string, ferramenta string, h string, em double, acao string, resultado string")


def unseen(items: DataFrame, seen: DataFrame, readers: DataFrame) -> DataFrame:
    """``(leitor, id)``: items that a reader has not seen; ``readers`` (leitor) is a small stated set, ``seen`` (leitor, id)."""
    return items.select("id").distinct().join(F.broadcast(readers.select("leitor").distinct()), F.lit(True)).join(seen.select("leitor", "id"), ["leitor", "id"], "left_anti").select("leitor", "id")


def card_delta(before: DataFrame, now: DataFrame) -> DataFrame:
    """``(cartao, mudou, novos, sumiram)`` of the results ``(cartao, caminho, mtime)`` a reader saw and those of now.

    A card changed if its paths or their times, in whole seconds, did; its lists come from one grouping of both sides. A card never seen
    before has no news.
    """
    a = before.select("cartao", "caminho", F.round("mtime").alias("a"), F.lit(None).cast("double").alias("b"))
    b = now.select("cartao", "caminho", F.lit(None).cast("double").alias("a"), F.round("mtime").alias("b"))
    p = a.unionByName(b).groupBy("cartao", "caminho").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    g = p.groupBy("cartao").agg(F.max(~F.col("a").eqNullSafe(F.col("b"))).alias("mudou"), F.count_if(F.col("a").isNull()).alias("n"), F.count_if(F.col("b").isNull()).alias("s"), F.count("a").alias("antes"))
    return g.select("cartao", "mudou", F.when(F.col("antes") > 0, F.col("n")).otherwise(0).alias("novos"), F.col("s").alias("sumiram"))


def filing_plan(wanted: DataFrame, before: DataFrame) -> DataFrame:
    """``(caminho, acao)``: escrever what is new or has another hash, manter, apagar what is not wanted any more; both sides ``(caminho, marca)``."""
    side = lambda d, c: d.groupBy("caminho").agg(F.max("marca").alias(c))
    j = side(wanted, "w").withColumn("q", F.lit(1)).join(side(before, "b").withColumn("p", F.lit(1)), "caminho", "full")
    return j.select("caminho", F.when(F.col("q").isNull(), "apagar").when(F.col("p").isNotNull() & F.col("w").eqNullSafe(F.col("b")), "manter").otherwise("escrever").alias("acao"))


def guarded_edits(notes: DataFrame, edits: DataFrame) -> DataFrame:
    """``(caminho, pos, estado)``: edits ``(caminho, pos, base, novo)`` are applied if their base is the mark of the note ``(caminho, texto)`` as it is then.

    The first that fits a note's text is aplicada and changes the mark; others are velha, or sem nota. Of edits in a chain each may fit the one before, so
    the chain is followed along equal marks, a round a link.
    """
    e = checkpoint(edits.select("caminho", "pos", "base", F.sha2("novo", 256).alias("nova")))
    state = checkpoint(notes.select("caminho", F.sha2("texto", 256).alias("marca"), F.lit(-1).cast("long").alias("ate")))
    known = state.select("caminho")
    done = e.select("caminho", "pos").limit(0)
    while True:
        fit = e.join(state, (e["caminho"] == state["caminho"]) & (e["base"] == state["marca"]) & (e["pos"] > state["ate"])).groupBy(e["caminho"]).agg(F.min(F.struct(e["pos"], e["nova"])).alias("m"))
        fit = checkpoint(fit.select("caminho", F.col("m.pos").cast("long").alias("pos"), F.col("m.nova").alias("marca")))
        if fit.isEmpty():
            break
        done = checkpoint(done.unionByName(fit.select("caminho", F.col("pos").cast(e.schema["pos"].dataType).alias("pos"))))
        state = checkpoint(fit.select("caminho", "marca", F.col("pos").alias("ate")))
    j = e.join(done.withColumn("ok", F.lit(True)), ["caminho", "pos"], "left").join(known.withColumn("ha", F.lit(True)), "caminho", "left")
    return j.select("caminho", "pos", F.when(F.col("ok"), "aplicada").when(F.col("ha"), "velha").otherwise("sem nota").alias("estado"))


def distinct_in_order(c: Column) -> Column:
    """A list's different values, each at its first place, blanks around them and empty ones apart."""
    return F.array_distinct(F.filter(F.transform(c, lambda x: F.btrim(x)), lambda x: F.coalesce(x != "", F.lit(False))))


def following_versions(versions: DataFrame, renames: DataFrame, most: int = 64) -> DataFrame:
    """``versions`` with ``caminho`` as the note is called now; renames ``(de, para)`` may follow each other, circles raise."""
    v = versions.withColumn("__now", F.col("caminho"))
    r = checkpoint(renames.select("de", "para").where("de <> para").groupBy("de").agg(F.max("para").alias("para")))
    for _ in range(most):
        step = r.select(F.col("de").alias("__now"), F.col("para").alias("__next"))
        v = checkpoint(v.join(step, "__now", "left").withColumn("__moved", F.col("__next").isNotNull()).withColumn("__now", F.coalesce("__next", "__now")).drop("__next"))
        if v.where("__moved").isEmpty():
            return v.withColumn("caminho", F.col("__now")).select(versions.columns)
        v = v.drop("__moved")
    raise RuntimeError("renames go in a circle")
