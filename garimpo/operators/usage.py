"""Usage, recall, facts and retention: aggregates over the project's event tables."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ATTRIBUTION_S = 900


def span_totals(spans: DataFrame, since: float) -> DataFrame:
    """One row of telemetry totals since an epoch second."""
    s = spans.where(F.col("started_at") >= since)
    err = F.sum(F.when(F.col("status") == "error", 1).otherwise(0))
    return s.agg(
        F.count("*").alias("total_calls"), F.coalesce(err, F.lit(0)).alias("total_errors"),
        F.coalesce(F.round(err / F.count("*") * 100, 2), F.lit(0.0)).alias("error_rate_pct"),
        F.coalesce(F.round(F.avg(F.when(~F.isnan("duration_ms"), F.col("duration_ms"))), 2), F.lit(0.0)).alias("avg_ms"),
        F.coalesce(F.sum(F.col("tokens_in").cast("long")), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum(F.col("tokens_out").cast("long")), F.lit(0)).alias("tokens_out"),
    )


def span_breakdown(spans: DataFrame, by: str, since: float) -> DataFrame:
    s = spans.where(F.col("started_at") >= since)
    return s.groupBy(by).agg(F.count("*").alias("calls"), F.round(F.avg(F.when(~F.isnan("duration_ms"), F.col("duration_ms"))), 2).alias("avg_ms"), F.sum(F.when(F.col("status") == "error", 1).otherwise(0)).alias("errors"))


def ledger(calls: DataFrame, since: float = 0.0) -> DataFrame:
    """Per tool: calls, errors, exact median and 95th (element int(0.95 n) of the sorted times), totals.

    Ranks come from a window over per-value counts, so repeated times are one row each when they are sorted.
    """
    c = calls.where((F.col("em") >= since) & F.col("segundos").isNotNull() & ~F.isnan("segundos"))
    counts = c.groupBy("ferramenta", "segundos").agg(F.count("*").alias("n"))
    w = Window.partitionBy("ferramenta").orderBy("segundos").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy("ferramenta")))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("segundos")))
    n = F.col("all")
    # rounded as decimals, so halves do not depend on the order of summation
    exact = lambda c, p: F.round(c.cast("decimal(20,6)"), p).cast("double")
    q = counts.groupBy("ferramenta").agg(
        exact((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2, 3).alias("p50"),
        exact(at(F.least(n - 1, F.floor(n * F.lit(0.95).cast("double")))), 3).alias("p95"),
    )
    totals = c.groupBy("ferramenta").agg(F.count("*").alias("chamadas"), F.sum(F.when(F.coalesce("erro", F.lit("")) != "", 1).otherwise(0)).alias("erros"), F.round(F.sum(F.col("segundos").cast("decimal(20,6)")), 1).cast("double").alias("segundos_total"), F.sum(F.col("chars_saida").cast("long")).alias("chars_saida"), F.sum(F.col("chars_apontados").cast("long")).alias("chars_apontados"))
    return totals.join(q, "ferramenta")


def gaps(queries: DataFrame, at_least: int, bad: list[str]) -> DataFrame:
    """Repeated queries that were never answered with confidence."""
    g = queries.where(F.col("hash").isNotNull()).groupBy("hash").agg(F.count("*").alias("vezes"), F.max("melhor").alias("melhor"), F.max("em").alias("ultima"), F.min(F.coalesce("confianca", F.lit("")).isin(bad)).alias("all_bad"))
    return g.where((F.col("vezes") >= at_least) & F.col("all_bad")).drop("all_bad")


def most_recalled(returned: DataFrame, queries: DataFrame, now: float, top: int = 5, min_queries: int = 3, half_life: float = 14.0) -> DataFrame:
    """Notes often returned among the first ``top``: counts, distinct queries and a half-life sum of ages."""
    j = returned.where(F.col("posicao") <= top).join(queries.select(F.col("id").alias("consulta"), "hash", "em"), "consulta")
    age = F.greatest(F.lit(0.0), (F.lit(now) - F.col("em")) / 86400.0)
    g = j.groupBy("caminho").agg(F.count("*").alias("vezes"), F.countDistinct("hash").alias("consultas"), F.round(F.sum(F.pow(F.lit(2.0), -age / half_life)), 4).alias("peso"), F.max("em").alias("ultima"))
    return g.where(F.col("consultas") >= min_queries)


def open_rate(returned: DataFrame, opened: DataFrame) -> DataFrame:
    """Per position: shown, opened and their ratio (null where nothing was shown)."""
    a = returned.groupBy("posicao").agg(F.count("*").alias("mostradas"))
    b = opened.where(F.col("posicao").isNotNull()).groupBy("posicao").agg(F.count("*").alias("abertas"))
    j = a.join(b, "posicao", "full").select("posicao", F.coalesce("mostradas", F.lit(0)).alias("mostradas"), F.coalesce("abertas", F.lit(0)).alias("abertas"))
    return j.withColumn("taxa", F.when(F.col("mostradas") > 0, F.round(F.col("abertas") / F.col("mostradas"), 3)))


def attribute_opens(opened: DataFrame, shown: DataFrame, within: float = ATTRIBUTION_S) -> DataFrame:
    """As-of join: each open ``(oid, caminho, em)`` with the latest showing ``(caminho, em, consulta)`` at most ``within`` before.

    Both sides are cut into windows of ``within`` seconds, so the range join is an equi-join on (path, window) against this
    and the previous window; a path that is shown all the time meets one open with two windows only. Unmatched opens stay, null.
    """
    w = float(within)
    o = opened.withColumn("__w", F.floor(F.col("em") / w)).withColumn("__w", F.explode(F.array(F.col("__w"), F.col("__w") - 1)))
    # of showings at one second only the greatest query can win
    s = shown.groupBy("caminho", F.floor(F.col("em") / w).alias("__w"), F.col("em").alias("__em")).agg(F.max("consulta").alias("__q"))
    hit = o.join(s, ["caminho", "__w"]).where((F.col("__em") <= F.col("em")) & (F.col("em") - F.col("__em") <= w))
    best = hit.groupBy("oid").agg(F.max(F.struct("__em", "__q")).alias("b")).select("oid", F.col("b.__q").alias("consulta_atribuida"))
    return opened.join(best, "oid", "left")


def fact_groups(facts: DataFrame) -> DataFrame:
    """Per stored key pair: how many values, the current one (newest date, then note), whether values differ."""
    f = facts.where(F.col("ks").isNotNull() & F.col("ka").isNotNull())
    return f.groupBy("ks", "ka").agg(F.count("*").alias("n"), F.max(F.struct("data", "nota", "valor")).alias("m"), (F.countDistinct("kv") > 1).alias("diverge")).select("ks", "ka", "n", F.col("m.valor").alias("atual"), "diverge")


def fact_divergences(facts: DataFrame, attributes: list[str]) -> DataFrame:
    """Single-valued attributes with several values in several notes, none of which contains all others."""
    f = facts.where(F.col("ka").isin(attributes) & F.col("ks").isNotNull() & F.col("kv").isNotNull())
    g = f.groupBy("ks", "ka").agg(F.countDistinct("kv").alias("valores"), F.countDistinct("nota").alias("notas"), F.max_by("kv", F.struct(F.length("kv"), F.col("kv"))).alias("longest"), F.collect_set("kv").alias("all"))
    apart = F.exists("all", lambda v: ~F.col("longest").contains(v))
    return g.where((F.col("valores") > 1) & (F.col("notas") > 1) & apart).select("ks", "ka", "valores", "notas")


def retention(age_days: Column, accesses: Column, idle_days: Column, salience: Column | float = 1.0, lamb: float = 0.02, sigma: float = 0.6, mu: float = 0.04, readers: Column | None = None, breadth: float = 0.0) -> Column:
    """``salience e^(-lambda age) + sigma ln(1 + n) e^(-mu idle) breadth``; never accessed: no second term; ages are at least 0."""
    sal = salience if isinstance(salience, Column) else F.lit(float(salience))
    age, idle = F.greatest(age_days, F.lit(0.0)), F.greatest(idle_days, F.lit(0.0))
    wide = F.lit(1.0) if readers is None or not (math.isfinite(breadth) and breadth >= 0) else 1.0 + breadth * F.log1p(F.greatest(readers, F.lit(1)) - 1.0)
    return sal * F.exp(-lamb * age) + F.coalesce(sigma * F.log(1.0 + accesses) * F.exp(-mu * F.when(idle_days.isNotNull(), idle)) * wide, F.lit(0.0))


def retention_plan(score: Column, tier: Column, pinned: Column, expired: Column, compacted: Column, cold: float = 0.20) -> Column:
    return F.when(expired, "expirada").when((tier != "episodic") | pinned | (score >= cold), "manter").when(compacted, "manter").otherwise("compactar")


def salience_after(votes: Column, start: float = 1.0) -> Column:
    """Ordered votes folded into a salience of 0.25 to 2: helpful +0.25, not_helpful -0.25, stale and wrong to the floor."""
    step = lambda s, v: F.least(F.greatest(F.when(v == "helpful", s + 0.25).when(v == "not_helpful", s - 0.25).when(v.isin("stale", "wrong"), F.lit(0.25)).otherwise(s), F.lit(0.25)), F.lit(2.0))
    return F.aggregate(votes, F.lit(start), step)


def duration_hint(runs: DataFrame, by: str, seconds: Column, wide: float = 10.0) -> DataFrame:
    d = runs.select(by, seconds.alias("s")).where(F.col("s").isNotNull() & (F.col("s") >= 0))
    g = d.groupBy(by).agg(F.count("*").alias("n"), F.round(F.min("s"), 3).alias("menor"), F.round(F.median("s"), 3).alias("mediana"), F.round(F.max("s"), 3).alias("maior"))
    return g.withColumn("larga", F.when(F.col("menor") > 0, F.col("maior") / F.col("menor") >= wide).otherwise(F.lit(False)))


def bulletin(sections: dict[str, tuple[DataFrame, str, Column, Column]], since: float) -> DataFrame:
    """``(secao, item, n, problemas)`` since an epoch second; each section gives rows, their time, an item and what is a problem."""
    one = lambda name, df, at, item, bad: df.where(F.col(at) >= since).groupBy(item.cast("string").alias("item")).agg(F.count("*").alias("n"), F.count_if(F.coalesce(bad, F.lit(False))).alias("problemas")).select(F.lit(name).alias("secao"), "item", "n", "problemas")
    return reduce(DataFrame.unionByName, [one(k, *v) for k, v in sections.items()])


def structural_outliers(rows: DataFrame, key: str, meta: str, status: str, rare: float = 0.2, head: float = 0.8) -> DataFrame:
    """``(key, motivo)``: rows with a key of ``meta`` (JSON) that less than ``rare`` of all rows have, or a ``status`` outside the ``head`` of all.

    Counts are of different row keys; the status values, a handful, are ranked by frequency, ties by name, null last.
    """
    d = rows.where(F.col(key).isNotNull())
    k = d.select(key, F.explode(F.map_keys(F.from_json(meta, "map<string,string>"))).alias("k"))
    n = d.where(F.col(meta).isNotNull()).agg(F.countDistinct(key).alias("total"))  # one row
    few = k.groupBy("k").agg(F.countDistinct(key).alias("n")).join(F.broadcast(n)).where(F.col("n") < rare * F.col("total")).select("k")
    v = rows.groupBy(status).agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc("n"), F.asc_nulls_last(status)).rowsBetween(Window.unboundedPreceding, -1)
    c = v.withColumn("antes", F.coalesce(F.sum("n").over(w), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(1))))
    tail = c.where(F.col("antes") >= head * F.col("total")).select(F.col(status).alias("__s"))
    odd = d.join(F.broadcast(tail), F.col(status).eqNullSafe(F.col("__s"))).select(key, F.lit("estado").alias("motivo"))
    return k.join(few, "k").select(key, F.lit("chave").alias("motivo")).unionByName(odd).groupBy(key).agg(F.max("motivo").alias("motivo"))


def history_statistics(versions: DataFrame, path: str, content: str) -> DataFrame:
    """One row: versions, different paths, bytes of their contents."""
    return versions.agg(F.count("*").alias("versoes"), F.countDistinct(path).alias("caminhos"), F.coalesce(F.sum(F.octet_length(F.coalesce(content, F.lit(""))).cast("long")), F.lit(0)).alias("bytes"))


def savings(requests: DataFrame, by: str, before: str, after: str) -> DataFrame:
    """``(by, pedidos, antes, depois, poupado)``: sizes before and after, and the share that was saved; null where nothing came in."""
    a, b = F.sum(F.coalesce(before, F.lit(0)).cast("long")), F.sum(F.coalesce(after, F.lit(0)).cast("long"))
    g = requests.groupBy(F.coalesce(by, F.lit("")).alias(by)).agg(F.count("*").alias("pedidos"), a.alias("antes"), b.alias("depois"))
    return g.withColumn("poupado", F.round(F.when(F.col("antes") > 0, 1 - F.col("depois") / F.col("antes")), 4))


def salience(votes: DataFrame, by: str, at: str, vote: str) -> DataFrame:
    """``(by, saliencia)``: ordered votes folded. A stale or wrong vote sets the floor whatever came before, so only votes from the last of these on are gathered."""
    v = votes.select(by, F.col(at).alias("__at"), F.col(vote).alias("__v"))
    reset = v.where(F.col("__v").isin("stale", "wrong")).groupBy(by).agg(F.max("__at").alias("__from"))
    rest = v.join(reset, by, "left").where(F.col("__from").isNull() | (F.col("__at") >= F.col("__from")))
    return rest.groupBy(by).agg(salience_after(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__v"))), lambda x: x["__v"])).alias("saliencia"))


def breached(rules: dict[str, tuple[DataFrame, float]]) -> DataFrame:
    """``(regra, alvo, valor)``: what is over each rule's limit; a rule gives ``(alvo, valor)``."""
    one = lambda name, df, limit: df.where(F.col("valor") > limit).select(F.lit(name).alias("regra"), F.col("alvo").cast("string").alias("alvo"), F.round("valor", 6).alias("valor"))
    return reduce(DataFrame.unionByName, [one(k, *v) for k, v in rules.items()])


def united(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """The rows of several extractions, of equal keys that of the last one."""
    every = reduce(DataFrame.unionByName, [p.withColumn("__i", F.lit(i)) for i, p in enumerate(parts)])
    rest = [c for c in parts[0].columns if c not in keys]
    return every.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__i").alias("__r")).select(*keys, "__r.*").select(parts[0].columns)
