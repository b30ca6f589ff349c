"""Arrays of JSON objects: profiles of their fields, identifiers and scores, the way to shorten them, and tables that say the same in less.

Items: (grp, pos, item) with the item as JSON text. All steps are groupings and windows over entries; an array is never gathered, and
values of an item that is no object, or a key that is missing, count as null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garimpo.operators.dedup import mark_leaders
from garimpo.operators.entities import simhash
from garimpo.operators.sequences import change_points
from garimpo.runtime import checkpoint

#: Deviations that make an anomaly, values of a change window, items worth an analysis, values looked at for identifiers and scores.
SIGMAS, WINDOW, LEAST_ITEMS, ID_SAMPLE, SCORE_SAMPLE = 2.0, 5, 5, 20, 50
#: Most columns of all tables together whose heads are broadcast.
HEADS = 100_000
#: Share of rows under which a key is rare.
RARE_KEY = 0.2
#: Words of an item that reports an error.
ERROR_WORDS = ["error", "exception", "failed", "failure", "critical", "fatal", "crash", "panic", "abort", "timeout", "denied", "rejected"]


def entries(items: DataFrame) -> DataFrame:
    """``(grp, pos, chave, tipo, valor, numero)`` of all keys of all objects; ``valor`` is JSON text, texts as they are, JSON null is null."""
    v = items.select("grp", "pos", F.explode(F.from_json("item", "map<string,variant>")).alias("chave", "v"))
    kind = F.schema_of_variant("v")
    name = F.when(kind == "BOOLEAN", "boolean").when(kind == "STRING", "string").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").when(kind == "VOID", None).otherwise("numeric")
    return v.select("grp", "pos", "chave", name.alias("tipo"), _text(F.col("v")).alias("valor"), F.when(name == "numeric", F.try_variant_get("v", "$", "double")).alias("numero"))


def _text(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    return F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind == "VOID", None).otherwise(F.to_json(v))


def objects(items: DataFrame) -> DataFrame:
    """Items that are objects."""
    return items.where(F.schema_of_variant(F.try_parse_json("item")).startswith("OBJECT"))


def field_profile(items: DataFrame, e: DataFrame | None = None) -> DataFrame:
    """Per array and key: ``tipo`` of the first value, ``n`` objects, ``unicos`` values (null is one), ``razao``, ``constante``, ``menor``, ``maior``,
    ``media``, ``variancia`` of numbers, ``tamanho`` (mean length) and ``frequentes`` (five most frequent) of texts."""
    e = entries(items) if e is None else e
    total = objects(items).groupBy("grp").agg(F.count("*").alias("n"))
    x = F.col("numero")
    g = e.groupBy("grp", "chave").agg(
        F.min_by("tipo", F.when(F.col("tipo").isNotNull(), F.col("pos"))).alias("tipo"), F.countDistinct("tipo", "valor").alias("d"), F.count("valor").alias("com"),
        F.min_by("valor", F.when(F.col("tipo").isNotNull(), F.col("pos"))).alias("primeiro"), F.min(x).alias("menor"), F.max(x).alias("maior"), F.avg(x).alias("media"), F.var_samp(x).alias("var"), F.count(x).alias("nums"),
        F.avg(F.when(F.col("tipo") == "string", F.length("valor"))).alias("tam"),
    )
    counts = e.where("tipo = 'string'").groupBy("grp", "chave", "valor").agg(F.count("*").alias("c"), F.min("pos").alias("p"))
    top = counts.withColumn("k", F.row_number().over(Window.partitionBy("grp", "chave").orderBy(F.desc("c"), "p"))).where("k <= 5")
    top = top.groupBy("grp", "chave").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "valor", "c"))), lambda t: F.struct(t["valor"].alias("valor"), t["c"].alias("n"))).alias("frequentes"))
    j = g.join(total, "grp").join(top, ["grp", "chave"], "left")
    unique = F.col("d") + F.when(F.col("n") > F.col("com"), 1).otherwise(0)
    kind = F.coalesce("tipo", F.lit("null"))
    number, word = kind == "numeric", kind == "string"
    none = kind == "null"
    unique = F.when(none, 0).otherwise(unique)
    return j.select(
        "grp", "chave", kind.alias("tipo"), "n", unique.cast("long").alias("unicos"), F.when(none, 0.0).otherwise(unique / F.col("n")).alias("razao"), (none | (unique == 1)).alias("constante"), F.when(unique == 1, F.col("primeiro")).alias("valor_constante"),
        *[F.when(number, F.col(c)).alias(c) for c in ("menor", "maior", "media")], F.when(number & (F.col("nums") > 0), F.coalesce("var", F.lit(0.0))).alias("variancia"), F.when(word, F.col("tam")).alias("tamanho"), F.when(word, F.col("frequentes")).alias("frequentes"),
    )


def _sample(e: DataFrame, most: int) -> DataFrame:
    """The first values of each key by position, as lists of at most ``most``."""
    w = Window.partitionBy("grp", "chave").orderBy("pos")
    first = e.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    return first.groupBy("grp", "chave").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tipo", "valor", "numero"))), lambda t: t).alias("s"))


def _entropy(c: Column) -> Column:
    """Shannon entropy of a text's characters over what it could be; 0 for under two characters."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    n = F.size(chars)
    kinds = F.array_distinct(chars)
    bits = -F.aggregate(kinds, F.lit(0.0), lambda s, k: s + (F.size(F.filter(chars, lambda x: x == k)) / n) * F.log2(F.size(F.filter(chars, lambda x: x == k)) / n))
    most = F.log2(F.least(F.size(kinds), n).cast("double"))
    return F.when((n >= 2) & (most > 0), bits / most).otherwise(F.lit(0.0))


def sequences(e: DataFrame) -> DataFrame:
    """``(grp, chave, sobe, desce, ordenada)`` of numbers in order: shares of steps not down and not up, and whether they are numbered: at least five,
    steps of the sorted values 0.5 to 2 in the mean and in over four fifths, over seven tenths of the steps up."""
    n = e.where("numero IS NOT NULL")
    w, s = Window.partitionBy("grp", "chave").orderBy("pos"), Window.partitionBy("grp", "chave").orderBy("numero")
    step = n.withColumn("p", F.lag("numero").over(w)).withColumn("d", F.col("numero") - F.lag("numero").over(s))
    g = step.groupBy("grp", "chave").agg(F.count("*").alias("k"), F.avg((F.col("numero") >= F.col("p")).cast("double")).alias("sobe"), F.avg((F.col("numero") <= F.col("p")).cast("double")).alias("desce"), F.avg("d").alias("m"), F.avg(F.col("d").between(0.5, 2.0).cast("double")).alias("b"))
    return g.select("grp", "chave", "k", "sobe", "desce", ((F.col("k") >= 5) & F.col("m").between(0.5, 2.0) & (F.col("b") > 0.8) & (F.col("sobe") > 0.7)).alias("ordenada"))


#: Fixed value: the form of a UUID.
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def field_roles(items: DataFrame, e: DataFrame, profile: DataFrame) -> DataFrame:
    """``profile`` with ``id_conf`` and ``score_conf``: how surely a field is an identifier and a score, 0 if it is not."""
    s = _sample(e, ID_SAMPLE)
    words = F.filter("s", lambda t: t["tipo"] == "string")
    uuids = F.size(F.filter(words, lambda t: t["valor"].rlike(UUID))) / F.size(words)
    odd = F.aggregate(words, F.lit(0.0), lambda a, t: a + _entropy(t["valor"])) / F.size(words)
    fractions = F.filter("s", lambda t: t["numero"].isNotNull())
    parts = F.size(F.filter(fractions, lambda t: t["numero"] != F.floor(t["numero"]))) > 0.3 * F.size(fractions)
    looks = s.select("grp", "chave", F.when(F.size(words) > 0, uuids).alias("uuids"), F.when(F.size(words) > 0, odd).alias("odd"), parts.alias("parts"))
    first = e.withColumn("k", F.row_number().over(Window.partitionBy("grp", "chave").orderBy("pos"))).where(F.col("k") <= SCORE_SAMPLE)
    seq_all, seq_first = sequences(e), sequences(first).select("grp", "chave", F.col("ordenada").alias("ordenada50"))
    j = profile.join(looks, ["grp", "chave"], "left").join(seq_all, ["grp", "chave"], "left").join(seq_first, ["grp", "chave"], "left")
    u, number, word = F.col("razao"), F.col("tipo") == "numeric", F.col("tipo") == "string"
    id_ = F.when(u < 0.9, 0.0).when(word & (F.col("uuids") > 0.8), 0.95).when(word & (F.col("odd") > 0.7) & (u > 0.95), 0.8)
    id_ = id_.when(number & F.coalesce("ordenada", F.lit(False)) & (u > 0.95), 0.9).when(number & (F.col("maior") > F.col("menor")) & (u > 0.95), 0.85).when(u > 0.98, 0.7).otherwise(0.0)
    a, b = F.col("menor"), F.col("maior")
    score = F.when((a >= 0) & (b <= 1), 0.4).when((a >= 0) & (b <= 10), 0.3).when((a >= 0) & (b <= 100), 0.25).when((a >= -1) & (b <= 1), 0.35)
    score = score + F.when((F.col("k") >= 5) & (F.col("desce") > 0.7), 0.3).otherwise(0.0) + F.when(F.coalesce("parts", F.lit(False)), 0.1).otherwise(0.0)
    score = F.when(number & score.isNotNull() & ~F.coalesce("ordenada50", F.lit(False)) & (score >= 0.4 - 1e-9), F.least(F.round(score, 6), F.lit(0.95))).otherwise(0.0)
    return j.select(*profile.columns, id_.alias("id_conf"), score.alias("score_conf"))


def anomalies(e: DataFrame, profile: DataFrame) -> DataFrame:
    """``(grp, pos)`` of items with a number over two deviations from its field's mean."""
    s = profile.where("variancia > 0").select("grp", "chave", "media", F.sqrt("variancia").alias("sd"))
    return e.where("numero IS NOT NULL").join(s, ["grp", "chave"]).where(F.abs(F.col("numero") - F.col("media")) > SIGMAS * F.col("sd")).select("grp", "pos").distinct()


def rare_shapes(items: DataFrame, e: DataFrame) -> DataFrame:
    """``(grp, pos)`` of items with a key that under a fifth of the objects have; arrays of under five items have none."""
    n = objects(items).groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_ITEMS)
    rare = e.groupBy("grp", "chave").agg(F.count("*").alias("c")).join(n, "grp").where(F.col("c") < RARE_KEY * F.col("n")).select("grp", "chave")
    return e.join(rare, ["grp", "chave"], "left_semi").select("grp", "pos").distinct()


def error_items(items: DataFrame) -> DataFrame:
    """``(grp, pos)`` of items whose text holds a word of an error."""
    return items.where(F.lower("item").rlike("|".join(ERROR_WORDS))).select("grp", "pos").distinct()


def shifts(e: DataFrame) -> DataFrame:
    """``(grp, chave, pos)`` where the mean of a number field changes."""
    c = change_points(e.where("numero IS NOT NULL"), ["grp", "chave"], [F.col("pos")], "numero", WINDOW)
    return c.select("grp", "chave", "pos")


def strategies(items: DataFrame) -> DataFrame:
    """``(grp, n, padrao, motivo, estrategia)``: whether and how an array can be shortened.

    Patterns: time_series (a time field and a number that varies), logs (a long text that varies and one of few values), search_results (a score).
    Arrays of unique things without a signal, or of middling uniqueness without one, are left as they are.
    """
    e = checkpoint(entries(items))
    profile = checkpoint(field_profile(items, e))
    roles = checkpoint(field_roles(items, e, profile))
    n = objects(items).groupBy("grp").agg(F.count("*").alias("n"))
    head = _sample(e, 10)
    times = F.filter("s", lambda t: (t["tipo"] == "string") & t["valor"].rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?.*)?$"))
    words = F.filter("s", lambda t: t["tipo"] == "string")
    dated = head.select("grp", "chave", F.coalesce((F.size(words) > 0) & (F.size(times) / F.size(words) > 0.5), F.lit(False)).alias("data"))
    f = roles.join(dated, ["grp", "chave"], "left").join(shifts(e).select("grp", "chave").distinct().withColumn("muda", F.lit(True)), ["grp", "chave"], "left")
    number, word = F.col("tipo") == "numeric", F.col("tipo") == "string"
    epoch = number & (F.col("menor").between(1e9, 2e9) | F.col("menor").between(1e12, 2e12))
    best = F.max(F.struct("id_conf", F.when(F.col("id_conf") > 0, F.col("chave")).alias("c"), "razao"))
    g = f.groupBy("grp").agg(
        F.max((word & F.col("data")) | epoch).alias("tempo"), F.max(number & (F.col("variancia") > 0)).alias("varia"), F.max(word & (F.col("razao") > 0.5) & (F.col("tamanho") > 20)).alias("msg"), F.max(word & (F.col("razao") < 0.1) & F.col("unicos").between(2, 10)).alias("nivel"),
        F.max(F.col("score_conf") >= 0.5).alias("busca"), F.max(F.col("score_conf") > 0).alias("nota"), F.max(F.coalesce("muda", F.lit(False))).alias("muda"), best.alias("id"), F.max(F.when(F.lower("chave").contains("message"), F.col("razao"))).alias("mensagem"),
    )
    own = f.join(g.select("grp", F.when(F.col("id.id_conf") > 0, F.col("id.c")).alias("idc")), "grp").where(~F.coalesce(F.col("chave") == F.col("idc"), F.lit(False)))
    means = own.groupBy("grp").agg(F.coalesce(F.avg(F.when(word, F.col("razao"))), F.lit(0.0)).alias("ms"), F.coalesce(F.avg(F.when(number, F.col("razao"))), F.lit(0.0)).alias("mn"))
    count = lambda df, c: df.groupBy("grp").agg(F.count("*").alias(c))
    j = n.join(g, "grp").join(means, "grp", "left").join(count(anomalies(e, profile), "anom"), "grp", "left").join(count(rare_shapes(items, e), "forma"), "grp", "left").join(count(error_items(items), "erros"), "grp", "left").fillna(0)
    has_id = F.col("id.id_conf") >= 0.7
    most = F.greatest("ms", F.when(F.col("id.id_conf") > 0, F.col("id.razao")).otherwise(0.0))
    signal = F.col("nota") | (F.col("anom") > 0) | (F.col("forma") > 0) | (F.col("erros") > 0) | F.col("muda")
    why = F.when((F.greatest("ms", "mn") < 0.1) & has_id, "repetido").when(most < 0.3, "pouco unico").when(has_id & (most > 0.8) & ~signal, "entidades sem sinal").when((most > 0.8) & signal, "entidades com sinal").when(~signal, "medio sem sinal").otherwise("medio com sinal")
    pattern = F.when(F.col("tempo") & F.col("varia"), "time_series").when(F.col("msg") & F.col("nivel"), "logs").when(F.col("busca"), "search_results").otherwise("generic")
    way = F.when(F.col("n") < LEAST_ITEMS, "none").when(why.isin("entidades sem sinal", "medio sem sinal"), "skip").when((pattern == "time_series") & F.col("muda"), "time_series").when((pattern == "logs") & (F.col("mensagem") < 0.5), "cluster_sample").when(pattern == "search_results", "top_n").otherwise("smart_sample")
    return j.select("grp", "n", pattern.alias("padrao"), why.alias("motivo"), way.alias("estrategia"))


def adaptive_sizes(items: DataFrame, text: str = "item", bias: float = 1.0, least: int = 3, most: int | None = None) -> DataFrame:
    """``(grp, n, unicos, joelho, k)``: how many items of an array say enough.

    Arrays of up to eight stay whole. ``unicos`` are leaders among the items' marks at three bits; ``joelho`` is where the curve of different word
    pairs is furthest above its chord. The first k items must compress about as well as all of them, else a fifth more is taken. The curve is
    a running sum over first sights of pairs, and the compressors read the items as they stream by, so no array is held.
    """
    d = items.select("grp", "pos", F.col(text).alias("t"))
    size = d.groupBy("grp").agg(F.count("*").alias("n"))
    lead = mark_leaders(d.select("grp", "pos", simhash("t").alias("m")), ["grp"], "pos", "m", 3).groupBy("grp").agg(F.count_if("lider").alias("unicos"))
    words = F.filter(F.split(F.lower("t"), r"\s+"), lambda w: w != "")
    pairs = F.when(F.size(words) >= 2, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws("\0", F.element_at(words, i), F.element_at(words, i + 1)))).otherwise(F.array(F.coalesce(F.try_element_at(words, F.lit(1)), F.lit(""))))
    first = d.select("grp", "pos", F.explode(pairs).alias("p")).groupBy("grp", "p").agg(F.min("pos").alias("pos")).groupBy("grp", "pos").agg(F.count("*").alias("new"))
    w = Window.partitionBy("grp").orderBy("pos")
    curve = d.select("grp", "pos").join(first, ["grp", "pos"], "left").withColumn("y", F.sum(F.coalesce("new", F.lit(0))).over(w)).withColumn("i", F.row_number().over(w) - 1)
    ends = curve.groupBy("grp").agg(F.min_by("y", "i").alias("a"), F.max("y").alias("z"), F.max("i").alias("last"))
    over = curve.join(ends, "grp").withColumn("d", F.when(F.col("z") > F.col("a"), (F.col("y") - F.col("a")) / (F.col("z") - F.col("a")) - F.col("i") / F.col("last")))
    knee = over.groupBy("grp").agg(F.max(F.struct("d", (-F.col("i")).alias("i"))).alias("m"), F.max("last").alias("last"), F.max((F.col("z") == F.col("a")).cast("int")).alias("flat"))
    knee = knee.select("grp", F.when(F.col("last") < 2, None).when(F.col("flat") == 1, 1).when(F.col("m.d") < 0.05, None).otherwise(-F.col("m.i") + 1).alias("joelho"))
    j = size.join(lead, "grp").join(knee, "grp", "left")
    cap = F.col("n") if most is None else F.lit(most)
    variety = F.col("unicos") / F.col("n")
    wide = F.greatest(F.lit(least), (F.col("n") * (0.3 + 0.7 * variety)).cast("int"))
    at = F.when(F.col("joelho").isNull(), wide).when(variety > 0.7, F.greatest("joelho", wide)).otherwise(F.col("joelho"))
    k0 = F.least(F.greatest(F.lit(least), (at * bias).cast("int")), cap)
    planned = checkpoint(j.withColumn("k0", k0.cast("int")).withColumn("cap", cap.cast("int")))
    rated = _rates(d.join(planned.where((F.col("n") > 8) & (F.col("unicos") > 3) & (F.col("k0") < F.least("n", "cap"))).select("grp", "k0"), "grp"))
    out = planned.join(rated, "grp", "left")
    more = F.when(F.col("longe"), F.least((F.col("k0") * 1.2).cast("int"), F.col("cap"))).otherwise(F.col("k0"))
    k = F.when(F.col("n") <= 8, F.col("n")).when(F.col("unicos") <= 3, F.least(F.greatest(F.lit(least), F.col("unicos")), F.col("cap"))).otherwise(F.greatest(F.lit(least), F.least(more, F.col("cap"))))
    return out.select("grp", "n", "unicos", "joelho", k.cast("int").alias("k"))


def _rates(d: DataFrame, tolerance: float = 0.15, short: int = 200) -> DataFrame:
    """``(grp, longe)``: whether the first ``k0`` items compress by a rate over ``tolerance`` from that of all; ``d``: (grp, pos, t, k0)."""
    kind = d.schema["grp"].dataType.simpleString()
    src = d.select("grp", "t", "k0", "pos").repartition("grp").sortWithinPartitions("grp", "pos").drop("pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def close() -> bool:
            part, whole, size, cut, _ = state
            end = part.copy().flush() if cut is None else b""
            rate = lambda done, tail, n: (done + len(tail)) / n if n else 1.0
            own = cut if cut is not None else rate(whole[1], end, size)
            return size >= short and abs(rate(whole[1], part.flush(), size) - own) > tolerance

        for b in batches:
            done, far = [], []
            for g, t, k in zip(*[c.to_pylist() for c in b.columns]):
                if state is None or g != now:
                    if state is not None:
                        done.append(now), far.append(close())
                    # the compressor, [items, compressed bytes], bytes, rate of the first k, k
                    now, state = g, [zlib.compressobj(1), [0, 0], 0, None, k]
                raw = (b"" if state[1][0] == 0 else b"\n") + (t or "").encode("utf-8", "surrogatepass")
                state[1][1] += len(state[0].compress(raw))
                state[1][0] += 1
                state[2] += len(raw)
                if state[1][0] == k:
                    state[3] = (state[1][1] + len(state[0].copy().flush())) / state[2] if state[2] else 1.0
            types = b.schema.types
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(done, types[0]), pa.array(far, pa.bool_())], ["grp", "longe"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], types[0]), pa.array([close()], pa.bool_())], ["grp", "longe"])

    return src.mapInArrow(run, f"grp {kind}, longe boolean")


#: Shares of the anchors at the front, in the middle and at the back of an array, by its pattern.
ANCHORS = {"search_results": (0.75, 0.10, 0.15), "logs": (0.15, 0.10, 0.75), "time_series": (0.45, 0.10, 0.45), "generic": (0.5, 0.1, 0.4)}


def anchors(sizes: DataFrame) -> DataFrame:
    """``(grp, pos)`` of items kept for their place; ``sizes``: (grp, n, k, padrao), positions from 0 without gaps.

    A quarter of k, 3 to 12, shared between front, middle and back by the pattern; those of the middle lie evenly.
    """
    budget = F.least(F.lit(12), F.greatest(F.lit(3), (F.col("k") * 0.25).cast("int")))
    pick = lambda i: F.create_map(*[x for p, w in ANCHORS.items() for x in (F.lit(p), F.lit(w[i]))])[F.col("padrao")]
    d = sizes.withColumn("b", F.least(budget, F.col("n"))).withColumn("f", F.greatest(F.lit(1), F.floor(F.col("b") * pick(0) + 0.5))).withColumn("l", F.greatest(F.lit(1), F.floor(F.col("b") * pick(2) + 0.5)))
    d = d.withColumn("m", F.greatest(F.lit(0), F.col("b") - F.col("f") - F.col("l"))).withColumn("gap", F.col("n") - F.col("f") - F.col("l"))
    at = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(1).cast("long"), n.cast("long")), f)).otherwise(F.array().cast("array<bigint>"))
    front, back = at(F.col("f"), lambda i: i - 1), at(F.col("l"), lambda i: F.col("n").cast("long") - i)
    middle = at(F.when(F.col("gap") > 0, F.col("m")).otherwise(0), lambda i: (F.col("f") + F.floor(F.col("gap") * i / (F.col("m") + 1))).cast("long"))
    return d.select("grp", F.explode(F.array_distinct(F.concat(front, middle, back))).alias("pos")).where((F.col("pos") >= 0) & (F.col("pos") < F.col("n")))


def crushed(items: DataFrame, least_saving: float = 0.0) -> DataFrame:
    """``(grp, pos, item, motivo)``: the items that are kept of every array, with why.

    Arrays that are not to be shortened keep all (``inteiro``). Of others stay anomalies, changes of level, rare shapes and errors, whatever
    their number; the best scores of search results; anchors by pattern; and what is left of the adaptive size, first items first.
    """
    items = checkpoint(items.select("grp", "pos", "item"))
    how = checkpoint(strategies(items))
    size = adaptive_sizes(items)
    e = checkpoint(entries(items))
    profile = field_profile(items, e)
    keep_all = how.where(F.col("estrategia").isin("none", "skip")).select("grp")
    whole = items.join(how.where(~F.col("estrategia").isin("none", "skip")).select("grp"), "grp", "left_anti").select("grp", "pos", F.lit("inteiro").alias("motivo"), F.lit(0).alias("r"))
    cut = how.join(keep_all, "grp", "left_anti").join(size.select("grp", "k"), "grp")
    tag = lambda df, why, r: df.join(cut.select("grp"), "grp", "left_semi").select("grp", F.col("pos").cast("long").alias("pos"), F.lit(why).alias("motivo"), F.lit(r).alias("r"))
    roles = field_roles(items, e, profile)
    best = roles.where("score_conf > 0").groupBy("grp").agg(F.max_by("chave", F.struct("score_conf", "chave")).alias("chave"))
    ranked = e.join(best, ["grp", "chave"]).join(cut.where("estrategia = 'top_n'").select("grp", "k"), "grp").withColumn("p", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc_nulls_last("numero"), "pos"))).where(F.col("p") <= F.col("k"))
    seq = items.select("grp", "pos").withColumn("i", F.row_number().over(Window.partitionBy("grp").orderBy("pos")) - 1)
    held = anchors(cut.select("grp", "n", "k", "padrao")).toDF("grp", "i").join(seq, ["grp", "i"])
    sure = whole.withColumn("pos", F.col("pos").cast("long"))
    for df, why, r in ((anomalies(e, profile), "anomalia", 1), (shifts(e), "mudanca", 2), (rare_shapes(items, e), "forma", 3), (error_items(items), "erro", 4), (ranked, "melhor", 5), (held, "ancora", 6)):
        sure = sure.unionByName(tag(df, why, r))
    sure = checkpoint(sure.groupBy("grp", "pos").agg(F.min(F.struct("r", "motivo")).alias("m")).select("grp", "pos", "m.motivo"))
    room = cut.select("grp", "k").join(sure.groupBy("grp").agg(F.count("*").alias("c")), "grp", "left").select("grp", (F.col("k") - F.coalesce("c", F.lit(0))).alias("room")).where("room > 0")
    rest = seq.join(room, "grp").join(sure.select("grp", "pos"), ["grp", "pos"], "left_anti")
    fill = rest.withColumn("p", F.row_number().over(Window.partitionBy("grp").orderBy("pos"))).where(F.col("p") <= F.col("room")).select("grp", F.col("pos").cast("long").alias("pos"), F.lit("resto").alias("motivo"))
    return items.withColumn("pos", F.col("pos").cast("long")).join(sure.unionByName(fill), ["grp", "pos"]).select("grp", "pos", "item", "motivo")


# tables that say the same

def table_columns(items: DataFrame, e: DataFrame | None = None) -> DataFrame:
    """``(grp, chave, ordem, n)``: keys of each array by falling frequency, then name."""
    if e is None:
        n = items.select("grp", F.explode(F.array_distinct(F.map_keys(F.from_json("item", "map<string,variant>")))).alias("chave")).groupBy("grp", "chave").agg(F.count("*").alias("n"))
    else:
        n = e.groupBy("grp", "chave").agg(F.countDistinct("pos").alias("n"))
    return n.withColumn("ordem", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("n"), "chave"))).select("grp", "chave", "ordem", "n")


def quoted_cell(c: Column) -> Column:
    """A cell of comma-separated text: quoted if it holds a comma, a quote or an end of line, or would read as nothing."""
    special = c.rlike('[,"\r\n]') | (c == "") | (c != F.btrim(c))
    return F.when(special, F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def as_table(items: DataFrame, form: str = "csv") -> DataFrame:
    """``(grp, linha, texto)``: arrays as tables, one row a line: line 0 is the head, ``csv`` with types and quotes, ``markdown`` or ``kv``.

    Missing and null cells are empty; an empty text is ``""``. Tables of any length are rows, never one text. Cells are read where their
    item lies: of all entries only keys and types are grouped, and what is joined is one head a table.
    """
    kinds = entries(items).groupBy("grp", "chave").agg(F.when(F.min("tipo") == F.max("tipo"), F.min("tipo")).when(F.max("tipo").isNotNull(), "mixed").alias("tipo"))
    cols = table_columns(items).join(kinds, ["grp", "chave"], "left")
    head = checkpoint(cols.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("ordem", "chave", F.coalesce("tipo", F.lit("null")).alias("tipo")))).alias("h")))
    names = head.select("grp", F.transform("h", lambda x: x["chave"]).alias("ks"))
    # the estimated size of the heads is that of the items they come from, so they are counted
    few = head.agg(F.sum(F.size("h"))).first()[0] or 0
    cells = objects(items).select("grp", "pos", F.transform_values(F.from_json("item", "map<string,variant>"), lambda _, v: _text(v)).alias("m"))
    own = cells.join(F.broadcast(names) if few <= HEADS else names.hint("merge"), "grp")
    plain = lambda f: F.transform("ks", lambda k: f(F.try_element_at("m", k)))
    pipe = lambda v: F.coalesce(F.replace(F.replace(v, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")), F.lit(""))
    if form == "csv":
        top = head.select("grp", F.array_join(F.transform("h", lambda x: F.concat(quoted_cell(x["chave"]), F.lit(":"), x["tipo"])), ",").alias("texto"))
        row = F.array_join(plain(lambda v: F.coalesce(quoted_cell(v), F.lit(""))), ",")
    elif form == "markdown":
        top = head.select("grp", F.concat(F.lit("| "), F.array_join(F.transform("h", lambda x: pipe(x["chave"])), " | "), F.lit(" |\n|"), F.repeat(F.lit(" --- |"), F.size("h"))).alias("texto"))
        row = F.concat(F.lit("| "), F.array_join(plain(pipe), " | "), F.lit(" |"))
    elif form == "kv":
        top = head.select("grp", F.array_join(F.transform("h", lambda x: x["chave"]), " ").alias("texto"))
        row = F.array_join(F.filter(F.transform("ks", lambda k: F.concat(F.lit("- "), k, F.lit(": "), F.replace(F.try_element_at("m", k), F.lit("\n"), F.lit(" ")))), lambda x: x.isNotNull()), "\n")
    else:
        raise ValueError(form)
    return top.select("grp", F.lit(0).cast("long").alias("linha"), "texto").unionByName(own.select("grp", (F.row_number().over(Window.partitionBy("grp").orderBy("pos"))).cast("long").alias("linha"), row.alias("texto")))


def worth_it(items: DataFrame, tables: DataFrame, least: float = 0.15) -> DataFrame:
    """``(grp, antes, depois, vale)``: bytes of arrays as JSON and as tables, and whether a table saves at least ``least``."""
    a = items.groupBy("grp").agg((F.sum(F.octet_length("item") + 1) + 1).alias("antes"))
    b = tables.groupBy("grp").agg(F.sum(F.octet_length("texto") + 1).alias("depois"))
    return a.join(b, "grp").withColumn("vale", F.col("depois") <= (1 - least) * F.col("antes"))


def walked_arrays(docs: DataFrame, key: str, text: str, least: int = 5) -> DataFrame:
    """``(grp, pos, item, especie)`` of arrays of ``least`` items or more, at the top of a JSON text or one key below; ``grp`` is ``key`` or ``key.name``.

    ``especie``: object, string, number or mixed, by all the array's items.
    """
    v = docs.select(key, F.try_parse_json(text).alias("v")).where("v IS NOT NULL")
    top = v.select(F.col(key).cast("string").alias("grp"), F.try_variant_get("v", "$", "array<variant>").alias("a"))
    below = v.select(key, F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("k", "x")).select(F.concat_ws(".", F.col(key).cast("string"), "k").alias("grp"), F.try_variant_get("x", "$", "array<variant>").alias("a"))
    d = top.unionByName(below).where(F.size("a") >= least)
    kinds = F.array_distinct(F.transform("a", lambda x: F.when(F.schema_of_variant(x).startswith("OBJECT"), "object").when(F.schema_of_variant(x) == "STRING", "string").when(F.schema_of_variant(x).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), "number").otherwise("other")))
    kind = F.when((F.size(kinds) == 1) & (kinds[0] != "other"), kinds[0]).otherwise("mixed")
    return d.withColumn("especie", kind).select("grp", F.posexplode("a").alias("pos", "x"), "especie").select("grp", "pos", F.to_json("x").alias("item"), "especie")
