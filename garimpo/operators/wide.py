"""Entity, attribute, value rows into wide typed tables.

Method: log-structured upserts. Each batch becomes a sparse wide delta, one row per entity with a map from column
to (version, raw value); compaction merges any number of such runs by the latest version of each cell. Versions are
compared, never arrival order, so runs can be compacted in any grouping and order, and again later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.functions.text import grouping_key, outer_trim

TEXT, INTEGER, BOOLEAN, DECIMAL = "text", "integer", "boolean", "decimal"

#: Columns that are not text.
COLUMN_TYPES = {
    "port": INTEGER, "setting_timeout_ms": INTEGER, "setting_workers": INTEGER,
    "setting_enabled": BOOLEAN, "setting_cache": BOOLEAN,
    "setting_temperature": DECIMAL,
}
#: Spellings of the booleans, lower case.
TRUE_WORDS = ["true", "yes", "on", "sim", "1"]
FALSE_WORDS = ["false", "no", "off", "não", "nao", "0"]
#: Fixed value: characters around a text value that do not belong to it.
TEXT_OUTER = " \t\r\n`\"'*"


def read_integer(v: Column) -> Column:
    """The only run of digits, without leading zeros; null with none or several."""
    runs = F.regexp_extract_all(v, F.lit("([0-9]+)"), 1)
    one = F.regexp_replace(F.try_element_at(runs, F.lit(1)), "^0+(?=[0-9])", "")
    return F.when(F.size(runs) == 1, one)


def read_boolean(v: Column) -> Column:
    w = F.lower(outer_trim(v))
    return F.when(w.isin(TRUE_WORDS), "true").when(w.isin(FALSE_WORDS), "false")


def read_decimal(v: Column) -> Column:
    """Digits, optionally ``.`` or ``,`` and one or two digits, given with two decimals."""
    t = outer_trim(v)
    whole = F.regexp_replace(F.regexp_extract(t, r"^([0-9]+)", 1), "^0+(?=[0-9])", "")
    part = F.rpad(F.regexp_extract(t, r"^[0-9]+[.,]([0-9]{1,2})$", 1), 2, "0")
    return F.when(t.rlike(r"\A[0-9]+([.,][0-9]{1,2})?\z"), F.concat(whole, F.lit("."), part))


def read_text(v: Column) -> Column:
    t = outer_trim(v, TEXT_OUTER)
    return F.when(t != "", t)


def read_cell(column: Column, v: Column, types: dict[str, str] | None = None) -> Column:
    """``v`` read by the type of its column, as text; null if it cannot be read."""
    types = COLUMN_TYPES if types is None else types
    of = {k: [c for c, t in types.items() if t == k] for k in (INTEGER, BOOLEAN, DECIMAL)}
    return (
        F.when(column.isin(of[INTEGER]), read_integer(v))
        .when(column.isin(of[BOOLEAN]), read_boolean(v))
        .when(column.isin(of[DECIMAL]), read_decimal(v))
        .otherwise(read_text(v))
    )


def _newest(cells: DataFrame, *by: str) -> DataFrame:
    return cells.groupBy(*by, "coluna").agg(F.max(F.struct("versao", "valor")).alias("c")).select(*by, "coluna", "c.versao", "c.valor")


def _rows(cells: DataFrame, *by: str) -> DataFrame:
    """One sparse wide row per entity; at most one entry a column."""
    return cells.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("coluna", F.struct("versao", "valor")))).alias("celulas"))


def to_deltas(facts: DataFrame, entity: str, attribute: str, value: str, version: list[str], batch: Column) -> DataFrame:
    """``(lote, entidade, celulas)``: per batch one sparse wide row per entity.

    ``version`` columns are compared as text in their order, null first; among rows of one version the
    greatest value decides. Rows with a null or empty entity or attribute key belong to nothing. A hot entity
    is down to one row per cell and task before it is shuffled.
    """
    cells = facts.select(
        batch.cast("string").alias("lote"),
        grouping_key(F.col(entity)).alias("entidade"),
        grouping_key(F.col(attribute)).alias("coluna"),
        F.struct(*[F.col(v).cast("string").alias(f"v{i}") for i, v in enumerate(version)]).alias("versao"),
        F.col(value).cast("string").alias("valor"),
    ).where((F.col("entidade") != "") & (F.col("coluna") != ""))
    return _rows(_newest(cells, "lote", "entidade"), "lote", "entidade")


def cells_of(rows: DataFrame) -> DataFrame:
    """``(entidade, coluna, versao, valor)`` of sparse wide rows."""
    return rows.select("entidade", F.explode("celulas").alias("coluna", "c")).select("entidade", "coluna", "c.versao", "c.valor")


def compact(*runs: DataFrame) -> DataFrame:
    """``(entidade, celulas)``: runs merged into one, the latest version of each cell kept.

    Compacting compacted runs again, or repeating a run, changes nothing.
    """
    cells = cells_of(runs[0])
    for r in runs[1:]:
        cells = cells.unionByName(cells_of(r))
    return _rows(_newest(cells, "entidade"), "entidade")


def merge_runs(rows: DataFrame, run: Column) -> DataFrame:
    """``(corrida, entidade, celulas)``: the runs that ``run`` gives one number are compacted into one, all runs in one job.

    One level of the merge tree: deltas of months into runs of years, these into one, or any other grouping.
    """
    cells = rows.select(run.cast("string").alias("corrida"), "entidade", F.explode("celulas").alias("coluna", "c")).select("corrida", "entidade", "coluna", "c.versao", "c.valor")
    return _rows(_newest(cells, "corrida", "entidade"), "corrida", "entidade")


class RunStore:
    """Runs written to a shared folder, level by level; each file of a run is sorted by entity.

    ``append`` writes a run to level 0. A level of ``fan_in`` runs is compacted into one run of the next level, so a cell is rewritten
    once a level. A run's folder is only read once it has its ``_SUCCESS`` mark, and runs that were compacted go after the new one is
    complete, so a job that dies leaves nothing lost; a run that is read twice changes nothing, as versions decide.
    """

    def __init__(self, spark: SparkSession, folder: str, fan_in: int = 4) -> None:
        if fan_in < 2:
            raise ValueError("fan_in must be at least 2")
        self.spark, self.folder, self.fan_in = spark, folder.rstrip("/"), fan_in
        jvm = spark.sparkContext._jvm  # noqa: SLF001
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001

    def runs(self, level: int) -> list[str]:
        """Folders of the complete runs of a level, in the order of writing."""
        at = self._path(f"{self.folder}/level={level}")
        if not self._fs.exists(at):
            return []
        names = sorted(f.getPath().getName() for f in self._fs.listStatus(at))
        return [f"{self.folder}/level={level}/{n}" for n in names if self._fs.exists(self._path(f"{self.folder}/level={level}/{n}/_SUCCESS"))]

    def levels(self) -> list[int]:
        at = self._path(self.folder)
        return sorted(int(f.getPath().getName()[6:]) for f in self._fs.listStatus(at) if f.getPath().getName().startswith("level=")) if self._fs.exists(at) else []

    def _write(self, rows: DataFrame, level: int, after: str | None) -> None:
        name = f"run-{int(after.rsplit('-', 1)[1]) + 1 if after else 0:09d}"
        rows.repartition("entidade").sortWithinPartitions("entidade").write.mode("overwrite").parquet(f"{self.folder}/level={level}/{name}")

    def append(self, rows: DataFrame) -> None:
        """``rows``: (entidade, celulas), a delta of one batch; then levels that are full are compacted."""
        own = self.runs(0)
        self._write(rows.select("entidade", "celulas"), 0, own[-1] if own else None)
        level = 0
        while len(full := self.runs(level)) >= self.fan_in:
            above = self.runs(level + 1)
            self._write(compact(*map(self.spark.read.parquet, full)), level + 1, above[-1] if above else None)
            for r in full:
                self._fs.delete(self._path(r), True)
            level += 1

    def read(self) -> DataFrame:
        """All complete runs compacted; ``(entidade, celulas)``."""
        every = [r for level in self.levels() for r in self.runs(level)]
        if not every:
            raise ValueError("the store holds no run")
        return compact(*map(self.spark.read.parquet, every))


def columns_of(compacted: DataFrame, most: int = 2000) -> list[str]:
    """The columns of all cells, in order; raises where there are over ``most``, for then they are no columns."""
    found = compacted.select(F.explode(F.map_keys("celulas")).alias("c")).distinct().orderBy("c").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} columns: keep them in a map")
    return [r["c"] for r in found]


def filled_cells(compacted: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """``(entidade, coluna, valor)``: the cells that hold a value; a cell whose latest value cannot be read is empty."""
    return cells_of(compacted).select("entidade", "coluna", read_cell(F.col("coluna"), F.col("valor"), types).alias("valor")).where(F.col("valor").isNotNull())


def wide_table(compacted: DataFrame, columns: list[str], types: dict[str, str] | None = None, rest: str | None = None) -> DataFrame:
    """One row per entity, one typed column for each of ``columns`` (integer as decimal(38,0), decimal as decimal(38,2)).

    ``rest`` names a map from column to text that holds the filled cells of all other columns; without it they are left out.
    """
    types = COLUMN_TYPES if types is None else types
    sql = {INTEGER: "decimal(38,0)", BOOLEAN: "boolean", DECIMAL: "decimal(38,2)", TEXT: "string"}

    def cell(c: str) -> Column:
        raw = F.try_element_at("celulas", F.lit(c))["valor"]
        return read_cell(F.lit(c), raw, types).try_cast(sql[types.get(c, TEXT)]).alias(c)

    out = [cell(c) for c in columns]
    if rest is not None:
        other = F.map_filter("celulas", lambda k, v: ~k.isin(columns))
        read = F.transform_values(other, lambda k, v: read_cell(k, v["valor"], types))
        out.append(F.map_filter(read, lambda k, v: v.isNotNull()).alias(rest))
    return compacted.select("entidade", *out)
