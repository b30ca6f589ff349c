"""Session defaults, table loading and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the submitter's session is used as it is."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("garimpo")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data folder: ``<dir>/<table>.parquet``, a file or a folder of files."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage in the shared folder of ``spark.checkpoint.dir``.

    Only where the session names no folder (local tests) is a temporary one set, which goes when the program ends. The data survive the
    loss of executors, unlike a local checkpoint. Files of checkpoints that are no longer referred to go with
    ``spark.cleaner.referenceTracking.cleanCheckpoints``, which the submitter should set as ``local_session`` does.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="garimpo-checkpoints-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
    return df.checkpoint(eager)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if a small table came in fewer partitions and its rows take long; large tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def ship(spark: SparkSession) -> None:
    """Give the session's workers this package, once, so that they need not have it installed or start in its folder."""
    sc = spark.sparkContext
    if getattr(sc, "_garimpo_shipped", False):
        return
    root = Path(__file__).resolve().parent
    # the driver serves the file from where it lies, for as long as the session lasts
    z = os.path.join(tempfile.mkdtemp(prefix="garimpo-"), "garimpo_workers.zip")
    with zipfile.ZipFile(z, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, str(p.relative_to(root.parent)))
    atexit.register(shutil.rmtree, os.path.dirname(z), ignore_errors=True)
    sc.addPyFile(z)
    sc._garimpo_shipped = True
