"""Spark session helpers.

The library never creates its own session inside an operator; callers pass one in.
These helpers exist for tests, the benchmark and the driver entry point.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def get_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "cellar") -> SparkSession:
    """Local session configured the way the operators expect (UTC, AQE, ANSI on)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CELLAR_DRIVER_MEMORY", "12g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder that ``spark.checkpoint.dir`` names.

    Only a ``local`` session, whose executors are the driver's own threads, may
    go without: it gets a scratch folder. Anywhere else the setting is required,
    because executors could not read a folder of the driver's machine.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not conf_dir:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = sc.getCheckpointDir() or tempfile.mkdtemp(prefix="cellar-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(conf_dir)
    return conf_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver test table as a lazy DataFrame."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the checkpoint folder, deleted when the driver ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cellar-{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries run inside give their shuffle files back as soon as they end, not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def materialize(df: DataFrame) -> DataFrame:
    """Compute an intermediate result once and cut its lineage.

    The result is written as Parquet to a fresh folder under the shared
    ``spark.checkpoint.dir`` (so it survives executor loss) and read back.
    Unlike ``checkpoint()`` on an unpersisted plan, the input is computed once.
    Used for tables that several later jobs read (metric tables, value counts).
    The shuffles that made the result are freed once it is written; the folder
    is deleted when the driver ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "mat")
    with shuffles_freed(spark):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the folders of tables made by ``materialize`` that nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/cellar-mat-" not in folder:
                raise ValueError(f"not a table of materialize: {folder}")
            jpath = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            jpath.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jpath, True)
