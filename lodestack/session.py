"""Session building and the few runtime services operators may use."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lodestack", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LODESTACK_DRIVER_MEMORY", "6g"))
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back, so that its
    lineage ends there and a lost executor costs a re-read, not a recomputation.

    The folder is the session's ``spark.checkpoint.dir``; one is made up only where
    the session names none and runs on one machine, as in tests.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        place = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not place and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(place or tempfile.mkdtemp(prefix="lodestack-checkpoint-"))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str, heavy: bool = False) -> DataFrame:
    """One of the driver's parquet tables.

    ``heavy`` is for queries that work long on each row: a table of fewer splits than there are
    cores, such as one small file, is spread over all of them. Tables of any size have more
    splits than that and are left alone.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if heavy and df.rdd.getNumPartitions() < cores else df


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A literal table."""
    return spark.createDataFrame(rows, schema)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the session's Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    root = os.path.dirname(os.path.abspath(__file__))
    # the driver serves the archive itself; the shared folder is used where it is a path
    shared = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://")
    folder = os.path.join(shared, f"lodestack-{sc.applicationId}") if shared.startswith("/") else tempfile.mkdtemp(prefix="lodestack-ship-")
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, "lodestack_src.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("lodestack", os.path.relpath(full, root)))
    sc.addPyFile(path)
