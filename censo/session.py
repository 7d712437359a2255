"""Session factory and the few helpers every query shares."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "censo", cpus: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    n = cpus or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CENSO_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per context: their working directory and path need not hold it."""
    sc = spark.sparkContext
    if getattr(sc, "_censo_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="censo-package-")) / "censo.zip"  # read by the driver only, which serves it to the executors
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path("censo") / f.relative_to(root))
    sc.addPyFile(str(archive))
    sc._censo_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the given directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of spark.checkpoint.dir; where it is unset, a temporary one on a local master, and an error on a cluster."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or local_folder(spark, "censo-checkpoint-"))


def local_folder(spark: SparkSession, prefix: str) -> str:
    """A temporary folder of this machine, which only a local master shares with all its tasks."""
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
    return tempfile.mkdtemp(prefix=prefix)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    Reliable checkpoints survive the loss of an executor, which cached or local ones do not.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def at_least_partitions(df: DataFrame) -> DataFrame:
    """``df`` itself where its scan already has a few splits for every core, else spread over all cores.

    For CPU-heavy Python stages over small files only: a large input comes in splits enough and is never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(3 * cores)
