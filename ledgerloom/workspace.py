"""Materialising intermediate tables where every executor can read them again.

A table written here survives the loss of executors, unlike cached blocks. The folder is the one the cluster
names in `spark.checkpoint.dir`; only where that is unset (tests, a laptop) a local one is made and set.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def _is_local(spark: SparkSession) -> bool:
    """True if driver and executors are one machine."""
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of the session. Only a local session may name none: it is given a fresh one, which goes when Python ends."""
    folder = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = held.get() if held.isDefined() else None
        if folder is None:
            if not _is_local(spark):
                raise RuntimeError(f"a cluster session has to name a folder that all its machines share, in {CHECKPOINT_KEY}")
            home = tempfile.mkdtemp(prefix="ledgerloom-")
            atexit.register(shutil.rmtree, home, ignore_errors=True)
            folder = f"file://{home}"
        spark.conf.set(CHECKPOINT_KEY, folder)
    return folder.rstrip("/")


_written: list[str] = []


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write `df` to the shared folder as Parquet and return the written table, which cuts its lineage. `discard` removes it.

    Spark deletes the shuffle files of a plan when the driver has collected what refers to it. Before another table is written both
    collectors are asked to, so that the files of plans that an earlier table has cut do not add up on the executors' disks.
    """
    spark = df.sparkSession
    if _written:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> int:
    """Delete what `materialise` has written so far, once nothing reads it any more; returns how many tables."""
    jvm, n = spark.sparkContext._jvm, len(_written)
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the session's Python workers, once per application.

    Functions that run in workers are found there by name, so a cluster whose machines lack the package needs a copy. Every
    operator that runs Python in workers calls this, so it works on any DataFrame.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    # With the driver, which serves it to the executors.
    home = Path(tempfile.mkdtemp(prefix="ledgerloom-"))
    atexit.register(shutil.rmtree, home, ignore_errors=True)
    archive, package = home / f"ledgerloom-{uuid.uuid4().hex}.zip", Path(__file__).resolve().parent
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f"{package.name}/{f.relative_to(package)}")
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def in_workers(df: DataFrame) -> DataFrame:
    """`df`, whose rows are about to go through this package's Python in the workers."""
    ship_package(df.sparkSession)
    return df
