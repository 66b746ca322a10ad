"""Session helper and the one place where lineage is cut."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_own_folder: str | None = None


def local_session(cores: str = "*", name: str = "oddsift") -> SparkSession:
    """A local session with the settings the tests and the bench share."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder for written intermediate tables: ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then gets a folder of its own that is
    dropped when the process ends.
    """
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="oddsift-")
        atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
    return _own_folder


def materialize(df: DataFrame, label: str, folders: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder, with a folder per value of ``folders``, and read it back.

    The copy cuts the lineage, survives lost executors, and keeps later scans column-pruned.
    """
    path = os.path.join(shared_folder(df.sparkSession), f"{label}-{uuid.uuid4().hex}")
    df.write.partitionBy(*folders).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fill_cores(df: DataFrame, rows: int, rows_per_task: int = 5_000) -> DataFrame:
    """Spread a small input over the cores before heavy per-row work; large inputs have tasks enough."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    want = min(2 * cores, -(-rows // rows_per_task))
    return df.repartition(want) if df.rdd.getNumPartitions() < min(cores, want) else df
