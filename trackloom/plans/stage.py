"""Cutting lineage through files that every executor can read."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a folder of our own only if that is unset and the master is local, as in tests."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="trackloom-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", "file://" + own)
    return "file://" + own


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once and read back; several readers then share one computation.

    Tables stay as long as the application, since results that are read later
    depend on them, and are deleted when it ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}.parquet"
    if not _made:
        atexit.register(_delete)
    _made.append((spark, path))
    df.write.parquet(path)
    return spark.read.parquet(path)


def _delete() -> None:
    """Deletes what was staged, where the application is still there to do so."""
    for spark, path in _made:
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001 - the application ended first; its folder is the cluster's
            return
