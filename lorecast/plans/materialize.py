"""Cutting lineage through files that every executor can read."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the one the session names, or, where it names none (tests), a local one.

    The session's setting is never replaced. The local fallback is used only where the master is local as well, since
    executors on other machines could not read it. What this session writes there is removed when its process ends.
    """
    sc = spark.sparkContext
    wanted = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not wanted:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        wanted = os.path.join(tempfile.gettempdir(), f"lorecast-{os.getuid()}")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(wanted)
        _remove_at_end(spark, sc.getCheckpointDir())
    return wanted


def _remove_at_end(spark: SparkSession, folder: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def remove() -> None:
        try:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
        except Exception:  # noqa: BLE001  the session's JVM may be gone
            pass

    atexit.register(remove)


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder once; what follows reads those files and survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Like `cut`, as a compressed table of columns: for wide rows, of which later steps read some columns only."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
