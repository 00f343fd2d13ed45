"""The shared folder that lineage is cut into."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir; only in local mode, where it is unset, one is made."""
    sc = spark.sparkContext
    jsc = sc._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        configured = sc.getConf().get("spark.checkpoint.dir")
        if not configured and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    return jsc.getCheckpointDir().get()


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage into the shared folder, where a lost executor's part can be read again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder, on whatever file system it is."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
