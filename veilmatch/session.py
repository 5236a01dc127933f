"""Where intermediate tables go, and how Python workers find this package."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def share_code(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package when it is not installed."""
    env = getattr(getattr(spark, "sparkContext", None), "environment", None)
    if env is not None and _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir or setCheckpointDir() names; a temporary one only in local sessions that name none (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = named.get() if named.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="veilmatch-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/veilmatch/{spark.sparkContext.applicationId}"


def drop_tables(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results not yet written or collected can no longer be read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_table(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write ``df`` below the shared folder and read it back, so a lost executor loses nothing."""
    path = f"{_own_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(table: DataFrame) -> None:
    """Delete what write_table() wrote, once nothing reads it any more."""
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
