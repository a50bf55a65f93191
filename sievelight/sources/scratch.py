"""Working tables in the folder that all executors share, for cutting lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where none is named, on a local master."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='sievelight-')}"
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # the session may have ended before the interpreter
        pass


def place(spark: SparkSession) -> str:
    """A path of its own in the shared folder; what is there is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    atexit.register(_at_exit, spark, path)
    return path


def saved(df: DataFrame, group: int | None = None) -> DataFrame:
    """The frame as a written table; deleted when the driver ends, as returned frames read from it until then. ``group``:
    bytes of a row group, which readers of wide rows hold whole."""
    spark = df.sparkSession
    path = place(spark)
    (df.write if group is None else df.write.option("parquet.block.size", group)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
