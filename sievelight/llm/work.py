"""Working storage that every executor can read, for cutting lineage."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a temporary one only where none is named (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    made = spark.sparkContext.getCheckpointDir()
    if not made:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='sievelight-')}")
        made = spark.sparkContext.getCheckpointDir()
    return made.rstrip("/")


def keep_memory() -> None:
    """Lets a Python worker keep up to 64 MB of freed memory, where its allocator has such a setting: numpy's temporary
    arrays are otherwise handed back to the system and asked for again at each step."""
    try:
        change = ctypes.CDLL(None).mallopt
    except (OSError, AttributeError):
        return
    change(-3, 32 << 20)  # from what size on arrays are mapped apart
    change(-1, 64 << 20)  # what is kept


class Work:
    """Written tables in the shared folder. A lost executor loses none of them.

    ``save`` writes a frame as Parquet and returns a frame that reads it; ``drop`` deletes a table early; what is
    left is deleted when the driver ends, as returned frames still read from it until then.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/sievelight-{uuid.uuid4().hex[:12]}"
        self._n = 0
        atexit.register(self.close)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._sievelight_path = path
        self.release()
        return out

    def release(self) -> None:
        """Lets Spark's cleaner delete the shuffle files of finished steps now, not at the driver's next collection of garbage."""
        self.spark._jvm.System.gc()

    def drop(self, *frames: DataFrame) -> None:
        for f in frames:
            self._delete(f._sievelight_path)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session may have ended before the interpreter
            pass
