"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_ROOTS: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, else the one given to ``setCheckpointDir``.

    Where neither is set a local session gets a temporary folder; on a cluster
    executors couldn't read each other's, so that is an error.
    """
    context = spark.sparkContext
    if found := context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir():
        return found.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="sparkoire-")
        atexit.register(shutil.rmtree, _LOCAL["dir"], True)
    return "file://" + _LOCAL["dir"]


def mounted(path: str) -> str:
    """A shared folder's place in the file system, for what Spark's own readers and writers don't open."""
    place = urlparse(path)
    if place.scheme not in ("", "file"):
        raise RuntimeError(f"{path} isn't mounted: an embedded database needs a folder of the file system")
    return place.path


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def clear(spark: SparkSession) -> None:
    """Delete all tables that runs in this process have left; frames that still read them fail from then on."""
    while _ROOTS:
        delete(spark, _ROOTS.pop())


@atexit.register
def _at_exit() -> None:
    spark = SparkSession.getActiveSession() if SparkContext._active_spark_context else None
    if spark:
        clear(spark)


class Scratch:
    """Written intermediate tables of one operator run.

    ``cut`` writes a frame to the shared folder and reads it again: lineage ends
    there, and a lost executor costs a re-read, never a re-run of what came before.
    What a returned frame still reads stays until ``clear`` or the end of the process.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/sparkoire/{name}-{uuid.uuid4().hex}"
        self.n = 0
        _ROOTS.add(self.root)

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing will read again."""
        for df in frames:
            delete(self.spark, df._scratch_path)

    def release(self) -> None:
        """Let Spark's cleaner remove shuffle files of finished jobs now, not at its next half-hourly round."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
