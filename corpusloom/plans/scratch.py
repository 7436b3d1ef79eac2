"""Tables and files that a job shares between its executors.

Everything goes below the folder that the cluster names in ``spark.checkpoint.dir``.
Only where that is unset and everything runs in one process (as in tests) a local folder is made.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        named = context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them and the driver see")
        named = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


class Scratch:
    """A folder of one run of one operator in the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def table(self, frame: DataFrame, name: str) -> DataFrame:
        """Writes the frame and reads it again: it cuts lineage, and a lost executor costs a reread only."""
        path = self.path(name)
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *frames: DataFrame) -> None:
        """Deletes the files of tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {file.rsplit("/", 1)[0] for frame in frames for file in frame.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession) -> int:
    """As many partitions as the session gives shuffles."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
