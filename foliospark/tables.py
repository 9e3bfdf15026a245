"""Tables in the folder that driver and executors share; they cut lineage and outlive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one the session names, or else one set with setCheckpointDir.

    A local session, whose executors are this machine, gets a temporary one; elsewhere none
    is made up, since other machines could not read it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="foliospark-"))
    return context.getCheckpointDir()


#: Bytes that a writing task holds of a table; by default it would be 128 MB.
ROW_GROUP = 16 << 20


class SharedTables:
    """Parquet tables in the shared folder, which cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/foliospark-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes and rereads; the reread plan no longer knows how the rows were made."""
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
