"""Structured Streaming over arriving archives; the batch plan runs on each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.convert import convert, publish
from ..policy import Options


def arriving_books(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Archives as they arrive; a bounded number of files in each batch."""
    source = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch)
    rows = source.schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return rows.filter(F.lower("path").endswith(".epub")).select(F.col("path").alias("book_id"), F.lit(0).alias("input_ord"), "path", "length", "content")


def convert_arrivals(spark: SparkSession, folder: str, root: str, checkpoint: str, options: Options = Options()) -> StreamingQuery:
    """Converts all that is there and stops. A batch's files go below root / batch number, so a batch that is run again replaces its own."""
    again = Options(**{**options.__dict__, "force": True})

    def one(batch: DataFrame, number: int) -> None:
        publish(convert(batch, options), f"{root}/batch-{number}", again)

    return arriving_books(spark, folder).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
