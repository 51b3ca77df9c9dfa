"""Decoding of files as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.plans import decode


def files(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """image_id (the path) and content of each new file below a folder, as a stream."""
    source = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", files_a_batch).option("recursiveFileLookup", "true")
    return source.schema("path string, modificationTime timestamp, length long, content binary").load(folder).select(F.col("path").alias("image_id"), "content")


def lines(spark: SparkSession, folder: str, out: str, checkpoint: str, max_res: int | None = None, **trigger) -> StreamingQuery:
    """Starts a query that writes the decoded lines of new files as Parquet, a folder `batch=n` for each micro-batch.

    A batch that is run again after a failure overwrites its own folder, so each file's lines are there
    once. Files that can't be parsed go to `errors` beside it, with the reason.
    """

    def save(batch: DataFrame, number: int) -> None:
        rows = decode.parse(batch, max_res).persist()  # both tables are made from it; what is lost is parsed again
        decode.decode_parsed(rows, max_res).write.mode("overwrite").parquet(f"{out}/lines/batch={number}")
        rows.filter("error IS NOT NULL").select("image_id", "error").write.mode("overwrite").parquet(f"{out}/errors/batch={number}")
        rows.unpersist()

    return files(spark, folder).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
