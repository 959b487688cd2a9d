"""Processing of files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def process_new(spark: SparkSession, manifest_dir: str, schema: str, fn: Callable[[DataFrame, int], None], checkpoint: str, max_files: int = 1000, available_now: bool = True) -> StreamingQuery:
    """Calls ``fn(rows, batch)`` once for each batch of manifest rows that no earlier run has seen.

    The checkpoint remembers which manifest files are done, so a restart resumes; ``fn`` must overwrite what a
    broken batch of the same number has left (at least once, with the batch number for idempotence).
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(manifest_dir)
    writer = rows.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()
