"""Event-time windows, over tables and over streams: beyond what the reference has."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, time: str, width: str, keys: list[str], sums: dict[str, str], watermark: str | None = None) -> DataFrame:
    """(start, keys, n, sums) of each window; floating values are summed as decimals.  Works on streams: with a watermark
    rows that come later than that are dropped and windows are final once it has passed."""
    if watermark:
        events = events.withWatermark(time, watermark)
    made = [F.sum(F.col(c).cast("decimal(18,4)")).cast("double").alias(n) for n, c in sums.items()]
    found = events.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n"), *made)
    return found.select(F.col("w.start").alias("start"), *keys, "n", *sums)


def streamed(spark: SparkSession, events: DataFrame, time: str, width: str, keys: list[str], sums: dict[str, str]) -> DataFrame:
    """The same by a stream over the files of a table, run until it has read them all."""
    files = events.inputFiles()
    root = files[0].rsplit("/", 1)[0]
    names = sorted({f.rsplit("/", 1)[1] for f in files})
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", names[0] if len(names) == 1 else "*.parquet").parquet(root)
    shared = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="quillon-")
    place = f"{shared.rstrip('/')}/windows-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        """Each batch's result is whole; written again after a failure it is the same."""
        batch.write.mode("overwrite").parquet(f"{place}/{number}")

    found = tumbling(stream, time, width, keys, sums)
    query = found.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{place}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    last = query.lastProgress
    if last is None:
        return spark.createDataFrame([], found.schema)
    return spark.read.schema(found.schema).parquet(f"{place}/{last['batchId']}")
