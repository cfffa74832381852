"""Incremental ingest: new files as a stream, each read once.

The batch form of skipping what is done is an anti join; as a stream the
checkpoint of the query remembers which files were read, and ``foreachBatch``
writes each batch's outlines, so a restart neither repeats nor loses one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessel.sources.files import EXTENSIONS, read_outlines


def stream_outlines(spark: SparkSession, folder: str, out: str, checkpoint: str, extensions: tuple[str, ...] = EXTENSIONS) -> StreamingQuery:
    """Outlines of files that appear below ``folder``, written to ``out`` until no new ones are left."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    listed = files.select("path", name.alias("name"), F.lower(F.regexp_extract(name, "\\.([^.]+)$", 1)).alias("extension"), "content").where(F.col("extension").isin(*extensions))

    def write(batch: DataFrame, epoch: int) -> None:
        read_outlines(batch).withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(out)

    return listed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_counts(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per key and window of a stream, late ones being counted up to ``late``."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")
