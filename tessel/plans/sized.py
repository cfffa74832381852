"""Broadcasting behind a check of the measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Written bytes up to which a table is broadcast; Parquet opens to a few times as much.
BROADCAST_BYTES = 4 << 20


def written_bytes(df: DataFrame) -> int:
    """Bytes on disk of a table that Cut has written."""
    spark, path = df.sparkSession, df._tessel_path
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def small_side(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, a table written by Cut, marked for broadcast if it measures at most ``most`` bytes; else as it is, to be joined by sort-merge, whose skewed partitions AQE splits."""
    return F.broadcast(df) if written_bytes(df) <= most else df
