"""Writing chunks, trees, reports, indexes, answers and logs. Every sink is a distributed write; nothing is collected."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.operators.chunks import chunk_index, numbered_names


#: Folder name of a document without a key, as Spark has it.
NO_DOC = "__HIVE_DEFAULT_PARTITION__"


def write_chunk_files(chunks: DataFrame, folder: str, prefix: str) -> None:
    """One text file per chunk below its document's folder (doc_id=...), by its zero-padded name and holding its text alone (K1).

    Tasks write the files themselves, through whatever file system pyarrow knows
    by the folder's name: a committer would rename them one by one in the driver.
    A file appears whole, and _SUCCESS once all are there.
    """
    spark = chunks.sparkSession
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    named = numbered_names(chunks, prefix).select(F.col("doc_id").cast("string").alias("doc_id"), "file_name", F.coalesce("content", F.lit("")).alias("content"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = FileSystem.from_uri(folder)
        last, n = object(), 0
        for b in batches:
            for doc, name, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "file_name", "content")), strict=True):
                if doc != last:
                    below, last = f"{at}/doc_id={NO_DOC if doc is None else quote(doc, safe=' ')}", doc
                    fs.create_dir(below)
                part = f"{below}/.{name}-{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as out:
                    out.write(text.encode())
                fs.move(part, f"{below}/{name}")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    named.mapInArrow(put, "n bigint").agg(F.sum("n")).collect()
    write_bytes(spark, f"{folder}/_SUCCESS", b"")


def write_json(df: DataFrame, folder: str, partition: str | None = None) -> None:
    """Rows as JSON lines: chunks, reports, batch answers."""
    w = df.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).json(folder)


def write_chunk_index(chunks: DataFrame, folder: str) -> None:
    chunk_index(chunks).write.mode("overwrite").json(folder)  # K3


def write_texts(df: DataFrame, text: str, folder: str) -> None:
    """Full texts or trees, one value a document (K4)."""
    df.select("doc_id", F.col(text).alias("value")).write.mode("overwrite").partitionBy("doc_id").text(folder)


def write_index(assigned: DataFrame, folder: str, info: dict) -> None:
    """A vector index partitioned by list, so that a search reads its probes' folders alone, and its one-row description (K7, K8)."""
    spark = assigned.sparkSession
    assigned.repartition("centroid_id").write.mode("overwrite").partitionBy("centroid_id").parquet(f"{folder}/vectors")
    spark.createDataFrame([{k: str(v) for k, v in info.items()}]).write.mode("overwrite").json(f"{folder}/index_info")


def load_index(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    """What write_index wrote (S24, S30); FileNotFoundError if it isn't there."""
    if not exists(spark, f"{folder}/index_info"):
        raise FileNotFoundError(folder)
    return spark.read.parquet(f"{folder}/vectors"), spark.read.json(f"{folder}/index_info").first().asDict()


def write_nodes(nodes: DataFrame, folder: str) -> None:
    nodes.write.mode("overwrite").parquet(folder)  # K9


def load_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """S23."""
    if not exists(spark, folder):
        raise FileNotFoundError(folder)
    return spark.read.parquet(folder)


def append_log(rows: DataFrame, folder: str) -> None:
    """Requests and steps, appended."""
    rows.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(folder)


def timed(spark: SparkSession, steps: dict[str, Callable[[], object]], folder: str) -> list[object]:
    """Runs named steps in order and appends (step, elapsed) of each to a log, also of one that fails."""
    out, rows = [], []
    try:
        for name, f in steps.items():
            at = time.perf_counter()
            try:
                out.append(f())
            finally:
                rows.append((name, time.perf_counter() - at))
    finally:
        append_log(spark.createDataFrame(rows, "step string, elapsed double"), folder)
    return out


def write_bytes(spark: SparkSession, path: str, raw: bytes) -> None:
    """One small file, in whatever file system its path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    f = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p)
    f.write(bytearray(raw))
    f.close()


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
