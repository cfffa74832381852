"""Queries p3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.scans import repair_scans

KEYS = ["file_id", "node_index", "chunk_index"]


def p3_repaired(spark: SparkSession, sf: str) -> DataFrame:
    """Every paragraph node and chunk with its repaired text."""
    nodes = spark.read.parquet(f"{sf}/document_node.parquet")
    kind = F.lower(F.col("node_type"))
    items = (
        nodes.where(kind == "paragraph")
        .select("file_id", "node_index", F.lit(-1).alias("chunk_index"), "text")
        .unionByName(spark.read.parquet(f"{sf}/text_chunk.parquet").select("file_id", F.col("source_node_index").alias("node_index"), "chunk_index", F.col("content").alias("text")))
    )
    headings = nodes.where(kind == "heading").select("file_id", "node_index", "text")
    return repair_scans(items, headings, spark.read.parquet(f"{sf}/documents.parquet").select("text"), KEYS)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_repaired(spark, sf).select(*KEYS, F.explode("noises").alias("noise")).distinct()


def p3_text(spark: SparkSession, sf: str) -> DataFrame:
    """The repaired texts, each item once."""
    return p3_repaired(spark, sf).select(*KEYS, "scanned", "text").dropDuplicates(KEYS)


QUERIES = {f.__name__: f for f in (p3_found, p3_text)}
SQL: dict[str, str] = {}
