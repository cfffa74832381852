"""Queries p9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.reading import reading_levels, train


def p9_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Score, level and band of every document."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return reading_levels(docs, train(docs, spark.read.parquet(f"{sf}/reading_labels.parquet")))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_levels(spark, sf).where("band = 5").select("doc_id")


def p9_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of each band by language, for profiling the corpus."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lang = F.lower(F.substring_index(F.trim("lang"), "-", 1)).alias("lang")
    return docs.select("doc_id", lang).join(p9_levels(spark, sf), "doc_id").groupBy("lang", "band").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("level").alias("mean_level"))


QUERIES = {f.__name__: f for f in (p9_found, p9_levels, p9_profile)}
SQL: dict[str, str] = {}
