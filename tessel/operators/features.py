"""One row per entity with features of each of hundreds of event types.

Events are aggregated once by (entity, type), combined within tasks, so a hot
entity costs at most one row per type and task. Types are dealt into blocks by
hash; the aggregates are written once, partitioned by block and bucketed by
entity, and each block becomes a map column joined onto the bucketed complete
entity table: scans, groupings and joins of all blocks share the bucketing and
need no further shuffle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.plans.lineage import fresh_path, keep_table


def type_features(events: DataFrame, entity: str, kind: str, time: str, amount: str, outcome: str, until: str, outcomes: tuple[str, ...]) -> DataFrame:
    """(entity, kind, n, total, last_time, recency_days, n_<outcome>..., n_other): aggregates by entity and type. Rows without entity or type have no place and are left out; null amounts add nothing, null outcomes count as other."""
    is_ = lambda o: F.col(outcome) == o
    known = F.coalesce(F.col(outcome).isin(*outcomes), F.lit(False))
    return (
        events.where(F.col(entity).isNotNull() & F.col(kind).isNotNull())
        .groupBy(F.col(entity).alias("entity"), F.col(kind).alias("kind"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col(amount).cast("decimal(25,2)")).alias("total"),
            F.max(time).alias("last_time"),
            F.datediff(F.lit(until).cast("date"), F.max(time)).alias("recency_days"),
            *[F.count_if(is_(o)).alias(f"n_{o.lower()}") for o in outcomes],
            F.count_if(~known).alias("n_other"),
        )
    )


#: Bytes of input that a bucket is made for.
BUCKET_BYTES = 256 << 20


def buckets_for(spark: SparkSession, df: DataFrame) -> int:
    """As many buckets as the bytes of the tables under ``df`` ask for, one a core at least and no more than the session allows; where a table's size isn't known, as many as shuffle partitions."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    if any(n >= 1 << 60 for n in sizes):
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")), max(spark.sparkContext.defaultParallelism, -(-sum(sizes) // BUCKET_BYTES)))


def feature_blocks(features: DataFrame, entities: DataFrame, entity_key: str, block_types: int = 64, kinds: DataFrame | None = None) -> DataFrame:
    """The complete entity table (``entity_key`` distinct and not null, other columns kept) with one map<type, features> column per block of about ``block_types`` types; null where the entity has no event of the block.

    Types are counted over the column ``kind`` of ``kinds``, which holds at
    least the types of the features; without it over the features themselves,
    which are then computed twice. Column names of ``entities`` that clash with block columns (features_<k>)
    raise ValueError.
    """
    spark = features.sparkSession
    types = (features if kinds is None else kinds).agg(F.approx_count_distinct("kind")).first()[0]
    blocks = max(1, -(-types // block_types))
    clash = {f"features_{k}" for k in range(blocks)} & set(entities.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are taken")
    n = buckets_for(spark, features)
    values = [c for c in features.columns if c not in ("entity", "kind")]

    def bucketed(df: DataFrame, name: str, key: str, *parts: str) -> DataFrame:
        table = f"{name}_{uuid.uuid4().hex}"
        w = df.repartition(n, F.col(key)).write.format("parquet").option("path", fresh_path(spark, table)).bucketBy(n, key).sortBy(key)
        (w.partitionBy(*parts) if parts else w).saveAsTable(table)
        keep_table(spark, table)
        return spark.table(table)

    long = bucketed(features.withColumn("block", F.pmod(F.xxhash64("kind"), F.lit(blocks)).cast("int")), "tessel_features", "entity", "block")
    out = bucketed(entities, "tessel_entities", entity_key)
    for k in range(blocks):
        block = long.where(F.col("block") == k).groupBy(F.col("entity").alias("_tessel_entity")).agg(F.map_from_entries(F.collect_list(F.struct("kind", F.struct(*values)))).alias(f"features_{k}"))
        out = out.join(block, F.col(entity_key) == F.col("_tessel_entity"), "left").drop("_tessel_entity")
    return out


def open_blocks(table: DataFrame, entity_key: str) -> DataFrame:
    """Blocks back to one row per entity and type, which keeps the bucketing."""
    maps = [c for c in table.columns if c.startswith("features_")]
    return table.select(entity_key, F.explode(F.flatten(F.array(*[F.coalesce(F.map_entries(c), F.array()) for c in maps]))).alias("f")).select(entity_key, F.col("f.key").alias("kind"), "f.value.*")
