"""Row numbers within groups that may be too large for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.plans.lineage import Cut


def ranks_in_groups(df: DataFrame, groups: list[str], order: list[str], name: str = "rank", cut: Cut | None = None) -> DataFrame:
    """``df`` with the row's place (from 0) among those of its group, by ``order``.

    Rows are range-partitioned by group and order, so a group with a third of
    all rows lies in many tasks: places are counted within a task and shifted
    by the counts of the tasks before. Rows that are equal in group and order
    get distinct places in an unspecified order. A null group is a group.
    """
    cut = cut or Cut(df.sparkSession)
    parts = cut(df.repartitionByRange(*groups, *order).withColumn("_part", F.spark_partition_id()), "ranking")
    inside = Window.partitionBy("_part", *groups).orderBy(*order)
    across = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.groupBy("_part", *groups).count().withColumn("_base", F.coalesce(F.sum("count").over(across), F.lit(0))).drop("count")
    on = F.lit(True)
    left, right = parts.alias("l"), base.alias("r")
    for c in ("_part", *groups):
        on = on & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    ranked = left.join(right, on).select("l.*", "r._base")
    return ranked.withColumn(name, F.row_number().over(inside).cast("long") - 1 + F.col("_base")).drop("_part", "_base")
