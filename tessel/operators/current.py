"""The current row of each record that was sent more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def current_rows(events: DataFrame, row_id: str, sent: str, **columns: Column) -> DataFrame:
    """One row per ``row_id`` with ``columns`` as its latest row (by ``sent``) has them.

    Combined within tasks before the shuffle, so copies of one row can't fill
    one. Rows sent at the same time are told apart by the greatest values, in
    the order of ``columns``; a null time is the earliest. Rows with a null id
    can't be copies of each other and stay as they are, one each.
    """
    picked = F.struct(F.col(sent).alias("_sent"), *[c.alias(k) for k, c in columns.items()])
    rows = events.select(F.col(row_id).alias("id"), picked.alias("row"))
    one = rows.where("id is not null").groupBy("id").agg(F.max("row").alias("row"))
    alone = rows.where("id is null")
    return one.unionByName(alone).select("id", *[F.col(f"row.{k}").alias(k) for k in columns])


def current_facts(events: DataFrame, row_id: str, sent: str, keys: dict[str, Column], values: dict[str, Column], code: Column | None = None) -> DataFrame:
    """One row per ``row_id`` with ``keys``, ``values`` and, as ``code``, the number that its latest row (by ``sent``) has: for records whose copies differ only in that code.

    ``keys`` (of any type) and ``values`` (of fixed width: numbers, dates,
    times) never change between copies once normalised; where a copy lacks a value the
    others' holds. All aggregates have a fixed width, so rows are combined by
    hash within tasks and after one shuffle, with no sort. ``code`` is within
    0..2047; of rows sent at the same time the greatest holds, a null time is the
    earliest. Rows with a null id stay as they are, one each.
    """
    us = F.coalesce(F.unix_micros(F.col(sent).cast("timestamp")), F.lit(-(2**51)))
    rows = events.select(F.col(row_id).alias("id"), *[c.alias(k) for k, c in keys.items()], *[c.alias(k) for k, c in values.items()], (us * 2048 + (F.lit(0) if code is None else code)).alias("_last"))
    rows = rows.withColumn("_alone", F.when(F.col("id").isNull(), F.monotonically_increasing_id()))
    last = [] if code is None else [F.pmod(F.max("_last"), F.lit(2048)).cast("int").alias("code")]
    return rows.groupBy("id", *keys, "_alone").agg(*[F.max(v).alias(v) for v in values], *last).drop("_alone")
