"""Keyed lookups with a status, currency tables, incremental filters, duplicate checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def authorized(given_id: Column, given_key: Column, app_id: str, app_key: str) -> Column:
    """Both the id and the key are right (F8)."""
    return F.coalesce((given_id == app_id) & (given_key == app_key), F.lit(False))


def lookup(requests: DataFrame, table: DataFrame, keys: list[str], allowed: Column | None = None) -> DataFrame:
    """Each request with the row of ``table`` of its keys and a status: 401 if not allowed, 404 if there is no row, else 200 (S27, F7, J11). Keys compare exactly; nulls find nothing."""
    rows = table.withColumn("_there", F.lit(True))
    out = requests.join(rows, keys, "left")
    ok = F.lit(True) if allowed is None else allowed
    status = F.when(~ok, 401).when(F.col("_there"), 200).otherwise(404)
    hidden = [c for c in table.columns if c not in keys]
    return out.withColumn("status_code", status).drop("_there").withColumns({c: F.when(F.col("status_code") == 200, F.col(c)) for c in hidden})


def not_yet_done(inputs: DataFrame, done: list[DataFrame], key: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """Inputs whose base name is in none of the outputs' names, given suffixes stripped (F1, U4)."""
    import re
    from functools import reduce

    strip = "(" + "|".join(re.escape(s) for s in suffixes) + ")$" if suffixes else "$^"
    base = lambda c: F.regexp_replace(F.regexp_replace(F.element_at(F.split(c, "/"), -1), "\\.[^.]*$", ""), strip, "")
    names = reduce(DataFrame.union, [d.select(base(F.col(key)).alias("_base")) for d in done]).distinct()
    return inputs.withColumn("_base", base(F.col(key))).join(names, "_base", "left_anti").drop("_base")


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    """total, distinct and whether ids repeat."""
    return df.agg(F.count(key).alias("n"), F.count_distinct(key).alias("n_distinct")).withColumn("has_duplicates", F.col("n") > F.col("n_distinct"))


def share_of_total(df: DataFrame, value: str, groups: list[str] | None = None) -> DataFrame:
    """Percent of the total, or of its group's total, that each row has (A10). Totals are aggregated and not windowed, so no task holds a whole group."""
    if not groups:
        total = df.agg(F.sum(value)).scalar()
        return df.withColumn("percent", F.round(100 * F.col(value) / total, 2))
    totals = df.groupBy(*groups).agg(F.sum(value).alias("_total"))
    return df.join(totals, groups).withColumn("percent", F.round(100 * F.col(value) / F.col("_total"), 2)).drop("_total")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in floating columns as null."""
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n, t in df.dtypes if t in ("double", "float")})


def latest_per_source(messages: DataFrame) -> DataFrame:
    """The last message of each source of a chat."""
    return messages.groupBy("chat", "source").agg(F.max_by("content", "seq").alias("content"))


def summary(text: Column, words: int = 30) -> Column:
    """The first words of a text: the offline stand-in for a model's summary."""
    return F.array_join(F.slice(F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " ")), " "), 1, words), " ")
