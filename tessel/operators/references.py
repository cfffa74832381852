"""References to records that do not exist (yet, or any more).

References are first brought down to one row per distinct spelling of a key
with the earliest and latest time it is used: a map-side combine, so a key that
a third of all events name costs one row per task. These rows and the parents
are range-partitioned by key; within a range the parents become sorted arrays
and the references, in Arrow batches, are found in them by binary search. What
comes back are the spellings that may be unsound at some time: keys without a
parent, and keys with a creation or deletion that touches the span of their
use. Only references spelt that way are then tested one by one against the
parent's periods; that table is written, measured, and broadcast if it is small,
else joined by sort-merge with skew splitting.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.functions.keys import is_blank, match_key
from tessel.plans.lineage import Cut
from tessel.plans.sized import small_side

MISSING, LATE, DELETED = "missing", "created_later", "deleted"
_OUT = "kind string, raw string, created bigint, gone array<struct<from:bigint,to:bigint>>, missing boolean"


def parents_of(table: DataFrame, kind: str, key: str, created: str) -> DataFrame:
    """(kind, key, created): rows without a key are no parents; of equal keys the earliest creation holds; a null creation time means always there."""
    t = F.coalesce(F.unix_micros(F.col(created).cast("timestamp")), F.lit(-(2**62)))
    return table.select(F.lit(kind).alias("kind"), match_key(F.col(key)).alias("key"), t.alias("created")).where("key is not null").groupBy("kind", "key").agg(F.min("created").alias("created"))


def deletions_of(table: DataFrame, entity: str = "entity", key: str = "record_id", start: str = "deleted_time", end: str = "restored_time") -> DataFrame:
    """(kind, key, gone): the periods in which a record is deleted, end exclusive, open ones ending at the largest long. Rows without a start say nothing."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return (
        table.where(F.col(start).isNotNull())
        .select(F.lower(F.btrim(F.col(entity))).alias("kind"), match_key(F.col(key)).alias("key"), us(start).alias("from"), F.coalesce(us(end), F.lit(2**63 - 1)).alias("to"))
        .where("key is not null and from < to")
        .groupBy("kind", "key")
        .agg(F.array_sort(F.collect_set(F.struct("from", "to"))).alias("gone"))
    )


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range, parents first: their keys as a sorted array, then each batch of references by binary search."""
    schema = pa.schema([("kind", pa.string()), ("raw", pa.string()), ("created", pa.int64()), ("gone", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), ("missing", pa.bool_())])
    held: list[pa.RecordBatch] = []
    keys = created = gone = first = last = None
    for b in batches:
        is_ref = b.column("ref").to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(is_ref, 1))
        if cut:
            held.append(b.slice(0, cut))
        if cut == b.num_rows:
            continue
        if keys is None:
            t = pa.Table.from_batches(held) if held else None
            if t is not None:
                keys = np.array([f"{k}\x00{v}" for k, v in zip(t["kind"].to_pylist(), t["key"].to_pylist(), strict=True)], dtype=object)
                order = np.argsort(keys, kind="stable")
                keys, created = keys[order], t["created"].to_numpy()[order]
                gone = t["gone"].combine_chunks().take(pa.array(order))
                spans = gone.to_pylist()
                first = np.array([min((x["from"] for x in g), default=2**63 - 1) if g else 2**63 - 1 for g in spans], dtype=np.int64)
                last = np.array([max((x["to"] for x in g), default=-(2**63)) if g else -(2**63) for g in spans], dtype=np.int64)
            else:
                keys = np.array([], dtype=object)
        r = b.slice(cut)
        want = np.array([f"{k}\x00{v}" for k, v in zip(r.column("kind").to_pylist(), r.column("key").to_pylist(), strict=True)], dtype=object)
        lo, hi = r.column("created").to_numpy(), r.column("until").to_numpy()
        if not len(keys):
            hit = np.zeros(len(want), dtype=bool)
            at = np.zeros(len(want), dtype=np.int64)
            bad = ~hit
        else:
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            hit = keys[at] == want
            bad = ~hit | (created[at] > lo) | ((first[at] <= hi) & (last[at] > lo))
        take = np.flatnonzero(bad)
        if not len(take):
            continue
        h = hit[take]
        none = pa.nulls(len(take), schema.field("gone").type) if not len(keys) else gone.take(pa.array(at[take], mask=~h))
        made = pa.nulls(len(take), pa.int64()) if not len(keys) else pa.array(created[at[take]], mask=~h)
        yield pa.RecordBatch.from_arrays([r.column("kind").take(pa.array(take)), r.column("raw").take(pa.array(take)), made, none, pa.array(~h)], schema=schema)


def unsound_keys(refs: DataFrame, parents: DataFrame, deletions: DataFrame) -> DataFrame:
    """``refs`` (kind, raw, t in microseconds) -> the spellings (kind, raw, created, gone, missing) that are unsound at some time within the span of their use."""
    used = (
        refs.groupBy("kind", "raw")
        .agg(F.min("t").alias("created"), F.max("t").alias("until"))
        .select("kind", match_key(F.col("raw")).alias("key"), F.lit(1).alias("ref"), "raw", "created", "until", F.lit(None).cast("array<struct<from:bigint,to:bigint>>").alias("gone"))
    )
    known = parents.join(deletions, ["kind", "key"], "left").select("kind", "key", F.lit(0).alias("ref"), F.lit(None).cast("string").alias("raw"), "created", F.lit(None).cast("bigint").alias("until"), "gone")
    return known.unionByName(used).repartitionByRange("kind", "key").sortWithinPartitions("ref").mapInArrow(_probe, _OUT)


def references_of(events: DataFrame, fields: dict[str, str], row_id: str, time: str) -> DataFrame:
    """(id, field, kind, raw, t): every reference that is neither null nor blank. A null time is before everything."""
    refs = [F.struct(F.lit(f).alias("field"), F.lit(kind).alias("kind"), F.col(f).cast("string").alias("raw")) for f, kind in fields.items()]
    t = F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), F.lit(-(2**62)))
    return events.select(F.col(row_id).alias("id"), t.alias("t"), F.explode(F.array(*refs)).alias("r")).select("id", "t", "r.field", "r.kind", "r.raw").where(~is_blank(F.col("raw")))


def orphan_references(events: DataFrame, fields: dict[str, str], row_id: str, time: str, parents: list[DataFrame], deletions: DataFrame, cut: Cut | None = None) -> DataFrame:
    """(id, field, kind, t, reason): one row per event and unsound reference, events told apart by ``row_id``.

    ``fields`` maps reference columns to kinds; ``parents`` come from
    parents_of, ``deletions`` from deletions_of. reason is missing,
    created_later or deleted, the first that holds. Null and blank references
    are none; rows repeated under one id count once; empty tables of parents
    make every reference missing; other columns are never read.
    """
    refs = references_of(events, fields, row_id, time)
    cut = cut or Cut(events.sparkSession)
    keys = small_side(cut(unsound_keys(refs.select("kind", "raw", "t"), reduce(DataFrame.unionByName, parents), deletions), "unsound"))
    reason = (
        F.when(F.col("missing"), MISSING)
        .when(F.col("created") > F.col("t"), LATE)
        .when(F.exists("gone", lambda g: (g["from"] <= F.col("t")) & (F.col("t") < g["to"])), DELETED)
    )
    return refs.join(keys, ["kind", "raw"]).select("id", "field", "kind", "t", reason.alias("reason")).where("reason is not null").dropDuplicates(["id", "field"])
