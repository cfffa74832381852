"""Totals over trailing periods for every entity and day, quiet days included.

Events are added up by entity and day first (combined within tasks), so an
entity is at most one array of its active days, however many events it has.
Entities then go through a queue made of two stacks: a push folds the day into
the back stack's total, and when the front stack is empty the back is turned
over once into running totals from its newest element. Each day costs O(1)
combines whatever the window, and no total is ever subtracted from, so minimum
and maximum work like sums. Arrow batches of entities share the day grid, so
each combine is one vector operation over the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Monoid:
    """An associative combine of vectors and its neutral element."""

    combine: Callable[[np.ndarray, np.ndarray], np.ndarray]
    neutral: int


SUM, MIN, MAX = Monoid(np.add, 0), Monoid(np.minimum, 2**63 - 1), Monoid(np.maximum, -(2**63))


def two_stack(days: np.ndarray, window: int, monoid: Monoid) -> np.ndarray:
    """Row-wise trailing aggregates of ``days`` (entities x days) over ``window`` days, each day being pushed and, once the window is full, the oldest popped."""
    n, m = days.shape
    out = np.empty_like(days)
    front: list[np.ndarray] = []
    back: list[np.ndarray] = []
    neutral = np.full(n, monoid.neutral, dtype=days.dtype)
    total = neutral
    for t in range(m):
        if t >= window:
            if not front:
                run = neutral
                while back:
                    run = monoid.combine(back.pop(), run)
                    front.append(run)
                total = neutral
            front.pop()
        back.append(days[:, t])
        total = monoid.combine(total, days[:, t])
        out[:, t] = monoid.combine(front[-1], total) if front else total
    return out


def daily(events: DataFrame, entity: str, day: str, amount: str) -> DataFrame:
    """(entity, days): one row per entity with an array of its active days: d (days since 1970), n (events), k (amounts that are not null), s, lo, hi (their sum, least and greatest in hundredths). The array is bounded by the calendar."""
    cents = (F.col(amount).cast("decimal(18,2)") * 100).cast("decimal(20,0)")
    return (
        events.where(F.col(entity).isNotNull() & F.col(day).isNotNull())
        .groupBy(F.col(entity).alias("entity"), F.unix_date(F.col(day).cast("date")).alias("d"))
        .agg(F.count(F.lit(1)).alias("n"), F.count(amount).alias("k"), F.sum(cents).cast("decimal(38,0)").alias("s"), F.min(cents).cast("bigint").alias("lo"), F.max(cents).cast("bigint").alias("hi"))
        .groupBy("entity")
        .agg(F.collect_list(F.struct("d", "n", "k", F.coalesce("s", F.lit(0)).cast("decimal(38,0)").alias("s"), "lo", "hi")).alias("days"))
    )


def rolling_totals(entities: DataFrame, key: str, days: DataFrame, first: date, last: date, windows: tuple[int, ...], measures: tuple[str, ...] = ("count", "total", "avg"), batch: int = 256) -> DataFrame:
    """(key, day, <measure>_<window>...): a row for every entity of ``entities`` (distinct keys) and every day from ``first`` to ``last``.

    ``days`` comes from daily(), its entity spelt as ``key``. Events before
    ``first`` count while they are in a window; those after ``last`` are not
    read. count is of events, total of amounts as decimal (0 without any), avg
    total by the number of amounts that are not null (null without any), min
    and max null without any. No entity gives no row.
    """
    back = max(windows)
    start, width = (first - date(1970, 1, 1)).days - back, (last - first).days + 1
    out = [pa.field("entity", pa.string()), pa.field("day", pa.date32())]
    kinds = {"count": (pa.int64(), "bigint"), "total": (pa.decimal128(38, 2), "decimal(38,2)"), "avg": (pa.float64(), "double"), "min": (pa.decimal128(20, 2), "decimal(20,2)"), "max": (pa.decimal128(20, 2), "decimal(20,2)")}
    out += [pa.field(f"{m}_{w}", kinds[m][0]) for w in windows for m in measures]
    schema = pa.schema(out)
    ddl = "entity string, day date, " + ", ".join(f"{m}_{w} {kinds[m][1]}" for w in windows for m in measures)

    def grids(b: pa.RecordBatch) -> dict[str, np.ndarray]:
        col = b.column("days")
        col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
        flat = col.flatten()
        who = col.value_parent_indices().to_numpy() if hasattr(col, "value_parent_indices") else pa.compute.list_parent_indices(col).to_numpy()
        d = flat.field("d").to_numpy(zero_copy_only=False) - start
        inside = (d >= 0) & (d < width + back)
        shape = (b.num_rows, width + back)
        got: dict[str, np.ndarray] = {}
        need = {"n": SUM, "k": SUM, "s": SUM} | ({"lo": MIN, "hi": MAX} if {"min", "max"} & set(measures) else {})
        for f, monoid in need.items():
            if f == "s":
                c = flat.field("s")  # 128-bit integers, low word first
                words = np.frombuffer(c.buffers()[1], dtype=np.int64)[2 * c.offset : 2 * (c.offset + len(c))].reshape(-1, 2) if len(c) else np.zeros((0, 2), dtype=np.int64)
                v = words[:, 0]
                if (words[:, 1] != v >> 63).any() or np.abs(v.astype(float)).sum() >= 2.0**62:
                    v = np.array([int(x) for x in c.to_pylist()], dtype=object)
            else:
                v = flat.field(f).fill_null(monoid.neutral).to_numpy(zero_copy_only=False)
            g = np.full(shape, monoid.neutral, dtype=v.dtype)
            g[who[inside], d[inside]] = v[inside]
            got[f] = g
        return got

    def decimals(v: np.ndarray, mask: np.ndarray | None, kind: pa.DataType) -> pa.Array:
        """Hundredths as decimals: 128-bit integers, low word first."""
        if v.dtype == object:
            from decimal import Decimal

            return pa.array([None if mask is not None and mask[i] else Decimal(int(x)).scaleb(-2) for i, x in enumerate(v)], type=kind)
        words = np.empty((len(v), 2), dtype=np.int64)
        words[:, 0], words[:, 1] = v, v >> 63
        bits = None if mask is None else pa.py_buffer(np.packbits(~mask, bitorder="little").tobytes())
        return pa.Array.from_buffers(kind, len(v), [bits, pa.py_buffer(words.tobytes())])

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        calendar = np.arange(width, dtype=np.int32) + np.int32(start + back)
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                b = whole.slice(at, batch)
                b = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in b.columns], schema=b.schema)
                g, cols = grids(b), {}
                for w in windows:
                    r = {f: two_stack(v, w, {"lo": MIN, "hi": MAX}.get(f, SUM))[:, back:].reshape(-1) for f, v in g.items()}
                    idle = r["k"] == 0
                    for m in measures:
                        if m == "count":
                            c = pa.array(r["n"])
                        elif m == "total":
                            c = decimals(r["s"], None, kinds[m][0])
                        elif m == "avg":
                            c = pa.array((r["s"] / 100 / np.where(idle, 1, r["k"])).astype(np.float64), mask=idle)
                        else:
                            c = decimals(r["lo" if m == "min" else "hi"], idle, kinds[m][0])
                        cols[f"{m}_{w}"] = c
                names = b.column("entity").take(pa.array(np.repeat(np.arange(b.num_rows), width)))
                yield pa.RecordBatch.from_arrays([names, pa.array(np.tile(calendar, b.num_rows), type=pa.date32()), *[cols[f.name] for f in out[2:]]], schema=schema)

    empty = F.array().cast(days.schema["days"].dataType)
    rows = entities.select(F.col(key).cast("string").alias("entity")).join(days, "entity", "left").select("entity", F.coalesce("days", empty).alias("days"))
    # a compact row opens into one per day: the number of tasks follows the entities, not these bytes, so AQE must not coalesce them
    rows = rows.repartition(int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions")), "entity")
    return rows.mapInArrow(roll, ddl).withColumnRenamed("entity", key)
