"""Filling containers of fixed capacity with items of varying length.

The items are reduced to a histogram of lengths, which has at most ``capacity``
entries however many items there are, and the configuration linear program

    min sum x_p  subject to  sum_p a_pl x_p >= n_l for every length l

is solved over it by multiplicative weights: every length has a price that
falls exponentially with its coverage; each round a bounded knapsack dynamic
program prices out the configuration worth most (first over the lengths that lag
most, over all where these fill no container), and its x_p grows by the largest
step that covers a fixed share of a length's demand, one container at least. The
fractional x_p are then rounded down. What that cuts off, less than one
container a configuration and less than one item a length, is packed by the same
pricing in whole containers. A step covers STEP of some length's demand or
leaves less than one item of it, so configurations are at most about nine times
the capacity, whatever the number of items, and so is the remainder. The
program's dual gives a bound to compare the containers with; while they are not
close to it, prices grow by the room that lengths were left with, and the program
is solved again from these, the best solution being kept. Every item then
finds its container from its place within its length by binary search over the
runs of the solution.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.operators.ranking import ranks_in_groups
from tessel.plans.lineage import Cut
from tessel.plans.sized import small_side

#: Share of a length's items that one step may cover, and how strongly prices follow coverage and, at first, length. Weak prices: where they swing by more than a few per cent between rounds, containers are left unfilled for a dearer item.
STEP, ETA, LONG = 0.125, 0.25, 0.3
#: Passes at most, how strongly prices follow the room that a length was packed with in the pass before, and the gap to the bound (with less than one container) at which no other pass is made.
PASSES, PULL, GAP = 8, 0.5, 0.001
#: Lengths that a round prices first: the fewest, and the product with the capacity, as a small container holds few items and needs more lengths to choose from.
FIRST, FIRST_TOKENS = 64, 131_072


def price_out(lengths: np.ndarray, worth: np.ndarray, limit: np.ndarray, capacity: int, exact: bool = False) -> np.ndarray:
    """Bounded knapsack by dynamic programming: how many of each of ``lengths``, at most ``limit``, the container worth most holds; with ``exact``, the one worth most of those filled to the last token, none if there is none. Multiples are split into powers of two."""
    value, tmp = np.full(capacity + 1, -np.inf if exact else 0.0), np.empty(capacity + 1)
    value[0] = 0.0
    items: list[tuple[int, int, int, float]] = []
    for i, (k, w, n) in enumerate(zip(lengths.tolist(), worth.tolist(), np.minimum(limit, capacity // lengths).tolist(), strict=True)):
        a = 1
        while n > 0:
            m = min(a, n)
            n -= m
            a *= 2
            items.append((i, m, m * k, m * w))
    better = np.empty((len(items), capacity + 1), dtype=bool)
    add, greater, maximum, end = np.add, np.greater, np.maximum, capacity + 1
    for row, (_, _, size, gain) in zip(better, items, strict=True):
        with_, without = tmp[: end - size], value[size:]
        add(value[: end - size], gain, out=with_)
        greater(with_, without, out=row[size:])
        maximum(without, with_, out=without)
    held, c = np.zeros(len(lengths), dtype=np.int64), capacity
    if value[c] == -np.inf:
        return held
    for at in range(len(items) - 1, -1, -1):
        i, m, size, _ = items[at]
        if c >= size and better[at, c]:
            held[i] += m
            c -= size
    return held


def _worth(price: np.ndarray, share: np.ndarray) -> np.ndarray:
    """What lengths of a ``price`` are worth while ``share`` of their items is left."""
    return price * np.exp(ETA * (share - share.mean()))


@dataclass
class Solution:
    """Containers over a histogram of lengths: ``runs`` of (times, {length: how many}), of which the first ``n_relaxed`` come from rounding the linear program down and the others from its remainder; ``bound`` is a number of containers below which no packing gets."""

    runs: list[tuple[int, dict[int, int]]]
    n_relaxed: int
    bound: int

    @property
    def containers(self) -> int:
        return sum(t for t, _ in self.runs)

    @property
    def relaxed_items(self) -> int:
        """Items that the linear program, rounded down, has placed."""
        return sum(t * sum(c.values()) for t, c in self.runs[: self.n_relaxed])


def _round(lengths: np.ndarray, price: np.ndarray, demand: np.ndarray, rest: np.ndarray, whole: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(lengths' places, how many of each) of the configuration worth most at the prices of what is left, from ``whole`` items of each length at most."""
    open_ = np.flatnonzero(whole)
    share = rest[open_] / demand[open_]
    first = max(FIRST, FIRST_TOKENS // capacity)
    held = np.zeros(0, dtype=np.int64)
    if len(open_) > first:
        # partial pricing: of each of first ranges of lengths the one that lags most, for a full container; if these have none, all lengths are priced
        edges = np.arange(first + 1) * len(open_) // first
        some = np.lexsort((-share, np.repeat(np.arange(first), np.diff(edges))))[edges[:-1]]
        held = price_out(lengths[open_[some]], _worth(price[open_[some]], share[some]), whole[open_[some]], capacity, exact=True)
    if held.any():
        open_ = open_[some]
    else:
        held = price_out(lengths[open_], _worth(price[open_], share), whole[open_], capacity)
    return open_[held > 0], held[held > 0]


def relax(lengths: np.ndarray, price: np.ndarray, demand: np.ndarray, capacity: int) -> dict[tuple[tuple[int, int], ...], float]:
    """How often each configuration, as ((length, how many), ...), is taken by a fractional solution of the program that covers each length but for less than one item."""
    rest, taken = demand.astype(float), {}
    while (whole := np.floor(rest + 1e-9).astype(np.int64).clip(0)).any():
        used, held = _round(lengths, price, demand, rest, whole, capacity)
        step = float(min((rest[used] / held).min(), max(1.0, (STEP * demand[used] / held).min())))
        rest[used] -= step * held
        key = tuple(zip(lengths[used].tolist(), held.tolist(), strict=True))
        taken[key] = taken.get(key, 0.0) + step
    return taken


def dual_value(lengths: np.ndarray, price: np.ndarray, demand: np.ndarray, capacity: int) -> float:
    """The dual's value at prices made feasible by the configuration worth most at them."""
    top = float(price_out(lengths, price, np.minimum(demand, capacity // lengths), capacity) @ price)
    return float(demand @ price) / top if top > 0 else 0.0


def dual_bound(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> float:
    """The best dual value at some fixed prices: the length, lengths above a half of the capacity as containers of their own, and thirds."""
    part = lengths / capacity
    fixed = (part, np.where(part > 0.5, 1.0, np.where(part == 0.5, 0.5, 0.0)), np.floor(3 * part + 1e-12) / 3, np.floor(3 * part + 1e-12).clip(0, 2) / 2)
    return max(dual_value(lengths, price, demand, capacity) for price in fixed)


def _pass(lengths: np.ndarray, price: np.ndarray, demand: np.ndarray, capacity: int) -> Solution:
    """The program solved from starting prices, and rounded."""
    runs, rest = [], demand.copy()
    place = {k: i for i, k in enumerate(lengths.tolist())}
    for held, x in relax(lengths, price, demand, capacity).items():
        times = min(int(x + 1e-9), *(int(rest[place[k]]) // n for k, n in held))  # sums of very large counts are off by an item
        if times:
            runs.append((times, dict(held)))
            for k, n in held:
                rest[place[k]] -= times * n
    relaxed = len(runs)
    # the remainder: what rounding down has cut off, less than one container a configuration, and what the relaxation leaves, less than one item a length
    while rest.any():
        used, held = _round(lengths, price, demand, rest, rest, capacity)
        times = int((rest[used] // held).min())
        rest[used] -= times * held
        runs.append((times, dict(zip(lengths[used].tolist(), held.tolist(), strict=True))))
    return Solution(runs, relaxed, 0)


def solve(histogram: dict[int, int], capacity: int) -> Solution:
    """Containers for lengths 1..capacity that hold every item exactly once."""
    lengths = np.array(sorted(k for k, n in histogram.items() if n > 0), dtype=np.int64)
    demand = np.array([histogram[int(k)] for k in lengths], dtype=np.int64)
    if not len(lengths):
        return Solution([], 0, 0)
    place = {k: i for i, k in enumerate(lengths.tolist())}
    price = lengths / capacity * np.exp(LONG * lengths / capacity)
    best, bound = None, dual_bound(lengths, demand, capacity)
    for _ in range(PASSES):
        got = _pass(lengths, price, demand, capacity)
        if best is None or got.containers < best.containers:
            best = got
        bound = max(bound, dual_value(lengths, price, demand, capacity))
        least = math.ceil(bound - 1e-6)
        if best.containers <= least + max(0.5, GAP * least):
            break
        lost = np.zeros(len(lengths))
        for times, held in got.runs:
            room = 1 - sum(k * n for k, n in held.items()) / capacity
            for k, n in held.items():
                lost[place[k]] += times * n * room
        price = price * np.exp(PULL * lost / demand)
    return Solution(best.runs, best.n_relaxed, math.ceil(bound - 1e-6))


def configurations(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: how many}) of the solution."""
    return solve(histogram, capacity).runs


def pack_all(items: DataFrame, item: str, tokens: str, capacities: list[int], cut: Cut | None = None) -> dict[int, tuple[DataFrame, Solution, int]]:
    """For each capacity the rows of ``pack``, the solution for its containers, and the number of containers that full parts of long items take besides.

    Items are ranked once, within their length; a capacity folds the lengths
    that leave the same last part, whose items follow one another by length.
    """
    if any(c < 1 for c in capacities):
        raise ValueError("capacity must be positive")
    spark = items.sparkSession
    cut = cut or Cut(spark)
    n = F.greatest(F.coalesce(F.col(tokens), F.lit(0)), F.lit(0)).cast("long")
    base = items.select(F.col(item).alias("item"), n.alias("n"))
    ranked = cut(ranks_in_groups(base, ["n"], ["item"], "place", cut), "places")
    counts = cut(ranked.groupBy("n").agg(F.count(F.lit(1)).alias("k")), "lengths")  # one row a length
    folded = {c: _fold(counts, c, cut) for c in capacities}
    solved = solve_all(spark, {c: {int(r["last"]): int(r["k"]) for r in rows if r["last"] > 0} for c, (_, rows) in folded.items()})
    return {c: _placed(ranked, *folded[c], solved[c], item, c) for c in capacities}


def solve_all(spark: SparkSession, histograms: dict[int, dict[int, int]]) -> dict[int, Solution]:
    """The solution for each capacity, each a task of its own."""
    kinds = "capacity long, n_relaxed long, bound long, times array<long>, lengths array<array<long>>, held array<array<long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(c, solve(dict(zip(k, n, strict=True)), c)) for c, k, n in zip(*(b.column(x).to_pylist() for x in ("capacity", "k", "n")), strict=True)]
            many = pa.list_(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    *[pa.array(x, pa.int64()) for x in ([c for c, _ in got], [s.n_relaxed for _, s in got], [s.bound for _, s in got])],
                    pa.array([[t for t, _ in s.runs] for _, s in got], pa.list_(pa.int64())),
                    *[pa.array([[list(f(h)) for _, h in s.runs] for _, s in got], many) for f in (dict.keys, dict.values)],
                ],
                names=["capacity", "n_relaxed", "bound", "times", "lengths", "held"],
            )

    asked = spark.createDataFrame([(c, list(h), list(h.values())) for c, h in histograms.items()], "capacity long, k array<long>, n array<long>")
    rows = asked.mapInArrow(run, kinds).collect()  # bounded by the capacities
    return {r["capacity"]: Solution([(t, dict(zip(k, n, strict=True))) for t, k, n in zip(r["times"], r["lengths"], r["held"], strict=True)], r["n_relaxed"], r["bound"]) for r in rows}


def _fold(counts: DataFrame, capacity: int, cut: Cut) -> tuple[DataFrame, list]:
    """For each length its last part, full parts, and what precedes it among those with the same last part; and the sums by last part, at most capacity + 1 rows."""
    last = F.when(F.col("n") > 0, (F.col("n") - 1) % capacity + 1).otherwise(0).cast("long")
    before = Window.partitionBy("last").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long")
    folded = counts.withColumn("last", last).withColumn("full", ((F.col("n") - F.col("last")) / capacity).cast("long"))
    folded = cut(folded.withColumn("before", earlier("k")).withColumn("full_before", earlier(F.col("k") * F.col("full"))), "folded")
    return folded, folded.groupBy("last").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("full")).alias("full")).orderBy("last").collect()


def _placed(ranked: DataFrame, folded: DataFrame, rows: list, solution: Solution, item: str, capacity: int) -> tuple[DataFrame, Solution, int]:
    spark = ranked.sparkSession
    empty = any(r["last"] == 0 for r in rows)
    runs: dict[int, list[tuple[int, int, int]]] = {}
    done: dict[int, int] = {}
    container = 0
    for times, held in solution.runs:
        for length, a in held.items():
            runs.setdefault(length, []).append((done.get(length, 0), a, container))
            done[length] = done.get(length, 0) + times * a
        container += times
    if empty:
        runs[0], container = [(0, 2**62, 0)], max(container, 1)
    # bounded by the capacity: as many runs as the solution has, each of at most capacity entries
    table = spark.sparkContext.broadcast({k: tuple(np.array(x, dtype=np.int64) for x in zip(*v, strict=True)) for k, v in runs.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            last, at = b.column("last").to_numpy(), b.column("place").to_numpy()
            to = np.empty(len(last), dtype=np.int64)
            order = np.argsort(last, kind="stable")
            bounds = np.flatnonzero(np.diff(last[order], prepend=-1))
            for lo, hi in zip(bounds, [*bounds[1:], len(order)], strict=True):
                chosen = order[lo:hi]
                start, each, first = table.value[int(last[chosen[0]])]
                k = np.searchsorted(start, at[chosen], side="right") - 1
                to[chosen] = first[k] + (at[chosen] - start[k]) // each[k]
            yield pa.RecordBatch.from_arrays([b.column("item"), b.column("full"), b.column("last"), pa.array(to)], names=["item", "part", "tokens", "container"])

    kind = ranked.schema["item"].dataType.simpleString()
    sized = ranked.join(small_side(folded).drop("k"), "n")
    ends = sized.select("item", "full", "last", (F.col("place") + F.col("before")).alias("place")).mapInArrow(place, f"item {kind}, part bigint, tokens bigint, container bigint")
    full = sum(int(r["full"]) for r in rows)
    if full:
        # full parts follow the other containers, by last part, length and place
        starts, at = [], container
        for r in rows:
            starts.append((int(r["last"]), at))
            at += int(r["full"])
        first = F.col("start") + F.col("full_before") + F.col("place") * F.col("full")
        long_ = sized.where("full > 0").join(F.broadcast(spark.createDataFrame(starts, "last long, start long")), "last").withColumn("first", first)
        filled = long_.select("item", F.explode(F.expr("sequence(0L, full - 1)")).alias("part"), F.lit(capacity).cast("long").alias("tokens"), "first")
        ends = ends.unionByName(filled.select("item", "part", "tokens", (F.col("first") + F.col("part")).alias("container")))
    return ends.withColumnRenamed("item", item), solution, full


def pack(items: DataFrame, item: str, tokens: str, capacity: int, cut: Cut | None = None) -> DataFrame:
    """(item, part, tokens, container): each item of up to ``capacity`` tokens in one container (part 0); a longer one in parts, of which all but the last fill a container each.

    ``item`` is distinct. Items without tokens take no room and lie in
    container 0. No items give no rows. Null and negative tokens count as none.
    """
    return pack_all(items, item, tokens, [capacity], cut)[capacity][0]
