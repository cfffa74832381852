"""Mixing sources to target weights by entropy balancing.

Every document gets a rate (expected copies) between 0 and the cap R of its
mix. Among all rates that give each source its tokens, those with the least
relative entropy to even use, bounded by the cap, have the form

    r_i = R / (1 + exp(-(b + l_s t_i / m_s))),  R / (1 + exp(-b)) = size_factor,

an exponential tilt of each document's odds by its own tokens t_i (m_s is the
mean of its source): where a source needs more than even use its longer
documents are taken up first, where it needs less they give way first. The
convex dual in the l_s of all mixes is maximised by Newton steps; gradient and
curvature are sums over all documents,

    sum r_i t_i  and  sum r_i (1 - r_i / R) t_i^2,

and each step is one distributed aggregation for all mixes and sources at once,
over the documents counted by source and length. The first step starts within the
interval that one such aggregation over a grid of tilts finds; a step that leaves the
interval known to hold the optimum is replaced by its middle.

A source whose target is beyond R times its tokens has its optimum at the bound:
all its documents R times. It is reported as limited. The others then keep the
tokens of their own targets (``size="asked"``), or the whole mix shrinks until
every source that has documents meets its share (``size="met"``).

Rates are rounded to whole copies by carrying the error along the documents of
a source from the longest to the shortest, in blocks of bounded size; a block's
total misses its target by no more than about its shortest document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.keys import strip
from tessel.plans.lineage import Cut

#: Documents in a rounding block.
BLOCK = 50_000
#: Relative error of a source's tokens at which its tilt is found, and the most Newton steps.
CLOSE, STEPS = 1e-6, 60
#: Tilts, and their opposites, at which a source's tokens are taken before the first step.
GRID = 2.0 ** np.arange(-3, 7)


def source_key(c: Column) -> Column:
    """Sources compare in lower case, without surrounding white space, blanks and hyphens as underscores; null when blank."""
    s = F.regexp_replace(F.lower(strip(c)), "[\\s_-]+", "_")
    return F.when(s != "", s)


def logit(rate: np.ndarray, cap: np.ndarray) -> np.ndarray:
    share = np.clip(rate / np.maximum(cap, 1e-300), 1e-9, 1 - 1e-9)
    return np.log(share / (1 - share))


def tilts(target: np.ndarray, sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], start: np.ndarray, close: float = CLOSE, steps: int = STEPS, within: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, int]:
    """The tilts at which the first of ``sums(tilts)``, increasing with its tilt, is ``target``, the second being its derivative; and the number of steps taken. ``within`` are bounds that hold them, if known."""
    at = start.astype(float).copy()
    low, high = within or (np.full(len(at), -np.inf), np.full(len(at), np.inf))
    step = 0
    for step in range(1, steps + 1):
        value, slope = sums(at)
        gap = target - value
        if np.all(np.abs(gap) <= close * np.maximum(target, 1)):
            break
        low, high = np.where(gap > 0, np.maximum(low, at), low), np.where(gap < 0, np.minimum(high, at), high)
        move = np.clip(gap / np.maximum(slope, 1e-300), -4, 4)
        inside = (at + move > low) & (at + move < high)
        middle = np.where(np.isinf(low) | np.isinf(high), at + move, (np.where(np.isinf(low), 0, low) + np.where(np.isinf(high), 0, high)) / 2)
        at = np.where(np.abs(gap) <= close * np.maximum(target, 1), at, np.where(inside, at + move, middle))
    return at, step


def solve(tokens: np.ndarray, target: np.ndarray, cap: np.ndarray, rate: np.ndarray, steps: int = 100) -> np.ndarray:
    """Rates of sources that are one document each; at the cap where the target can't be met, 0 where it is 0."""
    out = np.where(target >= tokens * cap, cap, 0.0)
    live = (target > 0) & (target < tokens * cap)
    w, r, b = tokens[live], cap[live], logit(rate[live], cap[live])

    def sums(tilt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = r / (1 + np.exp(-(b + tilt)))
        return w * x, w * x * (1 - x / r)

    out[live] = r / (1 + np.exp(-(b + tilts(target[live], sums, np.zeros(live.sum()), 1e-9, steps)[0])))
    return out


def _rate(tokens: Column, tilt: Column, base: Column, mean: Column, cap: Column) -> Column:
    """The rate of a document of ``tokens``."""
    return cap / (1 + F.exp(-(base + tilt * tokens / mean)))


def mix(docs: DataFrame, targets: DataFrame, doc: str = "doc_id", source: str = "source", tokens: str = "tokens", size: str = "asked", cut: Cut | None = None) -> tuple[DataFrame, DataFrame]:
    """(selection, rates): selection has mix_id, source, doc, tokens, rate, copies (at least 1); rates has mix_id, source, target_share, max_repeats, size_factor, n_docs, source_tokens, mean_tokens, target_tokens, base, tilt, limited.

    Documents without a source or without tokens are in no mix, though their
    tokens count in the corpus size; ``doc`` is distinct. A listed source
    without documents is limited. Targets repeated for one mix
    and source are added up, their smallest cap holding; null shares, caps and
    factors count as 0, 0 and 1; negative ones as 0. Where ``size`` is "met" a mix is as large as its sources allow
    at their shares, at most as asked for; its size_factor is then the one reached.
    """
    if size not in ("asked", "met"):
        raise ValueError("size is asked or met")
    spark = docs.sparkSession
    cut = cut or Cut(spark)
    d = docs.select(F.col(doc).alias("doc"), source_key(F.col(source)).alias("source"), F.coalesce(F.col(tokens), F.lit(0)).cast("long").alias("tokens"))
    lengths = cut(d.where("tokens > 0").groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("k")), "lengths")
    sums = lengths.groupBy("source").agg(F.sum("k").alias("n_docs"), F.sum(F.col("k") * F.col("tokens")).alias("source_tokens"))
    zero = lambda c, v: F.greatest(F.coalesce(F.col(c), F.lit(v)), F.lit(0))
    listed = (
        targets.select("mix_id", source_key(F.col("source")).alias("source"), zero("target_share", 0.0).alias("share"), zero("max_repeats", 0).alias("cap"), zero("size_factor", 1.0).alias("factor"))
        .groupBy("mix_id", "source")
        .agg(F.sum("share").alias("target_share"), F.min("cap").alias("max_repeats"), F.max("factor").alias("size_factor"))
    )
    # the table of targets is configuration: its rows, and so the sources asked for, fit the driver
    rows = listed.join(sums, "source", "left").select("mix_id", "source", "target_share", "max_repeats", "size_factor", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("source_tokens", F.lit(0)).alias("source_tokens")).collect()
    corpus = (sums.agg(F.sum("source_tokens")).first()[0] or 0) if rows else 0
    col = lambda k: np.array([float(r[k]) for r in rows])
    share, cap, have, n_docs, factor = (col(k) for k in ("target_share", "max_repeats", "source_tokens", "n_docs", "size_factor"))
    if size == "met":
        for m in {r["mix_id"] for r in rows}:
            of = np.array([r["mix_id"] == m for r in rows])
            asked = of & (share > 0) & (have * cap > 0)
            if asked.any():
                factor[of] = np.minimum(factor[of], (have[asked] * cap[asked] / share[asked]).min() / corpus)
    goal = share * factor * corpus
    full = have * cap
    limited = goal > full * (1 + 1e-9)
    mean, base = have / np.maximum(n_docs, 1), logit(factor, cap)
    live = (goal > 0) & (goal < full * (1 - 1e-9))
    tilt = np.where(goal > 0, np.inf, -np.inf)
    told = "mix_id string, source string, target_share double, max_repeats int, size_factor double, n_docs long, source_tokens long, mean_tokens double, target_tokens double, base double, tilt double, limited boolean"

    def table(tilt: np.ndarray) -> DataFrame:
        cols = zip(rows, factor, mean, goal, base, tilt, limited, strict=True)
        return spark.createDataFrame([(r["mix_id"], r["source"], float(r["target_share"]), int(r["max_repeats"]), float(f), r["n_docs"], r["source_tokens"], float(m), float(g), float(b), float(t), bool(x)) for r, f, m, g, b, t, x in cols], told)

    rate = F.when(F.col("tilt") == float("inf"), F.col("max_repeats").cast("double")).otherwise(_rate(F.col("tokens"), F.col("tilt"), F.col("base"), F.col("mean_tokens"), F.col("max_repeats")))
    if live.any():
        # documents counted by length, once for each target that asks for their source; a step then needs the tilts alone, a number a target
        which = np.flatnonzero(live)
        asked = spark.createDataFrame([(rows[i]["source"], int(k), float(base[i]), float(mean[i]), float(cap[i])) for k, i in enumerate(which)], "source string, i int, base double, mean_tokens double, max_repeats double")
        counted = cut(lengths.join(F.broadcast(asked), "source").drop("source"), "targets")

        def moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            tilt_ = F.element_at(F.array(*[F.lit(float(t)) for t in x]), F.col("i") + 1)
            taken = F.col("k") * F.col("tokens") * _rate(F.col("tokens"), tilt_, F.col("base"), F.col("mean_tokens"), F.col("max_repeats"))
            got = counted.select("i", "tokens", "mean_tokens", "max_repeats", taken.alias("v"), F.col("k").alias("n")).groupBy("i").agg(F.sum("v").alias("v"), F.sum(F.col("v") * (1 - F.col("v") / (F.col("n") * F.col("tokens") * F.col("max_repeats"))) * F.col("tokens") / F.col("mean_tokens")).alias("s"))
            value, slope = np.zeros(len(x)), np.zeros(len(x))
            for r in got.collect():
                value[r["i"]], slope[r["i"]] = r["v"], r["s"]
            return value, slope

        # one aggregation over a coarse grid brackets each tilt; Newton starts between
        grid = np.sort(np.concatenate([-GRID, [0.0], GRID]))
        tries = counted.select("*", F.posexplode(F.array(*[F.lit(float(t)) for t in grid])).alias("j", "t"))
        taken = F.col("k") * F.col("tokens") * _rate(F.col("tokens"), F.col("t"), F.col("base"), F.col("mean_tokens"), F.col("max_repeats"))
        value = np.zeros((len(which), len(grid)))
        for r in tries.groupBy("i", "j").agg(F.sum(taken).alias("v")).collect():  # a row a target and grid point
            value[r["i"], r["j"]] = r["v"]
        above = (value < goal[live][:, None]).sum(1)
        edges = np.concatenate([[-np.inf], grid, [np.inf]])
        low, high = edges[above], edges[above + 1]
        one = np.arange(len(which))
        lo, hi = value[one, np.clip(above - 1, 0, len(grid) - 1)], value[one, np.clip(above, 0, len(grid) - 1)]
        share = np.clip((goal[live] - lo) / np.maximum(hi - lo, 1e-300), 0, 1)
        start = np.where(np.isinf(low), grid[0], np.where(np.isinf(high), grid[-1], np.where(np.isinf(low), 0, low) + share * (np.where(np.isinf(high), 0, high) - np.where(np.isinf(low), 0, low))))
        tilt[live] = tilts(goal[live], moments, start, within=(low, high))[0]
    rates = table(tilt)

    def rounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, carry = None, 0.0
        for b in batches:
            keys = list(zip(b.column("mix_id").to_pylist(), b.column("source").to_pylist(), b.column("block").to_pylist(), strict=True))
            size, rate, cap = b.column("tokens").to_pylist(), b.column("rate").to_pylist(), b.column("max_repeats").to_pylist()
            copies = []
            for k, t, r, most in zip(keys, size, rate, cap, strict=True):
                if k != at:
                    at, carry = k, 0.0
                carry += r * t
                n = min(most, max(0, int(carry / t + 0.5)))
                carry -= n * t
                copies.append(n)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("mix_id", "source", "doc", "tokens", "rate")], pa.array(copies, pa.int32())], names=["mix_id", "source", "doc", "tokens", "rate", "copies"])

    wanted = rates.where(F.col("tilt") > float("-inf")).where("max_repeats > 0").withColumn("blocks", F.ceil(F.col("n_docs") / BLOCK).cast("int"))
    rows_ = d.where("tokens > 0").join(F.broadcast(wanted), "source").select("mix_id", "source", "doc", "tokens", "max_repeats", rate.alias("rate"), F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int").alias("block"))
    kind = docs.schema[doc].dataType.simpleString()
    chosen = (
        rows_.repartition("mix_id", "source", "block")
        .sortWithinPartitions("mix_id", "source", "block", F.col("tokens").desc(), "doc")
        .mapInArrow(rounded, f"mix_id string, source string, doc {kind}, tokens bigint, rate double, copies int")
        .where("copies > 0")
    )
    return chosen.withColumnRenamed("doc", doc), rates
