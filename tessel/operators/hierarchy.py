"""Parent-child links to full hierarchies by heavy-path decomposition.

Everything runs as joins and aggregations on slim integer columns keyed by
(group, node), so neither one huge tree nor one huge group of siblings has to
fit in a task:

1. links are resolved to one parent per node;
2. *climbing* (pointer doubling) finds depth, root and subtree size in
   log2(depth) rounds, and leaves exactly the nodes whose walk never ends;
3. each inner node's child with the largest subtree is heavy; heavy edges form
   chains, labelled by climbing along them alone;
4. a chain's ancestor chains number at most log2(n), so the preorder number of
   every chain head and the list of chain segments above it come from one more
   short climb over the tree of chains;
5. a path is the segments above the chain plus the chain up to the node, and
   the descendants of a node are one interval of preorder numbers, in which
   every chain is contiguous.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.plans.lineage import Cut

TREE, LOOP, INTO_LOOP = "tree", "loop", "into_loop"


def resolve_links(nodes: DataFrame, group: str, node: str, parent: str, children: str | None) -> DataFrame:
    """(g, v, p): one row per node, p null for roots and where the parent has no row.

    The stated parent counts; where it is null, the smallest node whose child
    list holds the node. Repeated rows count once; rows that contradict each
    other give the smallest stated parent. Rows without group or node are no
    nodes and give no row.
    """
    g, v, p = F.col(group).alias("g"), F.col(node).cast("long").alias("v"), F.col(parent).cast("long").alias("p")
    none = F.lit(None).cast("long")
    rows = nodes.select(g, v, p, none.alias("claim"), F.lit(1).alias("row"))
    if children:
        rows = rows.unionByName(
            nodes.where(F.col(node).isNotNull())
            .select(g, F.explode(F.col(children).cast("array<bigint>")).alias("v"), none.alias("p"), F.col(node).cast("long").alias("claim"), F.lit(0).alias("row"))
        )
    one = (
        rows.where("g is not null and v is not null")
        .groupBy("g", "v")
        .agg(F.coalesce(F.min("p"), F.min("claim")).alias("p"), F.max("row").alias("row"))
        .where("row = 1")
        .drop("row")
    )
    return one


def _end_missing(links: DataFrame) -> DataFrame:
    """Parents without a row of their own become null; nulls take no part in the join, so they can't pile up in one task."""
    there = links.select("g", F.col("v").alias("p"))
    kept = links.where("p is not null").join(there, ["g", "p"], "left_semi").select("g", "v", "p")
    has = kept.select("g", "v", "p")
    return links.select("g", "v").join(has, ["g", "v"], "left")


def climb(links: DataFrame, cut: Cut, weight: str = "w", sizes: bool = False, trail: str | None = None) -> DataFrame:
    """Pointer doubling over (g, v, p, weight): adds top (the last ancestor), dist (weights summed up to it), and on request size (nodes below, with itself) and the concatenated arrays ``trail`` of the node's ancestors, root side first.

    A row whose jump is not null after the last round has a walk that never
    ends. Rounds stop once one ends no walk: a finite walk of 2^k steps or more
    passes a node whose walk has exactly 2^k, which the next round would end.
    """
    state = links.select(
        "g", "v", F.col("p").alias("jump"), F.coalesce("p", "v").alias("top"),
        F.when(F.col("p").isNull(), F.lit(0).cast("long")).otherwise(F.col(weight).cast("long")).alias("dist"),
        *([F.lit(1).cast("decimal(38,0)").alias("size")] if sizes else []),
        *([F.col(trail).alias("trail")] if trail else []),
    )
    walks = F.count_if(F.col("jump").isNotNull())
    state, left = cut.counted(state, "climb", walks)
    while left:
        walking, ended = state.where("jump is not null"), state.where("jump is null")
        over = state.select(
            "g", F.col("v").alias("jump"), F.col("jump").alias("jump2"), F.col("top").alias("top2"), F.col("dist").alias("dist2"),
            *([F.col("trail").alias("trail2")] if trail else []),
        )
        moved = walking.join(over, ["g", "jump"]).select(
            "g", "v", F.col("jump2").alias("jump"), F.col("top2").alias("top"), (F.col("dist") + F.col("dist2")).alias("dist"),
            *(["size"] if sizes else []),
            *([F.concat("trail2", "trail").alias("trail")] if trail else []),
        )
        new = moved.unionByName(ended)
        if sizes:
            below = walking.groupBy("g", F.col("jump").alias("v")).agg(F.sum("size").alias("more"))
            new = new.join(below, ["g", "v"], "left").withColumn("size", (F.col("size") + F.coalesce("more", F.lit(0))).cast("decimal(38,0)")).drop("more")
        before = left
        new, left = cut.counted(new, "climb", walks)
        cut.free(state)
        state = new
        if left == before:
            break
    return state


def _loops(walking: DataFrame, links: DataFrame, cut: Cut) -> DataFrame:
    """(g, v, status) of the nodes whose walk never ends. The images of ever longer jumps shrink to the nodes on the loops, and stop shrinking only there."""
    state = cut(walking.select("g", "v").join(links, ["g", "v"]).select("g", "v", F.col("p").alias("jump")), "loop")
    size, before = state.select("g", "jump").distinct().count(), -1
    while size != before:
        new = cut(state.join(state.select("g", F.col("v").alias("jump"), F.col("jump").alias("far")), ["g", "jump"]).select("g", "v", F.col("far").alias("jump")), "loop")
        cut.free(state)
        state, before = new, size
        size = state.select("g", "jump").distinct().count()
    on = state.select("g", F.col("jump").alias("v")).distinct().withColumn("on", F.lit(True))
    return state.select("g", "v").join(on, ["g", "v"], "left").select("g", "v", F.when(F.col("on"), LOOP).otherwise(INTO_LOOP).alias("status"))


def _before(siblings: DataFrame, cut: Cut) -> DataFrame:
    """(g, v, p, size) -> (g, v, before): sizes of the siblings with a smaller v, summed. A prefix sum in two levels over range partitions, so that one parent's children can lie in many tasks."""
    parts = cut(siblings.repartitionByRange("g", "p", "v").withColumn("part", F.spark_partition_id()), "siblings")
    inside = Window.partitionBy("part", "g", "p").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("g", "p").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    whole = parts.groupBy("g", "p", "part").agg(F.sum("size").alias("all")).select("g", "p", "part", F.coalesce(F.sum("all").over(across), zero).alias("base"))
    return parts.withColumn("within", F.coalesce(F.sum("size").over(inside), zero)).join(whole, ["g", "p", "part"]).select("g", "v", (F.col("base") + F.col("within")).cast("long").alias("before"))


class Hierarchy:
    """The labelled forest of a table of links.

    ``nodes``: g, v, status (tree, loop, into_loop) and, for tree nodes, p,
    depth (0 at a root), root, size (descendants and itself), head (of the
    chain), at (place in the chain), pre (preorder number within the root's
    tree, from 0); all null for nodes in or above a loop. ``chains``: g, head,
    root, pre and above, the segments (head, last place) from the root down to
    the chain. An empty table gives empty frames. The columns of the input other
    than those named are never read, so their names can't clash.
    """

    def __init__(self, nodes: DataFrame, group: str = "file_id", node: str = "node_index", parent: str = "parent_index", children: str | None = "children_indices"):
        spark = nodes.sparkSession
        cut = self.cut = Cut(spark)
        stated = cut(resolve_links(nodes, group, node, parent, children), "stated")
        links = cut(_end_missing(stated), "links")
        cut.free(stated)
        up = climb(links.withColumn("w", F.lit(1)), cut, sizes=True)
        walking = up.where("jump is not null")
        lost = cut(_loops(walking, links, cut), "lost")
        tree = cut(
            links.join(up.where("jump is null").select("g", "v", F.col("top").alias("root"), F.col("dist").alias("depth"), F.col("size").cast("long").alias("size")), ["g", "v"]),
            "tree",
        )
        cut.free(links, up)
        best = tree.where("p is not null").groupBy("g", "p").agg(F.max(F.struct("size", (-F.col("v")).alias("v"))).alias("best"))
        heavy = best.select("g", (-F.col("best.v")).alias("v"), F.lit(True).alias("heavy"), F.col("best.size").alias("heavy_size"))
        marked = cut(tree.join(heavy, ["g", "v"], "left"), "marked")
        along = climb(marked.select("g", "v", F.when(F.col("heavy"), F.col("p")).alias("p"), F.lit(1).alias("w")), cut)
        labelled = cut(marked.join(along.select("g", "v", F.col("top").alias("head"), F.col("dist").alias("at")), ["g", "v"]), "labelled")
        cut.free(tree, along)
        # the tree of chains: a light head hangs off a place in its parent's chain
        light = labelled.where("heavy is null and p is not null").select("g", "v", "p", "size")
        spot = labelled.select("g", F.col("v").alias("p"), F.col("head").alias("up"), F.col("at").alias("exit"))
        first = marked.where("heavy").select("g", "p", "heavy_size")
        hung = (
            light.join(_before(light, cut), ["g", "v"])
            .join(spot, ["g", "p"])
            .join(first, ["g", "p"])
            .select("g", "v", F.col("up").alias("p"), (F.col("exit") + 1 + F.col("heavy_size") + F.col("before")).alias("w"), F.array(F.struct(F.col("up").alias("head"), F.col("exit").alias("last"))).alias("seg"))
        )
        none = F.array().cast("array<struct<head:bigint,last:bigint>>")
        tops = labelled.where("p is null").select("g", "v", F.lit(None).cast("long").alias("p"), F.lit(0).cast("long").alias("w"), none.alias("seg"))
        chains = climb(hung.unionByName(tops), cut, trail="seg")
        self.chains = chains.select("g", F.col("v").alias("head"), F.col("top").alias("root"), F.col("dist").alias("pre"), F.col("trail").alias("above"))
        sound = labelled.join(self.chains.select("g", "head", F.col("pre").alias("head_pre")), ["g", "head"]).select(
            "g", "v", F.lit(TREE).alias("status"), "p", "depth", "root", "size", "head", "at", (F.col("head_pre") + F.col("at")).alias("pre")
        )
        self.nodes = cut(sound.unionByName(lost, allowMissingColumns=True), "nodes")
        cut.free(marked, labelled, lost)

    def paths(self) -> DataFrame:
        """(g, v, path): the node numbers from the root to the node, by concatenating chain segments."""
        tree = self.nodes.where(F.col("status") == TREE)
        members = tree.groupBy("g", "head").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("chain"))
        piece = (
            self.chains.select("g", F.col("head").alias("below"), F.posexplode("above").alias("k", "s"))
            .select("g", "below", "k", F.col("s.head").alias("head"), F.col("s.last").alias("last"))
            .join(members, ["g", "head"])
            .select("g", F.col("below").alias("head"), F.struct("k", F.expr("slice(chain, 1, cast(last + 1 as int))").alias("part")).alias("piece"))
        )
        above = piece.groupBy("g", "head").agg(F.flatten(F.transform(F.array_sort(F.collect_list("piece")), lambda x: x["part"])).alias("above"))
        whole = members.join(above, ["g", "head"], "left")
        return tree.select("g", "v", "head", "at").join(whole, ["g", "head"]).select("g", "v", F.expr("concat(coalesce(above, array()), slice(chain, 1, cast(at + 1 as int)))").alias("path"))

    def descendants(self, block: int = 4096) -> DataFrame:
        """(g, v, descendant): each node's interval of preorder numbers, opened in blocks and joined on equality."""
        tree = self.nodes.where(F.col("status") == TREE)
        opened = (
            tree.where("size > 1")
            .select("g", "root", "v", "pre", "size", F.explode(F.expr(f"sequence(pre + 1, pre + size - 1, {block}L)")).alias("from"))
            .select("g", "root", "v", F.explode(F.expr(f"sequence(from, least(from + {block - 1}, pre + size - 1))")).alias("pre"))
        )
        return opened.join(tree.select("g", "root", "pre", F.col("v").alias("descendant")), ["g", "root", "pre"]).select("g", "v", "descendant")
