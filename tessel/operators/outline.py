"""Outline text to trees: typed lines, nodes, parents, paths, leaves, statistics.

A document is one row, so windows by document are bounded by it; all of this is
window expressions over its lines in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions.text import is_table_header, is_table_line, table_cells
from tessel.plans.lineage import Cut

PARAGRAPH_LEVEL = 999


def outline_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line, kind, level, content): lines of ``Heading n: title``, ``Paragraph: text`` or other text; blank ones are left out. Headings may carry leading # marks."""
    at = docs.select(F.col(doc).alias("doc_id"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\\r?\\n")).alias("line", "raw"))
    raw = F.trim(F.regexp_replace("raw", "^[\\s　]+|[\\s　]+$", ""))
    head = "^(?:#+\\s*)?Heading\\s*(\\d+)\\s*:\\s*(.*)$"
    level = F.coalesce(F.regexp_extract("s", head, 1).try_cast("int"), F.lit(2**31 - 1))
    return (
        at.withColumn("s", raw)
        .where("s <> ''")
        .select(
            "doc_id", "line",
            F.when(F.col("s").rlike(head), "heading").when(F.col("s").startswith("Paragraph:"), "paragraph").otherwise("other").alias("kind"),
            F.when(F.col("s").rlike(head), level).alias("level"),
            F.when(F.col("s").rlike(head), F.regexp_extract("s", head, 2)).otherwise(F.trim(F.regexp_replace("s", "^Paragraph:", ""))).alias("content"),
        )
    )


def content_lines(lines: DataFrame) -> DataFrame:
    """Lines with content that don't start with Outline."""
    return lines.where((F.col("content") != "") & ~F.col("content").startswith("Outline"))


def outline_nodes(docs: DataFrame, doc: str = "doc_id", text: str = "text", paths: bool = False) -> DataFrame:
    """(doc_id, node_idx, parent_idx, level, node_type, text, tables), and path_titles if ``paths``.

    Node 0 is the root. Every heading is a node; a paragraph line opens a
    paragraph node, to which other lines are added; text before any heading and
    behind the last one is kept. Runs of piped lines are tables of the node
    before them. A heading's parent is the nearest heading before it of a lower
    level, a paragraph's the last heading, else the root. An empty document is a
    root alone; one without headings has its whole text in the root.
    """
    w = Window.partitionBy("doc_id").orderBy("line")
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    lines = outline_lines(docs, doc, text).withColumn("table", (F.col("kind") != "heading") & is_table_line(F.col("content")))
    lines = lines.withColumn("headed", F.max(F.col("kind") == "heading").over(Window.partitionBy("doc_id")))
    opens = F.col("headed") & ((F.col("kind") == "heading") | (~F.col("table") & ((F.col("kind") == "paragraph") | (F.coalesce(F.lag("kind").over(w), F.lit("")).isin("heading", "")))))
    lines = lines.withColumn("node_idx", F.sum(F.when(opens, 1).otherwise(0)).over(before).cast("int"))
    lines = lines.withColumn("run", F.sum(F.when(F.col("table") & ~F.coalesce(F.lag("table").over(w), F.lit(False)), 1).otherwise(0)).over(before))
    row = F.struct("line", F.when(~F.col("table"), F.col("content")).alias("content"))
    body = lines.groupBy("doc_id", "node_idx").agg(
        F.max("level").alias("head_level"),
        F.array_sort(F.collect_list(row)).alias("rows"),
        F.array_sort(F.collect_list(F.when(F.col("table"), F.struct("run", "line", table_cells(F.col("content")).alias("cells"))))).alias("cells"),
    )
    runs = F.array_sort(F.array_distinct(F.transform("cells", lambda x: x["run"])))
    rows_of = lambda r: F.transform(F.filter("cells", lambda x: x["run"] == r), lambda x: x["cells"])
    tables = F.transform(runs, lambda r: F.struct(rows_of(r).alias("rows"), is_table_header(F.get(rows_of(r), F.lit(0))).alias("has_header"), F.lit("after").alias("position")))
    body = body.select("doc_id", "node_idx", "head_level", F.array_join(F.transform("rows", lambda x: x["content"]), "\n").alias("text"), tables.alias("tables"))
    roots = docs.select(F.col(doc).alias("doc_id"), F.lit(0).alias("node_idx")).distinct()
    nodes = roots.join(body, ["doc_id", "node_idx"], "left").unionByName(body.where("node_idx > 0"), allowMissingColumns=True)
    # all of a document's nodes in one array: windows, groups and fold share the partitioning by document
    rows = F.array_sort(F.collect_list(F.struct("node_idx", F.col("head_level").alias("level"), F.coalesce("text", F.lit("")).alias("text"), "tables")))
    folded = nodes.groupBy("doc_id").agg(rows.alias("r")).select("doc_id", F.explode(F.arrays_zip(F.col("r").alias("n"), fold_nodes(F.col("r")).alias("f"))).alias("x"))
    level = F.col("x.n.level")
    out = folded.select(
        "doc_id", "x.n.node_idx", F.when(F.col("x.n.node_idx") > 0, F.col("x.f.parent")).alias("parent_idx"),
        F.when(F.col("x.n.node_idx") == 0, 0).otherwise(F.coalesce(level, F.lit(PARAGRAPH_LEVEL))).alias("level"),
        F.when(F.col("x.n.node_idx") == 0, "root").when(level.isNotNull(), "heading").otherwise("paragraph").alias("node_type"),
        F.col("x.n.text").alias("text"), F.col("x.n.tables").alias("tables"), F.col("x.f.titles").alias("path_titles"),
    )
    return out if paths else out.drop("path_titles")


def fold_nodes(rows: Column) -> Column:
    """Parent and titles, from the outermost to the node itself if it is a heading, of each of a document's nodes (node_idx, level, text, ...) in order, level being null but for headings: one fold that keeps the stack of headings that enclose the next node. Levels may be any numbers."""
    open_ = "array<struct<node_idx:int,level:int,text:string>>"
    each = "struct<parent:int,titles:array<string>>"
    state = f"struct<stack:{open_},out:array<{each}>>"
    empty = F.struct(F.array().cast(open_).alias("stack"), F.array().cast(f"array<{each}>").alias("out")).cast(state)

    def step(s: Column, x: Column) -> Column:
        above = F.when(x["level"].isNull(), s["stack"]).otherwise(F.filter(s["stack"], lambda y: y["level"] < x["level"]))
        own = F.when(x["level"].isNull(), F.array().cast(open_)).otherwise(F.array(F.struct(x["node_idx"].alias("node_idx"), x["level"].alias("level"), x["text"].alias("text"))).cast(open_))
        stack = F.concat(above, own)
        got = F.struct(F.coalesce(F.try_element_at(above, F.lit(-1))["node_idx"], F.lit(0)).alias("parent"), F.transform(stack, lambda y: y["text"]).alias("titles")).cast(each)
        return F.struct(stack.alias("stack"), F.concat(s["out"], F.array(got)).alias("out")).cast(state)

    return F.aggregate(rows, empty, step, lambda s: s["out"])


def path_titles(nodes: DataFrame) -> DataFrame:
    """``nodes`` with path_titles, the headings from the outermost to the node itself if it is one (J12); a paragraph has those of the heading it is under."""
    if "path_titles" in nodes.columns:
        return nodes
    head = F.when(F.col("node_type") == "heading", F.col("level"))
    rows = F.array_sort(F.collect_list(F.struct("node_idx", head.alias("level"), F.coalesce("text", F.lit("")).alias("text"))))
    folded = nodes.groupBy("doc_id").agg(rows.alias("r")).select("doc_id", F.explode(F.arrays_zip(F.col("r").alias("n"), fold_nodes(F.col("r")).alias("f"))).alias("x"))
    return nodes.join(folded.select("doc_id", F.col("x.n.node_idx").alias("node_idx"), F.col("x.f.titles").alias("path_titles")), ["doc_id", "node_idx"])


def leaf_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes without children, roots left out."""
    parents = nodes.where("parent_idx is not null").select("doc_id", F.col("parent_idx").alias("node_idx")).distinct()
    return nodes.where("node_type <> 'root'").join(parents, ["doc_id", "node_idx"], "left_anti")


def content_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with text; a root only if it is its document's only one with text."""
    full = nodes.where(F.trim("text") != "")
    others = F.count_if(F.col("node_type") != "root").over(Window.partitionBy("doc_id"))
    return full.withColumn("_n", others).where("node_type <> 'root' or _n = 0").drop("_n")


def tree_stats(nodes: DataFrame) -> DataFrame:
    """Counts and text lengths of each document's tree (A4)."""
    leaves = leaf_nodes(nodes).groupBy("doc_id").agg(F.count(F.lit(1)).alias("leaf_nodes"))
    n = F.length("text")
    counts = nodes.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_nodes"),
        F.count_if(F.col("node_type") == "heading").alias("heading_nodes"),
        F.count_if(F.col("node_type") == "paragraph").alias("paragraph_nodes"),
        F.avg(n).alias("avg_length"),
        F.max(n).alias("max_length"),
        F.min(n).alias("min_length"),
    )
    return counts.join(leaves, "doc_id", "left").withColumn("leaf_nodes", F.coalesce("leaf_nodes", F.lit(0)))


def level_histogram(nodes: DataFrame) -> DataFrame:
    """Headings of each level."""
    return nodes.where("node_type = 'heading'").groupBy("doc_id", "level").agg(F.count(F.lit(1)).alias("n"))


def tree_text(nodes: DataFrame, preview: int = 50) -> DataFrame:
    """(doc_id, tree): the nodes in order, indented by depth, texts cut to ``preview`` characters."""
    t = path_titles(nodes)
    depth = F.size("path_titles") + F.when(F.col("node_type") == "paragraph", 1).otherwise(0)
    short = F.when(F.length("text") > preview, F.concat(F.left("text", F.lit(preview)), F.lit("..."))).otherwise(F.col("text"))
    line = F.concat(F.repeat(F.lit("  "), depth), F.lit("["), F.col("node_type"), F.lit("] "), short)
    rows = F.array_sort(F.collect_list(F.struct("node_idx", line.alias("line"))))
    return t.groupBy("doc_id").agg(rows.alias("r")).select("doc_id", F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("tree"))


def leaf_texts(nodes: DataFrame, cut: Cut | None = None) -> DataFrame:
    """What chunking starts from: leaf nodes with text and their paths (D7); where a document has none, its nodes with content."""
    t = (cut or Cut(nodes.sparkSession))(path_titles(nodes), "paths")
    leaves = leaf_nodes(t).where(F.trim("text") != "")
    none = content_nodes(t).join(leaves.select("doc_id").distinct(), "doc_id", "left_anti")
    return leaves.unionByName(none)


def is_leaf(children: Column) -> Column:
    return F.size(children) == 0
