"""Page reports: from parsed blocks to Markdown pages, and from raw parts to reports.

Blocks are rows (doc_id, page, pos, type, text, table_id, ...). Groups of a page
are runs of neighbouring blocks, found by windows within the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.functions.text import clean_glyphs, ends_with_colon

#: Block kinds that are left out.
IGNORED = ("page_footer", "picture")

_BLOCK = "struct<text:string,type:string,text_id:int,orig:string,enumerated:boolean,marker:string,table_id:int,picture_id:int,group_id:int,group_name:string,group_label:string>"
REPORT_DDL = (
    "metainfo struct<sha1_name:string,pages_amount:int,text_blocks_amount:int,tables_amount:int,pictures_amount:int,equations_amount:int,footnotes_amount:int,company_name:string>,"
    f"content array<struct<page:int,content:array<{_BLOCK}>>>,"
    "tables array<struct<table_id:int,page:int,bbox:array<double>,`#-rows`:int,`#-cols`:int,markdown:string,html:string>>,"
    f"pictures array<struct<picture_id:int,page:int,bbox:array<double>,children:array<{_BLOCK}>>>"
)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Reports from JSON files, one each, of the structure above (S20); other fields are ignored."""
    return spark.read.schema(REPORT_DDL).json(path, multiLine=True)


def blocks_of(reports: DataFrame) -> DataFrame:
    """(doc_id, page, pos, block columns) of reports with their JSON structure."""
    pages = reports.select(F.col("metainfo.sha1_name").alias("doc_id"), F.explode("content").alias("p"))
    return pages.select("doc_id", "p.page", F.posexplode("p.content").alias("pos", "b")).select("doc_id", "page", "pos", "b.*")


def tables_of(reports: DataFrame) -> DataFrame:
    return reports.select(F.col("metainfo.sha1_name").alias("doc_id"), F.explode("tables").alias("t")).select("doc_id", "t.table_id", "t.markdown", "t.html")


def filter_blocks(blocks: DataFrame) -> DataFrame:
    """Without footers and pictures (F2)."""
    return blocks.where(~F.coalesce(F.col("type"), F.lit("")).isin(*IGNORED))


def with_tables(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Table blocks with their table's Markdown as ``rendered``; a table that is missing raises an error when the row is read."""
    t = tables.select("doc_id", "table_id", F.coalesce("markdown", F.lit("")).alias("_md"))
    joined = blocks.join(t, ["doc_id", "table_id"], "left")
    missing = F.raise_error(F.concat(F.lit("no table "), F.col("table_id").cast("string"))).cast("string")
    return joined.withColumn("rendered", F.when(F.col("type") == "table", F.coalesce("_md", missing))).drop("_md")


def page_markdown(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, text): the formatting rules of a page (D17, D18, W4-W6, C8), glyph codes cleaned.

    Headers become # or ##, paragraphs ###, code is fenced, other text stands on
    a line; blank text is left out. A table, or a run of list items, forms a group
    with the block before it if that ends in a colon and is no header, and with the
    footnotes after it, also behind one text; a group is set off by blank lines.
    ``rendered`` holds tables' Markdown.
    """
    page = Window.partitionBy("doc_id", "page").orderBy("pos")
    upto = page.rowsBetween(Window.unboundedPreceding, 0)
    kind, prev, anchors = F.coalesce("type", F.lit("")), lambda n: F.coalesce(F.lag("type", n).over(page), F.lit("")), ("table", "list_item")
    following = F.coalesce(F.lead("type").over(page), F.lit(""))
    b = filter_blocks(blocks).withColumn("i", F.row_number().over(page) - 1).withColumn("t", F.trim(F.coalesce("text", F.lit(""))))
    b = b.withColumn("page_headed", F.coalesce(F.max((F.col("type") == "page_header") & (F.col("i") < 3)).over(Window.partitionBy("doc_id", "page")), F.lit(False)))
    b = b.withColumn("section", F.count_if(kind == "section_header").over(upto))
    b = b.withColumn("heads", ends_with_colon(F.col("t"), kind) & ~kind.isin("section_header", "page_header") & following.isin(*anchors))
    b = b.withColumn("led", (kind == "text") & prev(1).isin(*anchors) & (following == "footnote"))
    run_start = (kind == "footnote") & (prev(1) != "footnote")
    b = b.withColumn("noted", F.last(F.when(run_start, prev(1).isin(*anchors) | F.coalesce(F.lag("led").over(page), F.lit(False))), ignorenulls=True).over(upto))
    b = b.withColumn("member", F.col("heads") | kind.isin(*anchors) | F.col("led") | ((kind == "footnote") & F.coalesce("noted", F.lit(False))))
    opens = F.col("heads") | (((kind == "table") | ((kind == "list_item") & (prev(1) != "list_item"))) & ~F.coalesce(F.lag("heads").over(page), F.lit(False)))
    b = b.withColumn("item", F.sum(F.when(opens | ~F.col("member"), 1).otherwise(0)).over(upto))
    top = ((kind == "page_header") & (F.col("i") < 3)) | ((kind == "section_header") & (F.col("section") == 1) & (F.col("i") < 3) & ~F.col("page_headed"))
    piece = (
        F.when(F.col("member") & (kind == "table"), F.coalesce("rendered", F.lit("")))
        .when(F.col("member") & (kind == "list_item"), F.concat(F.lit("- "), "t"))
        .when(F.col("member"), F.col("t"))
        .when(kind.isin("page_header", "section_header"), F.concat(F.when(top, "\n# ").otherwise("\n## "), "t"))
        .when(kind == "paragraph", F.concat(F.lit("\n### "), "t"))
        .when((kind == "code") & (F.col("t") != ""), F.concat(F.lit("```\n"), "t", F.lit("\n```")))
        .when(F.col("t") != "", F.col("t"))
    )
    rows = F.transform(F.array_sort(F.collect_list(F.when(piece.isNotNull(), F.struct("pos", piece.alias("piece"))))), lambda r: F.concat(r["piece"], F.lit("\n")))
    edge = F.when(F.first("member"), "\n").otherwise("")
    items = b.groupBy("doc_id", "page", "item").agg(F.size(rows).alias("n"), F.concat(edge, F.array_join(rows, ""), edge).alias("text"))
    lines = F.transform(F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("item", "text")))), lambda r: r["text"])
    return items.groupBy("doc_id", "page").agg(clean_glyphs(F.array_join(lines, "\n")).alias("text"))


def runs(kind: Column, order: Window) -> Column:
    """Number of the run of equal neighbours that a row is in."""
    change = F.when(F.coalesce(F.lag(kind).over(order) == kind, F.lit(False)), 0).otherwise(1)
    return F.sum(change).over(order.rowsBetween(Window.unboundedPreceding, 0))


def report_markdown(pages: DataFrame) -> DataFrame:
    """(doc_id, markdown): pages in order, each under a rule and its number (K6)."""
    part = F.concat(F.lit("\n\n---\n\n# Page "), F.col("page").cast("string"), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    rows = F.array_sort(F.collect_list(F.struct("page", part.alias("part"))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["part"]), "").alias("markdown"))


def fill_pages(pages: DataFrame, doc: str = "doc_id", page: str = "page") -> DataFrame:
    """Pages 1 to the last of each document, missing ones with nulls."""
    every = pages.groupBy(doc).agg(F.max(page).alias("_n")).select(doc, F.explode(F.sequence(F.lit(1), F.greatest(F.col("_n"), F.lit(1)))).alias(page))
    return every.join(pages, [doc, page], "left")


def resolve_refs(body: DataFrame, items: DataFrame) -> DataFrame:
    """Body references in reading order to what they point at (J5): body (doc_id, pos, ref as #/kind/number), items (doc_id, kind, idx, ...)."""
    parts = body.select("doc_id", "pos", F.regexp_extract("ref", "#/(\\w+)/(\\d+)", 1).alias("kind"), F.regexp_extract("ref", "#/(\\w+)/(\\d+)", 2).cast("int").alias("idx"))
    return parts.join(items, ["doc_id", "kind", "idx"])


def expand_groups(body: DataFrame, groups: DataFrame) -> DataFrame:
    """References to groups replaced by the group's children, tagged with its id, name and label (J6): groups (doc_id, idx, name, label, children array<string>)."""
    idx = F.regexp_extract("ref", "^#/groups/(\\d+)$", 1)
    tagged = body.withColumn("_g", F.when(idx != "", idx.cast("int")))
    g = groups.select("doc_id", F.col("idx").alias("_g"), F.col("name").alias("group_name"), F.col("label").alias("group_label"), "children")
    opened = tagged.join(g, ["doc_id", "_g"], "left").select("doc_id", "pos", "ref", F.col("_g").alias("group_id"), "group_name", "group_label", F.posexplode_outer("children").alias("sub", "child"))
    return opened.select("doc_id", "pos", F.coalesce("sub", F.lit(0)).alias("sub"), F.coalesce("child", "ref").alias("ref"), "group_id", "group_name", "group_label").where("group_id is null or child is not null or ref not like '#/groups/%'")


def picture_texts(pictures: DataFrame, texts: DataFrame) -> DataFrame:
    """The texts inside pictures (J7): pictures (doc_id, picture_id, children array<int>), texts (doc_id, idx, text)."""
    kids = pictures.select("doc_id", "picture_id", F.posexplode("children").alias("k", "idx"))
    return kids.join(texts, ["doc_id", "idx"]).select("doc_id", "picture_id", "k", "text")


def page_headings(pages: DataFrame, toc: DataFrame) -> DataFrame:
    """Pages (doc_id, page) with the headings that a table of contents (doc_id, page, level, title, pos) puts on them, in order; none is an empty list."""
    heads = toc.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("pos", "level", "title"))).alias("h"))
    empty = F.array().cast("array<string>")
    line = F.transform("h", lambda x: F.concat(F.lit("Heading "), x["level"].cast("string"), F.lit(": "), x["title"]))
    return pages.join(heads, ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce(line, empty).alias("headings"))


def without_cells(text: Column, tables: Column) -> Column:
    """Page text without the texts of its tables' cells, each distinct one once, longest first (U2); rows are arrays of cells."""
    cells = F.array_distinct(F.filter(F.transform(F.flatten(F.flatten(tables)), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))
    by_length = F.reverse(F.array_sort(F.transform(cells, lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))))
    return F.aggregate(by_length, text, lambda t, c: F.replace(t, c["x"], F.lit("")))


def pages_of(items: DataFrame) -> DataFrame:
    """(doc_id, page, blocks): items grouped by their page in reading order."""
    return items.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("pos", "type", "text"))).alias("blocks"))


def metainfo(blocks: DataFrame, tables: DataFrame, pictures: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Counts of each report and, if ``meta`` (sha1, company_name or name) has it, its company."""
    b = blocks.groupBy("doc_id").agg(
        F.count_distinct("page").alias("pages_amount"),
        F.count(F.lit(1)).alias("text_blocks_amount"),
        F.count_if(F.col("type") == "equation").alias("equations_amount"),
        F.count_if(F.col("type") == "footnote").alias("footnotes_amount"),
    )
    t = tables.groupBy("doc_id").agg(F.count(F.lit(1)).alias("tables_amount"))
    p = pictures.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pictures_amount"))
    out = b.join(t, "doc_id", "left").join(p, "doc_id", "left").na.fill(0, ["tables_amount", "pictures_amount"])
    if meta is not None:
        name = F.coalesce(*[F.col(c) for c in ("company_name", "name") if c in meta.columns])
        out = out.join(meta.select(F.col("sha1").alias("doc_id"), F.regexp_replace(name, '^"+|"+$', "").alias("company_name")).dropDuplicates(["doc_id"]), "doc_id", "left")
    return out


def conversion_result(status: DataFrame) -> DataFrame:
    """success, failed, failed_files of a conversion by its status rows (path, ok)."""
    return status.agg(F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("failed"), F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("path")))).alias("failed_files"))
