"""Queries of the document, retrieval and tool operators over whole tables, with SQL for DuckDB."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions import text as X
from tessel.functions import tools as Z
from tessel.operators import chunks as C
from tessel.operators import lookups as L
from tessel.operators import outline as O
from tessel.operators import report as R
from tessel.operators import retrieval as V
from tessel.plans import catalog as K
from tessel.plans import router as Q
from tessel.plans.lineage import fresh_path
from tessel.sources.sinks import load_index, write_index


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# text -------------------------------------------------------------------------------

_STRIP = "regexp_replace({}, '^[\\s　]+|[\\s　]+$', '', 'g')"


@query(f"SELECT doc_id, {_STRIP.format("regexp_replace(text, '\\n\\s*\\n+', chr(10) || chr(10), 'g')")} AS t FROM documents")
def doc_clean_text(spark, sf):
    return read(spark, sf, "documents").select("doc_id", X.clean_text(F.col("text")).alias("t"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, regexp_replace(coalesce(title, ''), '\\.[^.]*$', '') AS base FROM documents")
def doc_normalize_space(spark, sf):
    return read(spark, sf, "documents").select("doc_id", X.normalize_space(F.col("text")).alias("t"), X.drop_extension(F.coalesce("title", F.lit(""))).alias("base"))


_UP = "(upper(t) = t AND lower(t) <> t)"
_HEAD = f"""CASE WHEN t = '' OR length(t) > 100 THEN false ELSE regexp_matches(t, '^\\d+\\.?\\d*\\.?\\d*\\s+') OR regexp_matches(t, '^第[一二三四五六七八九十\\d]+[章節条款部分]\\s*')
 OR regexp_matches(t, '^[一二三四五六七八九十]+[、\\.]\\s*') OR regexp_matches(t, '^[A-Z][A-Z\\s]*$') OR regexp_matches(t, '^[A-Z][a-z\\s]+$') OR {_UP} OR (length(t) < 50 AND upper(t[1]) = t[1] AND lower(t[1]) <> t[1]) END"""


@query(
    f"""SELECT file_id, node_index, {_HEAD} AS is_heading,
 CASE WHEN regexp_matches(t, '^\\d+\\.\\d+\\.\\d+') THEN 3 WHEN regexp_matches(t, '^\\d+\\.\\d+') THEN 2 WHEN regexp_matches(t, '^\\d+\\.?') THEN 1 WHEN regexp_matches(t, '^第[一二三四五六七八九十\\d]+章') THEN 1
 WHEN regexp_matches(t, '^第[一二三四五六七八九十\\d]+節') THEN 2 WHEN regexp_matches(t, '^[一二三四五六七八九十]+[、\\.]') THEN 2 WHEN {_UP} THEN 1 ELSE 2 END AS inferred,
 CASE WHEN regexp_extract(t, '^\\s*(\\d+(?:\\.\\d+){{0,10}})[\\.\\s]+', 1) <> '' THEN least(6, len(string_split(regexp_extract(t, '^\\s*(\\d+(?:\\.\\d+){{0,10}})[\\.\\s]+', 1), '.'))) END AS detected
 FROM (SELECT DISTINCT file_id, node_index, coalesce(text, '') AS t FROM document_node)"""
)
def doc_heading_levels(spark, sf):
    d = read(spark, sf, "document_node").select("file_id", "node_index", F.coalesce("text", F.lit("")).alias("t")).distinct()
    return d.select("file_id", "node_index", X.is_likely_heading(F.col("t")).alias("is_heading"), X.infer_heading_level(F.col("t")).alias("inferred"), X.detect_heading_level(F.col("t")).alias("detected"))


_WORDS = "[" + ", ".join(f"'{w}'" for w in X.TABLE_HEADER_WORDS) + "]"


@query(
    f"""WITH t AS (SELECT DISTINCT file_id, node_index, unnest(tables) AS tb FROM document_node),
c AS (SELECT file_id, node_index, tb.rows AS rows, list_filter(list_transform(tb.rows[1], lambda x: trim(coalesce(x, ''))), lambda x: x <> '') AS cells FROM t)
SELECT file_id, node_index, len(rows) AS n_rows,
 CASE WHEN len(cells) > 0 THEN list_sum(list_transform(cells, lambda x: CASE WHEN len(list_filter({_WORDS}, lambda w: contains(x, w))) > 0 THEN 1.0
  WHEN length(x) <= 10 AND NOT regexp_matches(x, '^\\d+$') AND regexp_matches(x, '\\p{{L}}') THEN 0.5 ELSE 0.0 END)) / len(cells) END AS score,
 array_to_string(list_concat(['| ' || array_to_string(list_transform(rows[1], lambda x: trim(coalesce(x, ''))), ' | ') || ' |', '| ' || array_to_string(list_transform(rows[1], lambda x: '---'), ' | ') || ' |'],
  list_transform(rows[2:], lambda r: '| ' || array_to_string(list_transform(r, lambda x: trim(coalesce(x, ''))), ' | ') || ' |')), chr(10)) AS md
FROM c WHERE len(rows) > 0"""
)
def doc_tables(spark, sf):
    t = read(spark, sf, "document_node").select("file_id", "node_index", "tables").distinct().select("file_id", "node_index", F.explode("tables").alias("tb")).where(F.size("tb.rows") > 0)
    return t.select("file_id", "node_index", F.size("tb.rows").cast("long").alias("n_rows"), X.header_score(F.col("tb.rows")[0]).alias("score"), X.table_markdown(F.col("tb.rows")).alias("md"))


_LINE = "SELECT doc_id, k, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents)"


@query(f"SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE length(line) - length(replace(line, '|', '')) >= 2) AS n_table_lines, count(*) FILTER (WHERE trim(line) <> '' AND NOT starts_with(line, 'Outline')) AS n_content FROM ({_LINE}) GROUP BY 1")
def doc_line_filters(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(X.is_table_line(F.col("line"))).alias("n_table_lines"), F.count_if((F.trim("line") != "") & ~F.col("line").startswith("Outline")).alias("n_content"))


_ALONE = "(?:^|[^\\p{{L}}\\p{{N}}_])([{}])(?:$|[^\\p{{L}}\\p{{N}}_])"


@query(
    f"""SELECT doc_id, coalesce(nullif(regexp_extract(t, '{_ALONE.format("A-Z")}', 1), ''), nullif(regexp_extract(t, '([A-Z])', 1), ''), nullif(regexp_extract(t, '{_ALONE.format("a-z")}', 1), ''), nullif(regexp_extract(t, '([a-z])', 1), ''), t) AS option
 FROM (SELECT doc_id, coalesce(title, '') AS t FROM documents)"""
)
def opt_extract_letter(spark, sf):
    return read(spark, sf, "documents").select("doc_id", X.extract_option(F.coalesce("title", F.lit(""))).alias("option"))


_SPOILT = "replace(replace(replace(replace(coalesce(text, ''), '1', '/one.tnum'), ',', '/comma.pl.tnum'), 'A', '/A.cap'), '%', 'glyph<3>/percent.case')"


@query("SELECT doc_id, md5(replace(coalesce(text, ''), '/', '~')) AS cleaned, n FROM (SELECT doc_id, text, length(t) - length(replace(t, '1', '')) + length(t) - length(replace(t, ',', '')) + length(t) - length(replace(t, 'A', '')) + 2 * (length(t) - length(replace(t, '%', ''))) AS n FROM (SELECT doc_id, text, coalesce(text, '') AS t FROM documents))")
def txt_glyphs(spark, sf):
    """Every text with characters replaced by glyph codes, and cleaned of these again."""
    t = F.expr(_SPOILT.replace("coalesce(text, '')", "replace(coalesce(text, ''), '/', '~')"))
    return read(spark, sf, "documents").select("doc_id", t.alias("t")).select("doc_id", F.md5(X.clean_glyphs(F.col("t")).cast("binary")).alias("cleaned"), X.count_glyphs(F.col("t")).cast("long").alias("n"))


@query(
    "SELECT * FROM (VALUES (1, 'SELECT a, b' || chr(10) || 'FROM t' || chr(10) || 'WHERE x = 1;'), (2, 'SELECT 1' || chr(10) || 'FROM t;'), (3, 'SELECT a' || chr(10) || 'FROM t'), (4, 'no statement here'), (5, 'SELECT x' || chr(10) || 'FROM a' || chr(10) || 'LEFT JOIN b ON a.k = b.k' || chr(10) || 'ORDER BY x' || chr(10) || 'LIMIT 3;')) v(id, q)"
)
def clean_sql(spark, sf):
    rows = [(1, "```sql\nSELECT a, b\n FROM t WHERE x = 1; and more\n``` trailing"), (2, "SQLQuery: select 1 from t;".replace("select", "SELECT").replace("from", "FROM")), (3, "SELECT `a`\n\n FROM `t`"), (4, "no  statement\nhere"), (5, "mysql: SELECT x FROM a LEFT JOIN b ON a.k = b.k ORDER BY x LIMIT 3;")]
    return spark.createDataFrame(rows, "id int, q string").select("id", F.regexp_replace(X.clean_sql(F.col("q")), " +\\n", "\n").alias("q"))


@query("SELECT file_id, source_node_index, chunk_index, CASE WHEN len(titles) > 0 THEN array_to_string(titles, ' > ') || chr(10) || chr(10) || content ELSE content END AS whole FROM (SELECT *, list_filter(coalesce(path_titles, []), lambda t: t IS NOT NULL) AS titles FROM text_chunk)")
def chunk_with_titles(spark, sf):
    t = F.filter(F.coalesce("path_titles", F.array().cast("array<string>")), lambda x: x.isNotNull())
    return read(spark, sf, "text_chunk").select("file_id", "source_node_index", "chunk_index", X.with_titles(t, F.col("content")).alias("whole"))


# documents, trees and chunks -----------------------------------------------------------


@query(
    """SELECT doc_id, k AS chunk_index, CASE WHEN length(text) > 1000 THEN CAST(ceil(length(text) / 900.0) AS INT) ELSE 1 END AS total_chunks, length(text) > 1000 AS long, substring(text, k * 900 + 1, 1000) AS chunk
 FROM (SELECT doc_id, text, unnest(range(CASE WHEN length(text) > 1000 THEN CAST(ceil(length(text) / 900.0) AS INT) ELSE 1 END)) AS k FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))"""
)
def doc_presplit(spark, sf):
    d = C.presplit(read(spark, sf, "documents"), "doc_id", "text", 1000, 100)
    return d.select("doc_id", "chunk_index", "total_chunks", F.col("is_chunked").alias("long"), "chunk")


_WINDOWS = """SELECT doc_id, k AS chunk_index, k * {step} AS chunk_start, least(k * {step} + 512, n) AS chunk_end, n > 512 AS is_child_node, substring(text, k * {step} + 1, 512) AS child_text
 FROM (SELECT doc_id, text, length(text) AS n, unnest(range(CASE WHEN length(text) > 512 THEN CAST(ceil(length(text) / {step}.0) AS INT) ELSE 1 END)) AS k FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))"""


def _split(spark, sf, ratio):
    return C.split_nodes(read(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", 512, ratio).select("doc_id", "chunk_index", "chunk_start", "chunk_end", "is_child_node", "child_text")


@query(_WINDOWS.format(step=512))
def doc_split_512(spark, sf):
    return _split(spark, sf, 0.0)


@query(_WINDOWS.format(step=461))
def doc_split_overlap(spark, sf):
    return _split(spark, sf, 0.1)


def _outlines(spark, sf):
    """The nodes of document_node as outline text, one document a file."""
    one = F.regexp_replace(F.coalesce("text", F.lit("")), "[\\s　]+", " ")
    d = read(spark, sf, "document_node").where("node_type <> 'root'").select("file_id", "node_index", F.when(F.col("node_type") == "heading", F.concat(F.lit("Heading "), F.greatest(F.lit(1), F.coalesce("level", F.lit(1))).cast("string"), F.lit(": "), one)).otherwise(F.concat(F.lit("Paragraph: "), one)).alias("line")).distinct()
    rows = F.array_sort(F.collect_list(F.struct("node_index", "line")))
    return d.groupBy(F.col("file_id").alias("doc_id")).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("text"))


_NODES = """WITH d AS (SELECT DISTINCT file_id AS doc_id, node_index, node_type, greatest(1, coalesce(level, 1)) AS l, trim(regexp_replace(coalesce(text, ''), '[\\s　]+', ' ', 'g')) AS t FROM document_node WHERE node_type <> 'root'),
k AS (SELECT *, length(t) - length(replace(t, '|', '')) >= 2 AND node_type <> 'heading' AS tab, max(CASE WHEN node_type = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS headed FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY node_index) AS idx FROM k WHERE headed = 1 AND NOT tab),
p AS (SELECT n.*, coalesce((SELECT max(h.idx) FROM n h WHERE h.doc_id = n.doc_id AND h.idx < n.idx AND h.node_type = 'heading' AND (n.node_type <> 'heading' OR h.l < n.l)), 0) AS parent FROM n)
"""


@query(_NODES + "SELECT doc_id, CAST(idx AS INT) AS node_idx, CAST(parent AS INT) AS parent_idx, CAST(CASE WHEN node_type = 'heading' THEN l ELSE 999 END AS INT) AS level, node_type, t AS text FROM p")
def doc_outline_nodes(spark, sf):
    return O.outline_nodes(_outlines(spark, sf)).where("node_type <> 'root'").select("doc_id", "node_idx", "parent_idx", "level", "node_type", "text")


@query(
    _NODES
    + """, w AS (SELECT doc_id, idx, idx AS at, node_type, CASE WHEN node_type = 'heading' THEN [t] ELSE CAST([] AS VARCHAR[]) END AS path, parent FROM p), r AS (
 WITH RECURSIVE up AS (SELECT doc_id, idx, path, parent FROM w UNION ALL SELECT u.doc_id, u.idx, list_prepend(q.t, u.path), q.parent FROM up u JOIN p q ON q.doc_id = u.doc_id AND q.idx = u.parent) SELECT * FROM up WHERE parent = 0)
SELECT doc_id, CAST(idx AS INT) AS node_idx, array_to_string(path, ' > ') AS path FROM r"""
)
def doc_path_titles(spark, sf):
    return O.path_titles(O.outline_nodes(_outlines(spark, sf), paths=True)).where("node_type <> 'root'").select("doc_id", "node_idx", F.array_join("path_titles", " > ").alias("path"))


@query(_NODES + "SELECT p.doc_id, CAST(p.idx AS INT) AS node_idx FROM p ANTI JOIN p c ON c.doc_id = p.doc_id AND c.parent = p.idx")
def doc_leaf_nodes(spark, sf):
    return O.leaf_nodes(O.outline_nodes(_outlines(spark, sf))).select("doc_id", "node_idx")


@query(
    _NODES
    + """, leaf AS (SELECT p.doc_id, count(*) AS leaf_nodes FROM p ANTI JOIN p c ON c.doc_id = p.doc_id AND c.parent = p.idx GROUP BY 1)
SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE node_type = 'heading') AS heading_nodes, count(*) FILTER (WHERE node_type = 'paragraph') AS paragraph_nodes, max(length(t)) AS max_length, round(avg(length(t)), 6) AS avg_length, any_value(leaf_nodes) AS leaf_nodes
FROM p JOIN leaf USING (doc_id) GROUP BY 1"""
)
def doc_tree_stats(spark, sf):
    nodes = O.outline_nodes(_outlines(spark, sf)).where("node_type <> 'root'")
    return O.tree_stats(nodes).select("doc_id", F.col("total_nodes").alias("n"), "heading_nodes", "paragraph_nodes", "max_length", F.round("avg_length", 6).alias("avg_length"), "leaf_nodes")


@query(_NODES + "SELECT doc_id, CAST(l AS INT) AS level, count(*) AS n FROM p WHERE node_type = 'heading' GROUP BY 1, 2")
def doc_level_histogram(spark, sf):
    return O.level_histogram(O.outline_nodes(_outlines(spark, sf)))


@query(
    _NODES
    + """, w AS (SELECT doc_id, idx, 0 AS d, parent FROM p), r AS (WITH RECURSIVE up AS (SELECT doc_id, idx, CASE WHEN parent > 0 THEN 1 ELSE 0 END AS d, parent FROM w UNION ALL SELECT u.doc_id, u.idx, u.d + CASE WHEN q.parent > 0 THEN 1 ELSE 0 END, q.parent FROM up u JOIN p q ON q.doc_id = u.doc_id AND q.idx = u.parent) SELECT * FROM up WHERE parent = 0),
t AS (SELECT p.doc_id, p.idx, repeat('  ', CAST(r.d + 1 AS INT)) || '[' || node_type || '] ' || CASE WHEN length(t) > 50 THEN left(t, 50) || '...' ELSE t END AS line FROM p JOIN r ON r.doc_id = p.doc_id AND r.idx = p.idx)
SELECT doc_id, string_agg(line, chr(10) ORDER BY idx) AS tree FROM t GROUP BY 1"""
)
def doc_tree_text(spark, sf):
    return O.tree_text(O.outline_nodes(_outlines(spark, sf), paths=True).where("node_type <> 'root'"))


def _leaf_chunks(spark, sf):
    return C.leaf_chunks(O.leaf_texts(O.outline_nodes(_outlines(spark, sf), paths=True)))


@query()
def doc_leaf_chunks(spark, sf):
    return _leaf_chunks(spark, sf)


@query()
def doc_merge_by_path(spark, sf):
    return C.merge_by_path(_leaf_chunks(spark, sf))


@query()
def doc_sentence_chunks(spark, sf):
    return C.sentence_chunks(read(spark, sf, "documents"))


@query("SELECT file_id, count(*) AS total_chunks, count(DISTINCT source_node_index) AS n_nodes FROM text_chunk GROUP BY 1")
def doc_chunk_index(spark, sf):
    c = read(spark, sf, "text_chunk").select(F.col("file_id").alias("doc_id"), F.col("source_node_index").alias("node_idx"), "chunk_id", F.coalesce("path_titles", F.array().cast("array<string>")).alias("path_titles"))
    return C.chunk_index(c).select(F.col("doc_id").alias("file_id"), F.col("total_chunks"), F.size("chunks_by_node").cast("long").alias("n_nodes"))


@query("SELECT file_id, chunk_id, prefix || lpad(CAST(rn AS VARCHAR), CAST(greatest(4, length(CAST(n AS VARCHAR))) AS INT), '0') || '.txt' AS file_name FROM (SELECT *, 'doc_' AS prefix, row_number() OVER (PARTITION BY file_id ORDER BY source_node_index, chunk_index) AS rn, count(*) OVER (PARTITION BY file_id) AS n FROM text_chunk)")
def doc_chunk_names(spark, sf):
    c = read(spark, sf, "text_chunk").withColumnsRenamed({"file_id": "doc_id", "source_node_index": "node_idx"})
    return C.numbered_names(c, "doc").select(F.col("doc_id").alias("file_id"), "chunk_id", "file_name")


@query(
    """WITH c AS (SELECT file_id, source_node_index, chunk_index, content, lag(content) OVER (PARTITION BY file_id ORDER BY source_node_index, chunk_index) AS prev FROM text_chunk)
SELECT file_id, source_node_index, chunk_index, coalesce((SELECT max(k) FROM range(1, 401) r(k) WHERE k <= length(prev) AND k <= length(content) AND right(prev, k) = left(content, k)), 0) AS overlap FROM c"""
)
def doc_chunk_overlap(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("file_id").orderBy("source_node_index", "chunk_index")
    c = read(spark, sf, "text_chunk").select("file_id", "source_node_index", "chunk_index", "content", F.lag("content").over(w).alias("prev"))
    return c.select("file_id", "source_node_index", "chunk_index", F.coalesce(X.overlap_length(F.col("prev"), F.col("content"), 400), F.lit(0)).cast("long").alias("overlap"))


@query("SELECT count(doc_id) AS n, count(DISTINCT doc_id) AS n_distinct, count(doc_id) > count(DISTINCT doc_id) AS has_duplicates FROM reading_labels")
def doc_dup_ids(spark, sf):
    return L.duplicate_ids(read(spark, sf, "reading_labels"), "doc_id")


@query("SELECT 'in/' || doc_id || '.txt' AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM reading_labels)")
def doc_incremental(spark, sf):
    inputs = read(spark, sf, "documents").select(F.concat(F.lit("in/"), "doc_id", F.lit(".txt")).alias("path"))
    done = read(spark, sf, "reading_labels").select(F.concat(F.lit("out/"), "doc_id", F.lit("_chunks.json")).alias("path"))
    return L.not_yet_done(inputs, [done], "path", ("_chunks",))


@query("SELECT lang, round(100.0 * n / sum(n) OVER (), 2) AS percent FROM (SELECT coalesce(lang, '') AS lang, sum(n_chars) AS n FROM documents GROUP BY 1)")
def doc_share_by_lang(spark, sf):
    d = read(spark, sf, "documents").groupBy(F.coalesce("lang", F.lit("")).alias("lang")).agg(F.sum("n_chars").alias("n"))
    return L.share_of_total(d, "n").select("lang", "percent")


@query("SELECT doc_id, array_to_string((string_split_regex(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), ' '))[1:30], ' ') AS summary FROM documents")
def doc_summary(spark, sf):
    return read(spark, sf, "documents").select("doc_id", L.summary(F.col("text")).alias("summary"))


# reports -------------------------------------------------------------------------------


def _blocks(spark, sf):
    """Nodes as page blocks: thirty a page, kinds by node type and text."""
    d = read(spark, sf, "document_node").where("node_type <> 'root'").select("file_id", "node_index", "node_type", "text").distinct()
    kind = F.when(F.col("node_type") == "heading", "section_header").when(F.length("text") < 60, "list_item").when(F.length("text") < 120, "text").otherwise("paragraph")
    return d.select(F.col("file_id").alias("doc_id"), (F.floor(F.col("node_index") / 30) + 1).cast("int").alias("page"), F.col("node_index").alias("pos"), kind.alias("type"), "text", F.lit(None).cast("string").alias("rendered"))


_PAGES = """WITH b AS (SELECT doc_id, page, pos, type, trim(coalesce(text, '')) AS t, row_number() OVER w - 1 AS i, lead(type) OVER w AS nx, lag(type) OVER w AS pv, sum(CASE WHEN type = 'section_header' THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS sec FROM (SELECT DISTINCT file_id AS doc_id, CAST(floor(node_index / 30) + 1 AS INT) AS page, node_index AS pos, CASE WHEN node_type = 'heading' THEN 'section_header' WHEN length(text) < 60 THEN 'list_item' WHEN length(text) < 120 THEN 'text' ELSE 'paragraph' END AS type, text FROM document_node WHERE node_type <> 'root') WINDOW w AS (PARTITION BY doc_id, page ORDER BY pos)),
h AS (SELECT *, type IN ('paragraph', 'text') AND ends_with(t, ':') AND coalesce(nx, '') = 'list_item' AS heads FROM b), m AS (SELECT *, heads OR type = 'list_item' AS member, coalesce(lag(heads) OVER (PARTITION BY doc_id, page ORDER BY pos), false) AS headed FROM h),
i AS (SELECT *, sum(CASE WHEN heads OR (type = 'list_item' AND coalesce(pv, '') <> 'list_item' AND NOT headed) OR NOT member THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY pos ROWS UNBOUNDED PRECEDING) AS item,
 CASE WHEN type = 'section_header' THEN chr(10) || CASE WHEN sec = 1 AND i < 3 THEN '# ' ELSE '## ' END || t WHEN type = 'list_item' THEN '- ' || t WHEN type = 'paragraph' AND NOT heads THEN chr(10) || '### ' || t WHEN t <> '' OR heads THEN t END AS piece FROM m),
g AS (SELECT doc_id, page, item, CASE WHEN bool_or(member) THEN chr(10) ELSE '' END AS e, string_agg(piece || chr(10), '' ORDER BY pos) AS x FROM i GROUP BY 1, 2, 3),
p AS (SELECT doc_id, page, coalesce(string_agg(e || x || e, chr(10) ORDER BY item), '') AS text FROM g GROUP BY 1, 2)
"""


@query(_PAGES + "SELECT * FROM p")
def report_pages(spark, sf):
    return R.page_markdown(_blocks(spark, sf))


@query(_PAGES + """, every AS (SELECT doc_id, unnest(range(1, mx + 1)) AS page FROM (SELECT doc_id, max(page) AS mx FROM p GROUP BY 1))
SELECT doc_id, string_agg(chr(10) || chr(10) || '---' || chr(10) || chr(10) || '# Page ' || page || chr(10) || chr(10) || coalesce(text, ''), '' ORDER BY page) AS markdown FROM every LEFT JOIN p USING (doc_id, page) GROUP BY 1""")
def report_markdown(spark, sf):
    return R.report_markdown(R.fill_pages(R.page_markdown(_blocks(spark, sf))))


_BLOCKS = "(SELECT DISTINCT file_id AS doc_id, CAST(floor(node_index / 30) + 1 AS INT) AS page, node_index AS pos, CASE WHEN node_type = 'heading' THEN 'section_header' WHEN length(text) < 60 THEN 'list_item' WHEN length(text) < 120 THEN 'text' ELSE 'paragraph' END AS type, text FROM document_node WHERE node_type <> 'root')"


@query(f"SELECT doc_id, pos, type, CAST(sum(chg) OVER (PARTITION BY doc_id, page ORDER BY pos) AS BIGINT) AS run FROM (SELECT *, CASE WHEN lag(type) OVER (PARTITION BY doc_id, page ORDER BY pos) = type THEN 0 ELSE 1 END AS chg FROM {_BLOCKS})")
def report_runs(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id", "page").orderBy("pos")
    return _blocks(spark, sf).select("doc_id", "pos", "type", R.runs(F.col("type"), w).alias("run"))


@query(f"SELECT doc_id, count(DISTINCT page) AS pages_amount, count(*) AS text_blocks_amount, 0 AS equations_amount, CAST(coalesce(t.n, 0) AS BIGINT) AS tables_amount FROM {_BLOCKS} b LEFT JOIN (SELECT file_id, CAST(sum(len(tables)) AS BIGINT) AS n FROM (SELECT DISTINCT file_id, node_index, tables FROM document_node) GROUP BY 1) t ON t.file_id = b.doc_id GROUP BY doc_id, t.n")
def report_metainfo(spark, sf):
    d = read(spark, sf, "document_node").select("file_id", "node_index", "tables").distinct()
    tables = d.select(F.col("file_id").alias("doc_id"), F.explode("tables").alias("t"))
    none = spark.createDataFrame([], "doc_id bigint")
    return R.metainfo(_blocks(spark, sf), tables, none).select("doc_id", "pages_amount", "text_blocks_amount", "equations_amount", "tables_amount")


@query("WITH p AS (SELECT user_id AS doc_id, day(ts) AS page, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT doc_id, max(page) AS mx FROM p GROUP BY 1) SELECT m.doc_id, CAST(g.page AS INT) AS page, p.n FROM (SELECT doc_id, unnest(range(1, mx + 1)) AS page FROM m) g JOIN m USING (doc_id) LEFT JOIN p ON p.doc_id = g.doc_id AND p.page = g.page")
def page_gap_fill(spark, sf):
    pages = read(spark, sf, "events").groupBy(F.col("user_id").alias("doc_id"), F.dayofmonth("ts").alias("page")).agg(F.count(F.lit(1)).alias("n"))
    return R.fill_pages(pages)


@query("WITH d AS (SELECT DISTINCT file_id, node_index, children_indices FROM document_node), t AS (SELECT DISTINCT file_id, node_index, text FROM document_node), k AS (SELECT file_id, node_index, generate_subscripts(children_indices, 1) - 1 AS k, unnest(children_indices) AS c FROM d) SELECT k.file_id AS doc_id, k.node_index AS picture_id, CAST(k.k AS INT) AS k, t.text FROM k JOIN t ON t.file_id = k.file_id AND t.node_index = k.c")
def report_child_texts(spark, sf):
    d = read(spark, sf, "document_node")
    pictures = d.select(F.col("file_id").alias("doc_id"), F.col("node_index").alias("picture_id"), F.col("children_indices").alias("children")).distinct()
    return R.picture_texts(pictures, d.select(F.col("file_id").alias("doc_id"), F.col("node_index").alias("idx"), "text").distinct())


# retrieval -----------------------------------------------------------------------------


def _vectors(spark, sf):
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding")


def _vector_queries(spark, sf):
    return read(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


_DENSE = """(SELECT query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) - 1 AS rank FROM (
 SELECT q.vec_id AS query_id, e.vec_id AS node_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0))"""


@query(f"SELECT query_id, node_id, round(score, 6) AS score, rank FROM {_DENSE} WHERE rank < 10")
def rag_dense_topk(spark, sf):
    return V.dense_top_k(_vectors(spark, sf), _vector_queries(spark, sf), 10).select("query_id", "node_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"SELECT query_id, node_id, round(score, 6) AS score, rank FROM {_DENSE} WHERE rank < 10")
def rag_ivf_search(spark, sf):
    """Five in eight of the lists are searched, ten at least. Up to ten lists (549 vectors) these are all, so only there the result is exact and equals the SQL; recall is tested at sf0.1."""
    v = _vectors(spark, sf)
    c = V.train_centroids(v)
    at = fresh_path(spark, "ivf")
    write_index(V.assign_lists(v, c), at, {"type": "IVF_FLAT", "metric": "IP", "nlist": len(c), "nprobe": V.probe_count(len(c))})
    return V.ivf_search(load_index(spark, at)[0], c, _vector_queries(spark, sf), 10).select("query_id", "node_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_TERMS = "list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({}, '')), '([\\x{{4e00}}-\\x{{9fff}}])', ' \\1 ', 'g'), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]+'), lambda t: t <> '')"
_BM25 = f"""WITH d AS (SELECT doc_id, {_TERMS.format("text")} AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d),
tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM d) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT doc_id AS query_id, unnest(list_distinct({_TERMS.format("title")})) AS term FROM documents WHERE doc_id % 50 = 0),
sc AS (SELECT query_id, tf.doc_id AS node_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / a))), 9) AS score FROM q JOIN tf USING (term) JOIN df USING (term), s GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) - 1 AS rank FROM sc QUALIFY rank < 10)"""


def _text_queries(spark, sf):
    return read(spark, sf, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("title").alias("query"))


def _corpus(spark, sf):
    return read(spark, sf, "documents").select(F.col("doc_id").alias("node_id"), "text")


def _bm25(spark, sf):
    return V.bm25_top_k(_corpus(spark, sf), _text_queries(spark, sf), 10)


@query(_BM25 + " SELECT query_id, node_id, round(score, 6) AS score, rank FROM b")
def rag_bm25_topk(spark, sf):
    return _bm25(spark, sf).select("query_id", "node_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_RRF = (
    _BM25
    + f""", f AS (SELECT query_id, node_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT query_id, node_id, rank FROM b UNION ALL SELECT query_id, node_id, rank FROM {_DENSE} WHERE rank < 10) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) - 1 AS rank FROM f QUALIFY rank < 20)"""
)


def _fused(spark, sf):
    return V.reciprocal_rank_fusion([V.dense_top_k(_vectors(spark, sf), _vector_queries(spark, sf), 10), _bm25(spark, sf)], 20)


@query(_RRF + " SELECT query_id, node_id, round(score, 6) AS score, rank FROM r")
def rag_rrf(spark, sf):
    return _fused(spark, sf).select("query_id", "node_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_LEX = f"CASE WHEN len(qt) > 0 THEN len(list_filter(qt, lambda x: list_contains({_TERMS.format('child_text')}, x))) / CAST(len(qt) AS DOUBLE) ELSE 0.0 END"
_KIDS = (
    _RRF
    + f""", k AS (SELECT r.query_id, r.node_id, r.rank AS r0, i AS chunk_index, substring(x.text, i * 512 + 1, 512) AS child_text, list_distinct({_TERMS.format("q.title")}) AS qt FROM
  (SELECT r.*, unnest(range(CASE WHEN length(coalesce(d.text, '')) > 512 THEN CAST(ceil(length(d.text) / 512.0) AS INT) ELSE 1 END)) AS i FROM r JOIN documents d ON d.doc_id = r.node_id) r
  JOIN (SELECT doc_id, coalesce(text, '') AS text FROM documents) x ON x.doc_id = r.node_id JOIN documents q ON q.doc_id = r.query_id),
rr AS (SELECT query_id, node_id, chunk_index, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r0, node_id, chunk_index) - 1 AS rank FROM (SELECT *, {_LEX} AS score FROM k) QUALIFY rank < 10)"""
)


def _reranked(spark, sf, k):
    return V.rerank_children(_fused(spark, sf), _corpus(spark, sf), _text_queries(spark, sf), k)


@query(_KIDS + " SELECT query_id, node_id, chunk_index, round(score, 6) AS score, rank FROM rr")
def rag_split_rerank(spark, sf):
    return _reranked(spark, sf, 10).select("query_id", "node_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(_KIDS + " SELECT query_id, node_id, round(max(score), 6) AS score, count(*) AS matched_children FROM rr GROUP BY 1, 2")
def rag_parent_max(spark, sf):
    return V.restore_parents(_reranked(spark, sf, 10), _corpus(spark, sf), 10).select("query_id", "node_id", F.round("score", 6).alias("score"), "matched_children")


@query(
    f"""WITH t AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY score, node_id DESC) - 1 AS i, count(*) OVER (PARTITION BY query_id) AS n FROM {_DENSE} WHERE rank < 7)
SELECT query_id, node_id, CAST(CASE WHEN i % 2 = 0 THEN (n - 1) // 2 - i // 2 ELSE (n + 1) // 2 + (i - 1) // 2 END AS INT) AS position FROM t"""
)
def rag_reorder(spark, sf):
    return V.reorder(V.dense_top_k(_vectors(spark, sf), _vector_queries(spark, sf), 7)).select("query_id", "node_id", "position")


@query("SELECT vec_id, round(1 / (1 + exp(CAST(embedding[1] AS DOUBLE) - CAST(embedding[2] AS DOUBLE))), 9) AS hf, round(exp(CAST(embedding[2] AS DOUBLE)) / (exp(CAST(embedding[2] AS DOUBLE)) + exp(CASE WHEN vec_id % 3 = 0 THEN -10.0 ELSE CAST(embedding[1] AS DOUBLE) END)), 9) AS vllm FROM embeddings")
def rag_score_yesno(spark, sf):
    no, yes = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    return read(spark, sf, "embeddings").select("vec_id", F.round(X.yes_score(no, yes), 9).alias("hf"), F.round(X.yes_score_logprobs(yes, F.when(F.col("vec_id") % 3 != 0, no)), 9).alias("vllm"))


@query("SELECT count(*) AS n, CAST(CASE WHEN count(*) <= 10000 THEN greatest(1, count(*) // 50) ELSE floor(4 * sqrt(count(*))) END AS INT) AS nlist FROM embeddings")
def rag_list_count(spark, sf):
    return read(spark, sf, "embeddings").agg(F.count(F.lit(1)).alias("n")).select("n", X.list_count(F.col("n")).alias("nlist"))


@query()
def rag_pipeline(spark, sf):
    """The whole serving pipeline over the documents with hashed embeddings."""
    d = read(spark, sf, "documents")
    embed = V.hash_embedding()
    corpus = d.select(F.col("doc_id").alias("node_id"), "text", embed("text").alias("embedding"))
    queries = d.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.coalesce("title", F.lit("")).alias("text"), embed("title").alias("vector"))
    return V.context(V.retrieve(corpus, queries))


# tools ---------------------------------------------------------------------------------


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS date_only, strftime(ts, '%Y年%m月%d日') AS zh, ['星期一', '星期二', '星期三', '星期四', '星期五', '星期六', '星期日'][isodow(ts)] AS weekday_chinese, CAST(dayofyear(ts) AS INT) AS day_of_year, isodow(ts) >= 6 AS is_weekend, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS timestamp FROM events")
def tool_weekday_fields(spark, sf):
    f = Z.date_fields(F.col("ts"))
    return read(spark, sf, "events").select("event_id", f.alias("f"), Z.current_date(F.col("ts"), "YYYY年MM月DD日").alias("zh")).select("event_id", "f.date_only", "zh", "f.weekday_chinese", "f.day_of_year", "f.is_weekend", "f.timestamp")


_RATES = [("USD", "CNY", 7.09, 100.0, 709.0), ("EUR", "CNY", 8.41, 100.0, 841.0), ("JPY", "CNY", 4.73, 100.0, 473.0)]


@query(
    """WITH r(f, t, rate, a, s) AS (VALUES ('USD', 'CNY', 7.09, 100.0, 709.0), ('EUR', 'CNY', 8.41, 100.0, 841.0), ('JPY', 'CNY', 4.73, 100.0, 473.0)),
q AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'JPY' ELSE 'KRW' END AS f, floor(o_totalprice) AS amount FROM orders)
SELECT id, CASE WHEN rate IS NULL THEN 404 ELSE 200 END AS status_code, CASE WHEN amount = a THEN CAST(s AS DOUBLE) ELSE round(amount * CAST(rate AS DOUBLE), 2) END AS converted FROM q LEFT JOIN r ON q.f = r.f"""
)
def tool_fx_convert(spark, sf):
    rates = spark.createDataFrame(_RATES, "from_currency string, to_currency string, rate double, stored_amount double, stored double").withColumn("pair", Z.pair_key(F.col("from_currency"), F.col("to_currency"))).drop("from_currency", "to_currency")
    k = F.col("o_orderkey") % 4
    asked = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), Z.pair_key(F.when(k == 0, "usd").when(k == 1, "eur").when(k == 2, "jpy").otherwise("krw"), F.lit("cny")).alias("pair"), F.floor("o_totalprice").cast("double").alias("amount"))
    return L.lookup(asked, rates, ["pair"]).select("id", "status_code", Z.fx_convert(F.col("amount"), F.col("rate"), F.col("stored_amount"), F.col("stored")).alias("converted"))


@query("SELECT t.transaction_id, t.merchant_id, t.ingest_time, CASE WHEN t.status <> 'SUCCESS' THEN 401 WHEN m.merchant_id IS NULL THEN 404 ELSE 200 END AS status_code, CASE WHEN t.status = 'SUCCESS' THEN m.merchant_name END AS merchant_name FROM transaction_flow t LEFT JOIN merchant_info m ON t.merchant_id = m.merchant_id")
def tool_bill_lookup(spark, sf):
    asked = read(spark, sf, "transaction_flow").select("transaction_id", "merchant_id", "ingest_time", "status")
    table = read(spark, sf, "merchant_info").select("merchant_id", "merchant_name")
    return L.lookup(asked, table, ["merchant_id"], L.authorized(F.col("status"), F.lit("k"), "SUCCESS", "k")).select("transaction_id", "merchant_id", "ingest_time", "status_code", "merchant_name")


@query("WITH p AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT (SELECT count(*) FROM events) AS total_calls, (SELECT count(*) FROM events WHERE user_id % 2 = 0) AS local_calls, (SELECT count(*) FROM events WHERE user_id % 2 <> 0) AS http_calls, (SELECT round(avg(round(value, 3)), 2) FROM events) AS average_duration, (SELECT string_agg(event_type || '=' || n, ';' ORDER BY event_type) FROM p) AS calls_by_tool, (SELECT count(*) FROM p) AS unique_tools")
def tool_call_stats(spark, sf):
    log = read(spark, sf, "events").select(F.col("event_type").alias("tool"), F.when(F.col("user_id") % 2 == 0, "local").otherwise("http").alias("type"), F.round("value", 3).alias("duration"))
    return Q.call_statistics(log)


_EXPRESSIONS = ["7+6*(2+3)-8/2+sqrt(6)+3^2", "12345678912^2", "10÷4×2", "max([1,2,3])", "abs(-3) > 2", "1/0", "", "__import__('os')", "2^100000000"]


@query("SELECT * FROM (VALUES (0, true, '44.44948974278318', 'float'), (1, true, '152415787798201503744', 'int'), (2, true, '5.0', 'float'), (3, true, '3', 'int'), (4, true, 'True', 'bool'), (5, false, NULL, NULL), (6, false, NULL, NULL), (7, false, NULL, NULL), (8, false, NULL, NULL)) v(id, success, result, type)")
def tool_calc(spark, sf):
    d = spark.createDataFrame(list(enumerate(_EXPRESSIONS)), "id int, x string")
    return d.select("id", Z.calculate_column(F.col("x")).alias("r")).select("id", "r.success", "r.result", "r.type")


@query("SELECT l_orderkey, l_linenumber, l_partkey, (l_quantity * l_extendedprice - 2 ** 3) / nullif(l_discount, 0) AS v FROM lineitem")
def tool_calc_column(spark, sf):
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", Z.compile_expression("(l_quantity × l_extendedprice - 2^3) ÷ l_discount").alias("v"))


@query("SELECT o_orderkey, CAST(o_custkey AS DECIMAL(38,0)) * CAST(o_orderkey AS DECIMAL(38,0)) AS p FROM orders".replace("CAST(o_custkey AS DECIMAL(38,0)) * CAST(o_orderkey AS DECIMAL(38,0))", "CAST(o_custkey AS BIGINT) * o_orderkey"))
def tool_exact_product(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", Z.exact_product(F.col("o_custkey"), F.col("o_orderkey")).cast("long").alias("p"))


@query("SELECT * FROM (VALUES (1, 'number'), (2, 'boolean'), (3, 'array'), (4, 'string'), (5, 'number')) v(id, kind)")
def tool_param_types(spark, sf):
    rows = [(1, "an Integer amount"), (2, "bool flag"), (3, "a list of names"), (4, "源货币代码"), (5, "float value")]
    return spark.createDataFrame(rows, "id int, d string").select("id", Z.parameter_type(F.col("d")).alias("kind"))


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS batch FROM orders")
def batch_number(spark, sf):
    return Q.batch_numbers(read(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 100)


_CATALOG = [("orders", "customer orders", "o_orderkey:key, unique,o_custkey:customer"), ("nation", "nations", None)]


@query("SELECT * FROM (VALUES ('orders', '表名: orders' || chr(10) || '描述: customer orders' || chr(10) || '字段描述:' || chr(10) || '  - o_orderkey:key' || chr(10) || '  - unique' || chr(10) || '  - o_custkey:customer' || chr(10) || chr(10)), ('nation', '表名: nation' || chr(10) || '描述: nations' || chr(10) || '字段描述: 无可用描述' || chr(10) || chr(10))) v(t, prompt)")
def catalog_prompt(spark, sf):
    d = spark.createDataFrame(_CATALOG, "t string, d string, f string")
    return d.select("t", K.prompt_text(F.col("d"), F.col("t"), F.col("f")).alias("prompt"))


@query("SELECT * FROM (VALUES ('orders', 0, 'o_orderkey', 'key, unique'), ('orders', 1, 'o_custkey', 'customer')) v(\"table\", ordinal, \"column\", comment)")
def catalog_columns(spark, sf):
    return K.catalog_columns(spark.createDataFrame(_CATALOG, "Table string, Description string, Fields string"))


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(q, '{words}') THEN '{name}'" for name, words in Q.ROUTES) + f" ELSE '{Q.RETRIEVAL}' END AS tool FROM (SELECT doc_id, lower(coalesce(title, '')) AS q FROM documents)")
def router_routes(spark, sf):
    """Tools for every document's title as a question."""
    d = read(spark, sf, "documents")
    return d.select("doc_id", Q.route(F.col("title")).alias("tool"))


@query("SELECT user_id AS chat, string_agg(event_type, chr(10) ORDER BY event_id) AS answer FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3) GROUP BY 1")
def agent_last_results(spark, sf):
    m = read(spark, sf, "events").select(F.col("user_id").alias("chat"), F.col("event_id").alias("seq"), F.col("event_type").alias("content"))
    return Q.last_results(m)


@query("SELECT user_id AS chat, event_type AS source, arg_max(CAST(event_id AS VARCHAR), event_id) AS content FROM events GROUP BY 1, 2")
def agent_latest_per_source(spark, sf):
    m = read(spark, sf, "events").select(F.col("user_id").alias("chat"), F.col("event_type").alias("source"), F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("content"))
    return L.latest_per_source(m)


NOW = datetime(2025, 9, 20, 8, 30, 15)


@query("SELECT '2025-09-20' AS d, 'Saturday, September 20, 2025 08:30:15' AS full_, '星期六' AS w, true AS e")
def tool_current_date(spark, sf):
    n = F.lit(NOW)
    return spark.range(1).select(Z.current_date(n, "yyyy-mm-dd").alias("d"), Z.current_date(n, "FULL").alias("full_"), Z.chinese_weekday(n).alias("w"), Z.is_weekend(n).alias("e"))
