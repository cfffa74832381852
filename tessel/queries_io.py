"""Queries of sources, sinks and text functions: real tables written, read back by the operator and compared with SQL."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path
from urllib.parse import urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import Window
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
from tessel.plans.lineage import fresh_path, keep_table
from tessel.plans.sql import ask, reading_session
from tessel.queries_docs import _KIDS, _NODES as _TREE, _outlines, read
from tessel.sources import files as S
from tessel.sources import sinks as W
from tessel.sources.tool_specs import read_specs

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


# files ------------------------------------------------------------------------------


@query("SELECT n_name AS t, '表名: ' || n_name || chr(10) || '描述: nation \"' || n_nationkey || '\", one' || chr(10) || CASE WHEN n_nationkey % 5 = 0 THEN '字段描述: 无可用描述' || chr(10) ELSE '字段描述:' || chr(10) || '  - n_regionkey:region ' || n_regionkey || chr(10) || '  - n_name:the name' || chr(10) END || chr(10) AS prompt FROM nation")
def io_catalog_csv(spark, sf):
    """A catalog file written, read and rendered."""
    k = F.col("n_nationkey").cast("string")
    rows = read(spark, sf, "nation").select(F.col("n_name").alias("Table"), F.concat(F.lit('nation "'), k, F.lit('", one')).alias("Description"), F.when(F.col("n_nationkey") % 5 != 0, F.concat(F.lit("n_regionkey:region "), F.col("n_regionkey").cast("string"), F.lit(",n_name:the name"))).alias("Fields"))
    at = fresh_path(spark, "catalog")
    rows.write.csv(at, header=True, escape='"')
    return K.read_catalog(spark, at).select(F.col("Table").alias("t"), K.prompt_text(F.col("Description"), F.col("Table"), F.col("Fields")).alias("prompt"))


@query("SELECT institution_id, institution_name, institution_type, license_no, legal_entity, contact_phone, contact_email, status, create_time FROM institution_info")
def io_star_script(spark, sf):
    """The star's DDL, bulk inserts in batches, run as a script and scanned at the end."""
    schema, name = K.STAR["institution_info"], f"tessel_script_{uuid.uuid4().hex}"
    rows = read(spark, sf, "institution_info").collect()  # a table of forty rows at every scale
    keep_table(spark, name)
    S.run_script(spark, ";\n".join([f"-- {name}\nDROP TABLE IF EXISTS {name}", K.create_statement(name, schema, fresh_path(spark, name)), *K.insert_statements(name, schema, rows, 16)]) + ";")
    return spark.table(name)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def io_jdbc(spark, sf):
    """A table over JDBC. Derby runs within a process, so a database in memory or one that is being written is seen by one JVM alone: the driver fills it and packs it into an archive in the shared folder, which any number of executors open for reading."""
    t = read(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    at = f"{fresh_path(spark, 'jdbc')}/nation.jar"
    W.write_bytes(spark, at, _derby(spark, t, "NATION"))
    return S.read_table(spark, f"jdbc:derby:jar:({urlparse(at).path})db", "NATION", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").select(*t.columns)


_DERBY = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR(32672)"}


def _derby(spark, rows, table: str) -> bytes:
    """A Derby database ``db`` with one small table, as an archive."""
    drivers, raw = spark._jvm.java.sql.DriverManager, io.BytesIO()
    with tempfile.TemporaryDirectory() as folder:
        c = drivers.getConnection(f"jdbc:derby:{folder}/db;create=true")
        c.createStatement().execute(f"CREATE TABLE {table} ({', '.join(f'"{n}" {_DERBY[k]}' for n, k in rows.dtypes)})")
        put = c.prepareStatement(f"INSERT INTO {table} VALUES ({', '.join('?' * len(rows.columns))})")
        for r in rows.collect():  # a table of twenty-five rows at every scale
            for i, v in enumerate(r):
                put.setString(i + 1, None if v is None else str(v))
            put.executeUpdate()
        c.close()
        try:
            drivers.getConnection(f"jdbc:derby:{folder}/db;shutdown=true")
        except Py4JJavaError:  # how Derby says that it has shut down
            pass
        with zipfile.ZipFile(raw, "w") as z:
            for p in sorted(Path(folder, "db").rglob("*")):
                z.write(p, p.relative_to(folder))
    return raw.getvalue()


_WNS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_SNS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def _zip(**parts: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, xml in parts.items():
            z.writestr(name.replace("__", "/") + ".xml", xml)
    return out.getvalue()


def _docx(name: str, key: int) -> bytes:
    """A heading by style, one by outline level, one by numbering, a list, text and a table."""
    p = lambda t, props="": f"<w:p>{f'<w:pPr>{props}</w:pPr>' if props else ''}<w:r><w:t>{t}</w:t></w:r></w:p>"
    body = [p(name, '<w:pStyle w:val="H"/>'), p("Level", '<w:outlineLvl w:val="2"/>'), p("1.2 Number"), p("item", '<w:numPr><w:ilvl w:val="1"/></w:numPr>'), p(f"body {key}"), f"<w:tbl><w:tr><w:tc>{p('k')}</w:tc><w:tc>{p(str(key))}</w:tc></w:tr></w:tbl>"]
    return _zip(word__styles=f'<w:styles {_WNS}><w:style w:styleId="H"><w:name w:val="heading 1"/></w:style></w:styles>', word__document=f"<w:document {_WNS}><w:body>{''.join(body)}</w:body></w:document>")


def _xlsx(rows: list[list[str]], sheet: str = "S") -> bytes:
    cell = lambda r, c, v: f'<c r="{chr(65 + c)}{r + 1}" t="inlineStr"><is><t>{v}</t></is></c>'
    data = "".join(f'<row r="{i + 1}">{"".join(cell(i, j, v) for j, v in enumerate(r) if v != "")}</row>' for i, r in enumerate(rows))
    return _zip(xl__workbook=f'<workbook {_SNS}><sheets><sheet name="{sheet}"/></sheets></workbook>', xl__worksheets__sheet1=f"<worksheet {_SNS}><sheetData>{data}</sheetData></worksheet>")


@query(
    """SELECT name, extension, CASE extension WHEN 'md' THEN 'Heading 1: ' || n_name || chr(10) || 'Paragraph: line one line two' || chr(10) || 'Paragraph: | a | b |' || chr(10) || 'Paragraph: | 1 | ' || k || ' |' || chr(10) || 'Paragraph: - item'
 WHEN 'txt' THEN 'Heading 1: ' || k || chr(10) || 'Paragraph: region of ' || n_name
 WHEN 'docx' THEN 'Heading 1: ' || n_name || chr(10) || 'Heading 3: Level' || chr(10) || 'Heading 2: 1.2 Number' || chr(10) || 'Paragraph:   - item' || chr(10) || 'Paragraph: body ' || k || chr(10) || 'Paragraph: | k | ' || k || ' |'
 WHEN 'xlsx' THEN 'Heading 1: S' || chr(10) || 'Heading 2: | id | name |' || chr(10) || 'Paragraph: | ' || k || ' | ' || n_name || ' |' END AS outline, extension = 'pdf' AS failed, row_number() OVER (ORDER BY name) AS at
 FROM (SELECT *, CAST(n_nationkey AS VARCHAR) AS k, n_nationkey || '.' || ['md', 'txt', 'docx', 'xlsx', 'pdf'][n_regionkey + 1] AS name, ['md', 'txt', 'docx', 'xlsx', 'pdf'][n_regionkey + 1] AS extension FROM nation)"""
)
def io_files(spark, sf):
    """A folder of files of every kind, a spoilt one among them, listed by path and read."""
    at = fresh_path(spark, "files")
    for r in read(spark, sf, "nation").collect():  # 25 rows at every scale
        k, n = r["n_nationkey"], r["n_name"]
        kinds = [("md", f"# {n}\n\nline one\nline two\n\n| a | b |\n|---|---|\n| 1 | {k} |\n\n- item\n".encode()), ("txt", f"region of {n}".encode("utf-8-sig")), ("docx", _docx(n, k)), ("xlsx", _xlsx([["id", "name"], [str(k), n], ["", ""]])), ("pdf", b"no such file")]
        ext, raw = kinds[r["n_regionkey"]]
        W.write_bytes(spark, f"{at}/{'sub/' if k % 2 else ''}{k}.{ext}", raw)
    W.write_bytes(spark, f"{at}/other.exe", b"x")
    out = S.read_outlines(S.list_files(spark, at, ordered=True), workers=4)
    return out.select("name", "extension", "outline", F.col("error").isNotNull().alias("failed"), F.row_number().over(Window.orderBy("name")).alias("at"))


_TXT = "SELECT doc_id, 'Heading 1: ' || doc_id || chr(10) || 'Paragraph: ' || coalesce(text, '') AS o FROM documents"


def _text_files(spark, sf):
    d = read(spark, sf, "documents")
    name = F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 50 == 7, ".md").otherwise(".txt"))
    return d.select(F.concat(F.lit("in/"), name).alias("path"), name.alias("name"), F.element_at(F.split(name, "\\."), -1).alias("extension"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))


@query(f"SELECT doc_id || '.txt' AS name, md5(o) AS hash, length(o) AS n FROM ({_TXT}) WHERE doc_id % 50 <> 7 UNION ALL SELECT doc_id || '.md', NULL, NULL FROM documents WHERE doc_id % 50 = 7")
def io_text_outlines(spark, sf):
    """Every document as a text file through the readers, those of one kind failing."""
    o = S.read_outlines(_text_files(spark, sf), {"txt": S.text_outline, "md": _broken}, workers=8)
    return o.select("name", F.md5(F.col("outline").cast("binary")).alias("hash"), F.length("outline").cast("long").alias("n"))


def _broken(raw: bytes, name: str) -> str:
    raise ValueError("broken")


@query("SELECT count(*) FILTER (WHERE doc_id % 50 <> 7) AS success, count(*) FILTER (WHERE doc_id % 50 = 7) AS failed, string_agg('in/' || doc_id || '.md', ',' ORDER BY 'in/' || doc_id || '.md') FILTER (WHERE doc_id % 50 = 7) AS failed_files FROM documents")
def io_conversion(spark, sf):
    """Counters and failed files of a conversion."""
    o = S.read_outlines(_text_files(spark, sf), {"txt": S.text_outline, "md": _broken})
    return R.conversion_result(o.select("path", F.col("error").isNull().alias("ok"))).select("success", "failed", F.array_join("failed_files", ",").alias("failed_files"))


@query("SELECT doc_id AS id, coalesce(source, '') AS segments, CAST(doc_id % 7 AS VARCHAR) AS paper, CASE WHEN doc_id % 3 = 0 THEN '选择题' ELSE '问答题' END AS category, trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g')) AS question, CASE WHEN doc_id % 3 = 0 THEN 'A. x, \"y\"' || chr(10) || 'B. z' END AS content FROM documents")
def io_questions_csv(spark, sf):
    """A question sheet, only the needed columns being read."""
    k = F.col("doc_id") % 3 == 0
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("segments"), (F.col("doc_id") % 7).cast("string").alias("paper"), F.when(k, "选择题").otherwise("问答题").alias("category"), X.normalize_space(F.coalesce("title", F.lit(""))).alias("question"), F.when(k, 'A. x, "y"\nB. z').alias("content"), F.lit("unused").alias("other"))
    at = fresh_path(spark, "questions")
    d.write.csv(at, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    q = S.read_questions(spark, at)
    return q.select(F.col("id").cast("long").alias("id"), F.coalesce("segments", F.lit("")).alias("segments"), "paper", "category", F.coalesce("question", F.lit("")).alias("question"), "content")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS question FROM nation")
def io_questions_xlsx(spark, sf):
    """A question sheet of a workbook."""
    at = fresh_path(spark, "questions") + ".xlsx"
    W.write_bytes(spark, at, _xlsx([["other", "question", "id"], *[["x", r["n_name"], str(r["n_nationkey"])] for r in read(spark, sf, "nation").collect()]]))  # 25 rows
    return S.read_questions(spark, at, ("id", "question"))


@query("SELECT 'tool_' || n_nationkey AS name, CASE WHEN n_regionkey < 3 THEN 'http' ELSE 'local' END AS kind, 'about: ' || n_name AS description, CASE WHEN n_regionkey < 3 THEN 'http://host/' || n_nationkey END AS url, CASE WHEN n_regionkey < 3 THEN CASE WHEN n_nationkey % 2 = 0 THEN 'POST' ELSE 'GET' END END AS method, CASE WHEN n_regionkey = 4 THEN '' ELSE 'code,amount' END AS required FROM nation")
def io_tool_specs(spark, sf):
    """Specifications of tools from text and JSON files."""
    at = fresh_path(spark, "tools")
    for r in read(spark, sf, "nation").collect():  # 25 rows
        k, n, g = r["n_nationkey"], r["n_name"], r["n_regionkey"]
        if g == 4:
            W.write_bytes(spark, f"{at}/{k}.json", f'{{"name": "tool_{k}", "description": "about: {n}"}}'.encode())
            continue
        lines = [f"name: tool_{k}", f"description: about: {n}", *([f"http_url: http://host/{k}", *(["http_method: post"] if k % 2 == 0 else [])] if g < 3 else []), "parameters:", "  code: a code", "  amount: a number", "required: [code, amount]"]
        W.write_bytes(spark, f"{at}/{k}.txt", "\n".join(lines).encode())
    return read_specs(spark, at).select("name", "kind", "description", "url", "method", F.array_join("required", ",").alias("required"))


# sinks --------------------------------------------------------------------------------


def _chunks(spark, sf):
    return read(spark, sf, "text_chunk").withColumnsRenamed({"file_id": "doc_id", "source_node_index": "node_idx"}).withColumn("content", F.coalesce("content", F.lit("")))


@query("SELECT file_id, 'part_' || lpad(CAST(row_number() OVER (PARTITION BY file_id ORDER BY source_node_index, chunk_index) AS VARCHAR), CAST(greatest(4, length(CAST(count(*) OVER (PARTITION BY file_id) AS VARCHAR))) AS INT), '0') || '.txt' AS file_name, md5(coalesce(content, '')) AS hash FROM text_chunk")
def io_chunk_files(spark, sf):
    """K1: chunk files with zero-padded numbers, written and read back."""
    at = fresh_path(spark, "chunks")
    W.write_chunk_files(_chunks(spark, sf).select("doc_id", "node_idx", "chunk_index", "content"), at, "part")
    return S.read_chunk_files(spark, at).select(F.col("doc_id").cast("long").alias("file_id"), "file_name", F.md5(F.col("value").cast("binary")).alias("hash"))


@query("SELECT chunk_id, file_id, content, array_to_string(path_titles, ' > ') AS path FROM text_chunk")
def io_chunk_json(spark, sf):
    """Rows as JSON, written and read back."""
    c, at = read(spark, sf, "text_chunk").select("chunk_id", "file_id", "content", "path_titles"), fresh_path(spark, "json")
    W.write_json(c, at)
    return spark.read.schema(c.schema).json(at).select("chunk_id", "file_id", "content", F.array_join("path_titles", " > ").alias("path"))


_CHUNK_PATHS = "array_to_string(list_filter(coalesce(path_titles, []), lambda t: t IS NOT NULL), ' > ')"


@query(f"SELECT file_id AS doc_id, 'node ' || source_node_index AS k, string_agg(chunk_id, ',' ORDER BY chunk_id) AS ids, any_value(n) AS total_chunks FROM (SELECT *, count(*) OVER (PARTITION BY file_id) AS n FROM text_chunk) GROUP BY file_id, source_node_index UNION ALL SELECT file_id, 'path ' || p, string_agg(chunk_id, ',' ORDER BY chunk_id), any_value(n) FROM (SELECT *, {_CHUNK_PATHS} AS p, count(*) OVER (PARTITION BY file_id) AS n FROM text_chunk) GROUP BY file_id, p")
def io_chunk_index(spark, sf):
    """K3, A3: the index of chunks by node and by path, as JSON, with both its maps."""
    c = _chunks(spark, sf).withColumn("path_titles", F.filter(F.coalesce("path_titles", F.array().cast("array<string>")), lambda t: t.isNotNull()))
    at = fresh_path(spark, "index")
    W.write_chunk_index(c, at)
    back = spark.read.schema("doc_id long, total_chunks long, chunks_by_node map<string,array<string>>, chunks_by_path map<string,array<string>>").json(at)
    part = lambda m, name: back.select("doc_id", "total_chunks", F.explode(m).alias("k", "v")).select("doc_id", F.concat(F.lit(name), "k").alias("k"), F.array_join("v", ",").alias("ids"), "total_chunks")
    return part("chunks_by_node", "node ").unionByName(part("chunks_by_path", "path "))


@query("SELECT file_id AS doc_id, CAST(count(*) AS BIGINT) AS n_lines, count(*) FILTER (WHERE node_type = 'heading') AS n_headings FROM (SELECT DISTINCT file_id, node_index, node_type FROM document_node WHERE node_type <> 'root') GROUP BY 1")
def io_tree_files(spark, sf):
    """K4: one text file a document, written and read back."""
    at = fresh_path(spark, "texts")
    W.write_texts(_outlines(spark, sf).repartition(4), "text", at)
    lines = spark.read.text(at).where("value <> ''")
    return lines.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("value").startswith("Heading")).alias("n_headings"))


@query("SELECT chunk_id, file_id, source_node_index, content FROM text_chunk")
def io_nodes(spark, sf):
    """Nodes written and loaded."""
    at = fresh_path(spark, "nodes")
    W.write_nodes(read(spark, sf, "text_chunk").select("chunk_id", "file_id", "source_node_index", "content"), at)
    return W.load_nodes(spark, at)


@query("SELECT vec_id AS node_id, label AS centroid_id, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS s, '7' AS nlist, true AS there FROM embeddings")
def io_vector_index(spark, sf):
    """An index partitioned by list with its description, written twice, loaded."""
    at = fresh_path(spark, "index")
    v = read(spark, sf, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").alias("centroid_id"))
    W.write_index(v.limit(3), at, {"nlist": 1})
    W.write_index(v, at, {"nlist": 7, "metric": "IP"})
    back, info = W.load_index(spark, at)
    return back.select("node_id", F.col("centroid_id").cast("int").alias("centroid_id"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6).alias("s"), F.lit(info["nlist"]).alias("nlist"), F.lit(W.exists(spark, at)).alias("there"))


@query("SELECT event_type AS k, 2 * count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'step ' || s, 1 FROM (VALUES ('first'), ('second')) v(s)")
def io_log(spark, sf):
    """A log appended to twice, and the times of steps."""
    at, times = fresh_path(spark, "log"), fresh_path(spark, "times")
    e = read(spark, sf, "events").select("event_id", "event_type")
    W.timed(spark, {"first": lambda: W.append_log(e, at), "second": lambda: W.append_log(e, at)}, times)
    steps = spark.read.parquet(times).where("elapsed > 0 and logged_at is not null").select(F.concat(F.lit("step "), "step").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return spark.read.parquet(at).groupBy(F.col("event_type").alias("k")).agg(F.count(F.lit(1)).alias("n")).unionByName(steps)


# reports ------------------------------------------------------------------------------

_NODES = "(SELECT DISTINCT file_id, node_index, node_type, text, len(coalesce(tables, [])) AS nt FROM document_node WHERE node_type <> 'root')"
_KIND = "CASE WHEN nt > 0 THEN 'table' WHEN node_index % 7 = 3 THEN 'page_footer' WHEN node_index % 11 = 5 THEN 'picture' WHEN node_type = 'heading' THEN 'section_header' ELSE 'text' END"


def _reports(spark, sf):
    """The nodes of a file as a report with pages of ten blocks."""
    d = read(spark, sf, "document_node").where("node_type <> 'root'").select("file_id", "node_index", "node_type", "text", F.coalesce(F.size("tables"), F.lit(0)).alias("nt")).distinct()
    kind = F.expr(_KIND)
    table = F.when(F.col("nt") > 0, F.col("node_index"))
    block = F.struct("node_index", F.struct(F.col("text"), kind.alias("type"), F.col("node_index").alias("text_id"), table.alias("table_id")).alias("b"))
    pages = d.groupBy("file_id", (F.floor(F.col("node_index") / 10) + 1).cast("int").alias("page")).agg(F.array_sort(F.collect_list(block)).alias("bs"), F.collect_list(F.when(F.col("nt") > 0, F.struct(F.col("node_index").alias("table_id"), F.concat(F.lit("| T"), F.col("node_index").cast("string"), F.lit(" |")).alias("markdown")))).alias("ts"))
    content = F.array_sort(F.collect_list(F.struct("page", F.transform("bs", lambda x: x["b"]).alias("content"))))
    return pages.groupBy("file_id").agg(content.alias("content"), F.flatten(F.collect_list("ts")).alias("tables")).select(F.struct(F.col("file_id").cast("string").alias("sha1_name")).alias("metainfo"), "content", "tables")


def _report_blocks(spark, sf):
    at = fresh_path(spark, "reports")
    W.write_json(_reports(spark, sf), at)
    r = spark.read.schema(R.REPORT_DDL).json(at)
    return R.with_tables(R.filter_blocks(R.blocks_of(r)), R.tables_of(r))


@query(
    f"SELECT CAST(file_id AS VARCHAR) AS doc_id, page, CAST(pos AS INT) AS pos, type, text, CASE WHEN type = 'table' THEN '| T' || node_index || ' |' END AS rendered FROM (SELECT *, {_KIND} AS type, CAST(floor(node_index / 10) + 1 AS INT) AS page, row_number() OVER (PARTITION BY file_id, floor(node_index / 10) ORDER BY node_index) - 1 AS pos FROM {_NODES}) WHERE type NOT IN ('page_footer', 'picture')"
)
def io_report_blocks(spark, sf):
    """Reports as JSON, read back as blocks, footers and pictures dropped, tables joined."""
    return _report_blocks(spark, sf).select("doc_id", "page", "pos", "type", "text", "rendered")


@query("WITH b AS (SELECT DISTINCT file_id, node_index, CAST(floor(node_index / 30) + 1 AS INT) AS page FROM document_node WHERE node_type <> 'root') SELECT file_id AS doc_id, count(DISTINCT page) AS pages_amount, count(*) AS text_blocks_amount, CASE WHEN file_id % 3 <> 0 THEN 'Bank \"' || file_id || '\" Ltd' END AS company_name FROM b GROUP BY file_id")
def io_company_names(spark, sf):
    """Company names of a CSV file, joined to the counts of reports."""
    d = read(spark, sf, "document_node").where("node_type <> 'root'").select("file_id", "node_index").distinct()
    at = fresh_path(spark, "companies")
    d.select("file_id").distinct().where("file_id % 3 <> 0").select(F.col("file_id").alias("sha1"), F.concat(F.lit('""Bank "'), F.col("file_id").cast("string"), F.lit('" Ltd"')).alias("name")).write.csv(at, header=True, escape='"')
    blocks = d.select(F.col("file_id").cast("string").alias("doc_id"), (F.floor(F.col("node_index") / 30) + 1).cast("int").alias("page"), F.lit("text").alias("type"))
    none = spark.createDataFrame([], "doc_id string")
    return R.metainfo(blocks, none, none, S.read_companies(spark, at)).select(F.col("doc_id").cast("long").alias("doc_id"), "pages_amount", "text_blocks_amount", "company_name")


@query("WITH d AS (SELECT DISTINCT file_id, node_index, parent_index, text FROM document_node WHERE parent_index IS NOT NULL), t AS (SELECT DISTINCT file_id, node_index, text FROM document_node) SELECT d.file_id AS doc_id, d.node_index AS pos, d.parent_index AS idx, t.text FROM d JOIN t ON t.file_id = d.file_id AND t.node_index = d.parent_index")
def report_references(spark, sf):
    """References to items by kind and number."""
    d = read(spark, sf, "document_node")
    body = d.where("parent_index is not null").select(F.col("file_id").alias("doc_id"), F.col("node_index").alias("pos"), F.concat(F.lit("#/texts/"), F.col("parent_index").cast("string")).alias("ref"), "text").distinct().drop("text")
    items = d.select(F.col("file_id").alias("doc_id"), F.lit("texts").alias("kind"), F.col("node_index").alias("idx"), "text").distinct()
    return R.resolve_refs(body, items).select("doc_id", "pos", "idx", "text")


@query("WITH d AS (SELECT file_id, node_index, any_value(parent_index) AS p FROM document_node WHERE node_type = 'paragraph' GROUP BY 1, 2), g AS (SELECT file_id, p AS idx, list_sort(list(node_index)) AS kids FROM d WHERE p IS NOT NULL GROUP BY 1, 2) SELECT file_id AS doc_id, idx AS pos, CAST(k AS INT) AS sub, '#/texts/' || kids[k + 1] AS ref, idx AS group_id, 'group ' || idx AS group_name, 'list' AS group_label FROM (SELECT *, unnest(range(len(kids))) AS k FROM g) UNION ALL SELECT file_id, -1, 0, '#/texts/0', NULL, NULL, NULL FROM g GROUP BY file_id")
def report_groups(spark, sf):
    """References to groups replaced by the groups' children."""
    d = read(spark, sf, "document_node").where("node_type = 'paragraph'").groupBy(F.col("file_id").alias("doc_id"), "node_index").agg(F.max("parent_index").alias("idx")).where("idx is not null")
    groups = d.groupBy("doc_id", "idx").agg(F.sort_array(F.collect_list("node_index")).alias("kids")).select("doc_id", "idx", F.concat(F.lit("group "), F.col("idx").cast("string")).alias("name"), F.lit("list").alias("label"), F.transform("kids", lambda k: F.concat(F.lit("#/texts/"), k.cast("string"))).alias("children"))
    body = groups.select("doc_id", F.col("idx").alias("pos"), F.concat(F.lit("#/groups/"), F.col("idx").cast("string")).alias("ref")).unionByName(groups.select("doc_id").distinct().select("doc_id", F.lit(-1).alias("pos"), F.lit("#/texts/0").alias("ref")))
    return R.expand_groups(body, groups)


@query(f"SELECT file_id AS doc_id, CAST(floor(node_index / 10) + 1 AS INT) AS page, string_agg(node_index || ':' || node_type, ',' ORDER BY node_index) AS blocks FROM {_NODES} GROUP BY 1, 2")
def report_page_blocks(spark, sf):
    """Items grouped by page in reading order."""
    d = read(spark, sf, "document_node").where("node_type <> 'root'").select(F.col("file_id").alias("doc_id"), (F.floor(F.col("node_index") / 10) + 1).cast("int").alias("page"), F.col("node_index").alias("pos"), F.col("node_type").alias("type"), "text").distinct()
    return R.pages_of(d).select("doc_id", "page", F.array_join(F.transform("blocks", lambda b: F.concat(b["pos"].cast("string"), F.lit(":"), b["type"])), ",").alias("blocks"))


@query(f"WITH p AS (SELECT DISTINCT file_id, CAST(floor(node_index / 10) + 1 AS INT) AS page FROM {_NODES}) SELECT p.file_id AS doc_id, p.page, coalesce(string_agg('Heading ' || l || ': ' || t, '|' ORDER BY node_index), '') AS headings FROM p LEFT JOIN (SELECT DISTINCT file_id, node_index, coalesce(level, 1) AS l, coalesce(text, '') AS t FROM document_node WHERE node_type = 'heading') h ON h.file_id = p.file_id AND CAST(floor(h.node_index / 10) + 1 AS INT) = p.page GROUP BY 1, 2")
def report_page_headings(spark, sf):
    """The headings that a table of contents puts on each page."""
    d = read(spark, sf, "document_node").where("node_type <> 'root'").withColumn("page", (F.floor(F.col("node_index") / 10) + 1).cast("int")).withColumnRenamed("file_id", "doc_id")
    toc = d.where("node_type = 'heading'").select("doc_id", "page", F.coalesce("level", F.lit(1)).alias("level"), F.coalesce("text", F.lit("")).alias("title"), F.col("node_index").alias("pos")).distinct()
    return R.page_headings(d.select("doc_id", "page").distinct(), toc).select("doc_id", "page", F.array_join("headings", "|").alias("headings"))


@query("SELECT file_id, node_index, 'start ' || ' and ' || ' end' AS rest FROM (SELECT DISTINCT file_id, node_index FROM document_node WHERE len(list_filter(flatten(list_transform(coalesce(tables, []), lambda t: flatten(t.rows))), lambda c: c IS NOT NULL AND trim(c) <> '')) > 0)")
def report_cells_removed(spark, sf):
    """Page text without the texts of its tables' cells."""
    d = read(spark, sf, "document_node").select("file_id", "node_index", "tables").distinct()
    rows = F.transform(F.coalesce("tables", F.array().cast(d.schema["tables"].dataType)), lambda t: t["rows"])
    cells = F.filter(F.flatten(F.flatten(rows)), lambda c: F.coalesce(F.trim(c), F.lit("")) != "")
    long = F.reverse(F.array_sort(F.transform(cells, lambda c: F.struct(F.length(F.trim(c)).alias("n"), F.trim(c).alias("c")))))
    text = F.concat(F.lit("start "), F.array_join(F.transform(long, lambda c: c["c"]), "\u0001"), F.lit(" and "), F.get(long, F.lit(0))["c"], F.lit(" end"))
    kept = d.where(F.size(cells) > 0).select("file_id", "node_index", rows.alias("rows"), text.alias("t"))
    return kept.select("file_id", "node_index", F.regexp_replace(R.without_cells(F.col("t"), F.col("rows")), "\u0001", "").alias("rest"))


@query("SELECT 'in/' || doc_id || '.txt' AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM reading_labels) AND doc_id % 5 <> 0")
def doc_incremental_two(spark, sf):
    """F1, U4: inputs whose output is in neither of two folders, suffixes stripped."""
    path = lambda folder, suffix: F.concat(F.lit(folder), F.col("doc_id").cast("string"), F.lit(suffix)).alias("path")
    d = read(spark, sf, "documents")
    return L.not_yet_done(d.select(path("in/", ".txt")), [read(spark, sf, "reading_labels").select(path("out/", "_chunks.json")), d.where("doc_id % 5 = 0").select(path("md/", "_tree.md"))], "path", ("_chunks", "_tree"))


# text functions -------------------------------------------------------------------------


@query("SELECT doc_id, array_to_string(regexp_extract_all(replace(replace(replace(coalesce(text, ''), '/', '~'), '1', '/one.tnum'), ',', '/comma.pl.tnum'), '/one\\.tnum|/comma\\.pl\\.tnum')[1:30], ' ') AS found FROM documents")
def txt_corrections(spark, sf):
    """The first thirty corrections of each text."""
    t = F.expr("replace(replace(replace(coalesce(text, ''), '/', '~'), '1', '/one.tnum'), ',', '/comma.pl.tnum')")
    return read(spark, sf, "documents").select("doc_id", F.array_join(X.glyph_corrections(t), " ").alias("found"))


@query("SELECT doc_id, coalesce(source, '') || ';' || coalesce(title, '') AS kept FROM documents")
def txt_visible_metadata(spark, sf):
    """metadata without the keys hidden from the model."""
    e = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    m = F.create_map(F.lit("languages"), e("lang"), F.lit("source"), e("source"), F.lit("chunk_start"), e("doc_id"), F.lit("title"), e("title"), F.lit("matched_children"), F.lit("1"))
    return read(spark, sf, "documents").select("doc_id", F.array_join(F.transform(F.array_sort(F.map_entries(X.visible_metadata(m))), lambda x: x["value"]), ";").alias("kept"))


_C = "(SELECT *, list_filter(coalesce(path_titles, []), lambda t: t IS NOT NULL) AS ts, coalesce(content, '') AS c FROM text_chunk)"
_WHOLE = "CASE WHEN len(ts) > 0 THEN array_to_string(ts, ' > ') || chr(10) || chr(10) || c ELSE c END"


def _titled(spark, sf):
    t = F.filter(F.coalesce("path_titles", F.array().cast("array<string>")), lambda x: x.isNotNull())
    c = read(spark, sf, "text_chunk").select("chunk_id", t.alias("ts"), F.coalesce("content", F.lit("")).alias("c"))
    return c.withColumn("whole", X.with_titles(F.col("ts"), F.col("c")))


@query(f"SELECT chunk_id, CASE WHEN instr(w, chr(10) || chr(10)) > 0 THEN substring(w, instr(w, chr(10) || chr(10)) + 2) ELSE w END AS body FROM (SELECT chunk_id, {_WHOLE} AS w FROM {_C})")
def txt_body(spark, sf):
    """What follows the titles."""
    return _titled(spark, sf).select("chunk_id", X.body_text(F.col("whole")).alias("body"))


@query(
    f"""SELECT chunk_id, CASE WHEN len(ts) > 0 AND len(heads) > 0 THEN regexp_replace(substring(w, length(heads[1]) + 1), '^\\n{{1,2}}', '') ELSE w END AS body FROM (
 SELECT chunk_id, ts, w, list_filter(list_concat(list_transform(range(1, greatest(len(ts), 1) + 1), lambda k: array_to_string(ts[k:], ' > ')), ts), lambda t: t <> '' AND starts_with(w, t) AND length(w) - length(t) > 20) AS heads
 FROM (SELECT chunk_id, ts, {_WHOLE} AS w FROM {_C}))"""
)
def txt_without_titles(spark, sf):
    """X11: content without the titles it begins with."""
    return _titled(spark, sf).select("chunk_id", X.without_titles(F.col("whole"), F.col("ts")).alias("body"))


@query(
    f"""SELECT chunk_id, CASE WHEN len(ts) > 0 AND length(trim(o)) > 2 THEN o ELSE w END AS body FROM (SELECT *, regexp_replace(array_to_string(list_transform(list_filter(list_zip(ls, range(len(ls))), lambda z: z[2] = 0 OR trim(z[1]) = '' OR NOT (list_contains(ts, trim(z[1])) OR trim(z[1]) = p)), lambda z: z[1]), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g') AS o FROM (
 SELECT chunk_id, ts, p, w, string_split(w, chr(10)) AS ls FROM (SELECT chunk_id, ts, array_to_string(ts, ' > ') AS p, c || chr(10) || array_to_string(ts, ' > ') || chr(10) || coalesce(ts[1], '') || chr(10) || c AS w FROM {_C})))"""
)
def txt_repeated_titles(spark, sf):
    """X11: titles that a merge has left in mid text."""
    c = _titled(spark, sf).withColumn("w", F.concat_ws("\n", "c", F.array_join("ts", " > "), F.coalesce(F.get("ts", F.lit(0)), F.lit("")), "c"))
    return c.select("chunk_id", X.without_repeated_titles(F.col("w"), F.col("ts")).alias("body"))


_MARK = "[。！？\\n\\.!\\?;；:：，,]"
_T = "(SELECT doc_id, coalesce(text, '') AS t FROM documents)"


@query(
    f"""SELECT doc_id, md5(CASE WHEN length(t) <= 100 THEN t WHEN contains(tail, chr(10) || chr(10)) THEN list_last(string_split(tail, chr(10) || chr(10))) WHEN regexp_matches(tail, '(?s)^.*{_MARK}(.{{50,}})$') THEN regexp_extract(tail, '(?s)^.*{_MARK}(.{{50,}})$', 1) ELSE right(t, 100) END) AS last_,
 md5(CASE WHEN length(t) <= 100 THEN t WHEN regexp_matches(tail2, '{_MARK}') THEN regexp_extract(tail2, '(?s)^.*?{_MARK}(.*)$', 1) ELSE right(t, 100) END) AS first_
 FROM (SELECT *, right(t, 300) AS tail, right(t, 200) AS tail2 FROM {_T})"""
)
def txt_overlap_text(spark, sf):
    """What a following chunk repeats of each text."""
    d = read(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    return d.select("doc_id", F.md5(X.overlap_text(F.col("t"), 100).cast("binary")).alias("last_"), F.md5(X.overlap_text_first(F.col("t"), 100).cast("binary")).alias("first_"))


@query(
    """WITH c AS (SELECT file_id, chunk_id, coalesce(content, '') AS cur, lag(coalesce(content, '')) OVER (PARTITION BY file_id ORDER BY source_node_index, chunk_index) AS prev FROM text_chunk),
k AS (SELECT *, least(length(prev), length(cur), 200) AS k FROM c WHERE prev IS NOT NULL)
SELECT chunk_id, k >= 50 AND right(prev, k) = left(cur, k) AND regexp_matches(right(prev, k), '[。！？；.!?;]$') AS overlapping,
 length(cur) >= 50 AND contains(right(prev, 400), left(cur, 50)) AND coalesce((SELECT max(n) FROM range(1, 401) r(n) WHERE n <= length(prev) AND n <= length(cur) AND right(right(prev, 400), n) = left(cur, n)), 0) >= 50 AS included FROM k"""
)
def txt_overlaps(spark, sf):
    """Whether a chunk begins with the end of the one before it."""
    w = Window.partitionBy("file_id").orderBy("source_node_index", "chunk_index")
    c = F.coalesce("content", F.lit(""))
    d = read(spark, sf, "text_chunk").select("chunk_id", c.alias("cur"), F.lag(c).over(w).alias("prev")).where("prev is not null")
    return d.select("chunk_id", X.is_overlapping(F.col("prev"), F.col("cur")).alias("overlapping"), X.is_included(F.col("prev"), F.col("cur"), 200).alias("included"))


@query("SELECT doc_id, ends_with(rtrim(x), ':') AND k <> 'list_item' AS announces, '<Instruct>: find' || chr(10) || chr(10) || '<Query>: ' || t || chr(10) || chr(10) || '<Document>: ' || x AS prompt, CASE WHEN doc_id % 3 = 0 THEN t ELSE t || chr(10) || 'Description of the table entities:' || chr(10) || 'a' || chr(10) || k END AS described FROM (SELECT doc_id, coalesce(title, '') AS t, coalesce(title, '') || CASE WHEN doc_id % 2 = 0 THEN ': ' ELSE '' END AS x, CASE WHEN doc_id % 4 = 0 THEN 'list_item' ELSE 'text' END AS k FROM documents)")
def txt_blocks(spark, sf):
    """Announcing blocks, prompts of the reranker, described tables."""
    t = F.coalesce("title", F.lit(""))
    d = read(spark, sf, "documents").select("doc_id", t.alias("t"), F.concat(t, F.when(F.col("doc_id") % 2 == 0, ": ").otherwise("")).alias("x"), F.when(F.col("doc_id") % 4 == 0, "list_item").otherwise("text").alias("k"))
    blocks = F.when(F.col("doc_id") % 3 != 0, F.array(F.lit("a"), F.col("k")))
    return d.select("doc_id", X.ends_with_colon(F.col("x"), F.col("k")).alias("announces"), X.rerank_prompt(F.lit("find"), F.col("t"), F.col("x"), True).alias("prompt"), X.table_text(F.col("t"), blocks, False).alias("described"))


@query("SELECT o_orderkey, CAST(CAST(CASE WHEN o_orderkey % 2 = 0 THEN round(CAST(floor(o_totalprice) AS DECIMAL(18,0)) * 0.1202, 2) ELSE 0 END AS DECIMAL(20,2)) AS VARCHAR) AS usd FROM orders")
def tool_yuan(spark, sf):
    """Amounts in texts, converted."""
    text = F.concat(F.lit("总额 "), F.floor("o_totalprice").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, " 亿元人民币").otherwise(" 元"))
    return read(spark, sf, "orders").select("o_orderkey", Z.yuan_to_usd(text).alias("usd"))


@query(
    """WITH d AS (SELECT DISTINCT file_id, node_index, unnest(tables) AS tb FROM document_node), r AS (SELECT file_id, node_index, tb.rows AS rows, list_max(list_transform(tb.rows, lambda x: len(x))) AS w FROM d WHERE len(tb.rows) > 0),
c AS (SELECT *, list_transform(rows, lambda x: list_transform(range(1, w + 1), lambda k: trim(coalesce(x[k], '')))) AS g FROM r WHERE w > 0), z AS (SELECT *, list_transform(range(1, w + 1), lambda k: greatest(3, list_max(list_transform(g, lambda x: length(x[k]))))) AS n FROM c),
l AS (SELECT *, list_transform(g, lambda x: '| ' || array_to_string(list_transform(range(1, w + 1), lambda k: rpad(x[k], CAST(n[k] AS INT), ' ')), ' | ') || ' |') AS ls FROM z)
SELECT file_id, node_index, array_to_string(list_concat([ls[1], '|' || array_to_string(list_transform(n, lambda k: repeat('-', k + 2)), '|') || '|'], ls[2:]), chr(10)) AS md FROM l"""
)
def doc_padded_tables(spark, sf):
    """Aligned Markdown of every table."""
    t = read(spark, sf, "document_node").select("file_id", "node_index", "tables").distinct().select("file_id", "node_index", F.explode("tables").alias("tb")).where("size(tb.rows) > 0")
    return t.select("file_id", "node_index", X.padded_markdown(F.col("tb.rows")).alias("md")).where("md <> ''")


_LINES = "(SELECT doc_id, regexp_replace(l, '^[\\s　]+|[\\s　]+$', '', 'g') AS s FROM (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\\r?\\n')) AS l FROM documents))"


@query(f"SELECT doc_id, count(*) AS n, sum(length(c)) AS n_chars FROM (SELECT doc_id, CASE WHEN starts_with(s, 'Paragraph:') THEN trim(substring(s, 11)) ELSE s END AS c FROM {_LINES} WHERE s <> '') WHERE c <> '' AND NOT starts_with(c, 'Outline') GROUP BY 1")
def doc_content_lines(spark, sf):
    """lines with content."""
    return O.content_lines(O.outline_lines(read(spark, sf, "documents"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("n_chars"))


# answers --------------------------------------------------------------------------------

_ROUTE = "CASE " + " ".join(f"WHEN regexp_matches(q, '{p}') AND ({'true' if name == 'calculator_tool' else 'open'}) THEN '{name}'" for name, p in Q.ROUTES) + f" ELSE '{Q.RETRIEVAL}' END"
_ASKED = """(SELECT doc_id, title, lower(q0) AS q, q0, category, CASE WHEN category = '选择题' THEN c0 END AS content, coalesce(trim(CASE WHEN category = '选择题' THEN c0 END), '') = '' AS open FROM (SELECT doc_id, title, CASE WHEN doc_id % 9 = 0 THEN '计算 3*(4+5)' WHEN doc_id % 9 = 1 THEN '今天星期几' ELSE coalesce(title, '') END AS q0, CASE WHEN doc_id % 4 = 0 THEN '选择题' ELSE '问答题' END AS category, CASE WHEN doc_id % 8 = 0 THEN 'A. x' END AS c0 FROM documents))"""


def _asked(spark, sf):
    k = F.col("doc_id") % 9
    return read(spark, sf, "documents").select(F.lit("s").alias("segments"), F.lit("p").alias("paper"), F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 4 == 0, "选择题").otherwise("问答题").alias("category"), F.when(k == 0, "计算 3*(4+5)").when(k == 1, "今天星期几").otherwise(F.coalesce("title", F.lit(""))).alias("question"), F.when(F.col("doc_id") % 8 == 0, "A. x").alias("content"))


@query(f"SELECT doc_id AS id, tool, CASE tool WHEN 'calculator_tool' THEN '27' WHEN 'rag' THEN left(q0, 5) ELSE '' END AS answer FROM (SELECT *, {_ROUTE} AS tool FROM {_ASKED})")
def router_answers(spark, sf):
    """Every question routed by rules, answered as a set by its tool, tools without an answer giving none."""
    calc = lambda d: d.select("id", Z.calculate_column(F.regexp_extract("question", "计算\\s*(.*)$", 1))["result"].alias("answer"))
    out = Q.answer_batch(_asked(spark, sf), {"calculator_tool": calc, "rag": lambda d: d.select("id", F.left("question", F.lit(5)).alias("answer"))})
    return out.select("id", "tool", "answer")


_STATED = {"Average amount of success transactions": "SELECT CAST(CAST(round(AVG(CAST(transaction_amount AS DOUBLE)), 6) AS DECIMAL(19,6)) AS VARCHAR) FROM transaction_flow WHERE status = 'SUCCESS'", "2023年5月退款有多少笔": "SELECT CAST(COUNT(*) AS VARCHAR) FROM transaction_flow WHERE transaction_type = 'REFUND' AND year(transaction_time) = 2023 AND month(transaction_time) = 5", "latest 2 refund": "SELECT '[' || string_agg('[''' || transaction_id || ''', ''' || coalesce(CAST(transaction_amount AS VARCHAR), '') || ''']', ', ' ORDER BY transaction_time DESC, transaction_id) || ']' FROM (SELECT DISTINCT transaction_id, transaction_amount, transaction_time FROM transaction_flow WHERE transaction_type = 'REFUND' ORDER BY transaction_time DESC, transaction_id LIMIT 2)"}


@query(" UNION ALL ".join(f"SELECT '{q}' AS question, ({s}) AS answer" for q, s in list(_STATED.items())[:2]))
def nl_answers(spark, sf):
    """Questions to shaped answers."""
    s = reading_session(spark)
    t = {"transaction_flow": s.read.parquet(f"{sf}/transaction_flow.parquet")}
    return spark.createDataFrame([(q, ask(s, q, t).answer) for q in list(_STATED)[:2]], "question string, answer string")


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events")
def tool_nan(spark, sf):
    """NaN as null."""
    e = read(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, float("nan")).otherwise(F.col("value")).alias("v"))
    return L.nan_to_null(e)


# retrieval ------------------------------------------------------------------------------


@query(
    """WITH c AS (SELECT vec_id AS cid, embedding AS c, row_number() OVER (ORDER BY vec_id) - 1 AS j FROM embeddings WHERE vec_id < 8),
s AS (SELECT e.vec_id, c.j, list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(c.c AS DOUBLE[])) - 0.5 * list_dot_product(CAST(c.c AS DOUBLE[]), CAST(c.c AS DOUBLE[])) AS s FROM embeddings e, c)
SELECT vec_id AS node_id, CAST(arg_max(j, s) AS INT) AS centroid_id FROM s GROUP BY 1"""
)
def rag_assigned_lists(spark, sf):
    """R2: every vector in the list of its nearest centroid, for eight stated centroids."""
    import numpy as np

    v = read(spark, sf, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding")
    c = np.array([r["embedding"] for r in v.where("node_id < 8").orderBy("node_id").collect()], dtype=float)
    return V.assign_lists(v, c).select("node_id", "centroid_id")


@query(
    _KIDS
    + """, t AS (SELECT query_id, node_id, chunk_index, row_number() OVER (PARTITION BY query_id ORDER BY score, node_id DESC, chunk_index DESC) - 1 AS i, count(*) OVER (PARTITION BY query_id) AS n, score FROM rr)
SELECT query_id, count(*) AS n, round(sum(score), 6) AS s, max(CASE WHEN i % 2 = 0 THEN (n - 1) // 2 - i // 2 ELSE (n + 1) // 2 + (i - 1) // 2 END) AS last_position FROM t GROUP BY 1"""
)
def rag_served(spark, sf):
    """The serving pipeline, its retrievers given: the vectors of the table for one, BM25 for the other."""
    d = read(spark, sf, "documents")
    vectors = read(spark, sf, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding")
    asked = d.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("title").alias("text"))
    vq = read(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    hits = V.retrieve(d.select(F.col("doc_id").alias("node_id"), "text"), asked, retrievers=[lambda c, q, k: V.dense_top_k(vectors, vq, k), V.bm25_retriever], steps=[V.at_least(0.0)])
    return hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 6).alias("s"), F.max("position").cast("long").alias("last_position"))


@query("SELECT chunk_id, rank, score FROM (SELECT chunk_id, row_number() OVER (PARTITION BY file_id ORDER BY length(content) % 97 DESC, source_node_index, chunk_index, chunk_id) - 1 AS rank, CAST(length(content) % 97 AS DOUBLE) AS score FROM (SELECT chunk_id, file_id, source_node_index, chunk_index, coalesce(content, '') AS content FROM text_chunk)) WHERE rank < 3")
def rag_rerank_batched(spark, sf):
    """A scorer in batches, the best three of each group, the retrieval score kept."""
    w = Window.partitionBy("file_id").orderBy("source_node_index", "chunk_index", "chunk_id")
    pairs = read(spark, sf, "text_chunk").select(F.col("file_id").alias("query_id"), F.col("chunk_id").alias("node_id"), F.lit("q").alias("query"), F.coalesce("content", F.lit("")).alias("child_text"), F.lit(1.5).alias("score"), (F.row_number().over(w) - 1).alias("rank"))
    out = V.rerank_batched(pairs, lambda qs, ts: [float(len(t) % 97) for t in ts], 3, 8, True)
    return out.where("retrieval_score = 1.5").select(F.col("node_id").alias("chunk_id"), F.col("rank").cast("long").alias("rank"), "score")


@query("SELECT file_id AS query_id, CAST(sum(length(c)) AS BIGINT) AS n_chars, count(*) AS n_texts, true AS within FROM (SELECT file_id, left(coalesce(content, ''), 900) AS c FROM text_chunk) GROUP BY 1")
def rag_context_blocks(spark, sf):
    """All texts of a context in blocks within the budget, none lost."""
    w = Window.partitionBy("file_id").orderBy("source_node_index", "chunk_index")
    hits = read(spark, sf, "text_chunk").select(F.col("file_id").alias("query_id"), (F.row_number().over(w) - 1).alias("position"), F.left(F.coalesce("content", F.lit("")), F.lit(900)).alias("text"))
    n = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_texts"))
    blocks = V.context_blocks(hits, 4096).groupBy("query_id").agg(F.sum(F.length("context")).alias("all"), F.count(F.lit(1)).alias("blocks"), (F.max(F.length("context")) <= 4096).alias("within"))
    return blocks.join(n, "query_id").select("query_id", (F.col("all") - 2 * (F.col("n_texts") - F.col("blocks"))).alias("n_chars"), "n_texts", "within")




# chunk folds -----------------------------------------------------------------------------

_BODIES = "(SELECT file_id, coalesce(content, '') AS x, row_number() OVER (PARTITION BY file_id ORDER BY source_node_index, chunk_index, chunk_id) AS pos FROM text_chunk)"


def _folded(spark, sf, f):
    """The bodies of each file's chunks through a fold."""
    rows = F.array_sort(F.collect_list(F.struct("source_node_index", "chunk_index", "chunk_id", F.coalesce("content", F.lit("")).alias("x"))))
    b = read(spark, sf, "text_chunk").groupBy("file_id").agg(rows.alias("r")).select("file_id", F.transform("r", lambda x: x["x"]).alias("b"))
    return b.select("file_id", F.posexplode(f(F.col("b"))).alias("k", "body")).select("file_id", F.col("k").cast("long").alias("k"), F.md5(F.col("body").cast("binary")).alias("hash"), F.length("body").cast("long").alias("n"))


_OUT = "SELECT file_id, k - 1 AS k, md5(b[k]) AS hash, length(b[k]) AS n FROM (SELECT file_id, b, unnest(range(1, len(b) + 1)) AS k FROM {})"


@query(
    f"""WITH g AS (SELECT *, sum(CASE WHEN length(x) >= 300 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY pos) AS g FROM {_BODIES}),
a AS (SELECT file_id, g, max(CASE WHEN length(x) >= 300 THEN x END) AS l, string_agg(x, chr(10) ORDER BY pos) FILTER (WHERE length(x) < 300) AS s, sum(length(x)) FILTER (WHERE length(x) < 300) AS n FROM g GROUP BY 1, 2),
o AS (SELECT file_id, flatten(list(CASE WHEN s IS NULL THEN [l] WHEN g = 0 THEN [s] WHEN n < 300 THEN [l || chr(10) || s] ELSE [l, s] END ORDER BY g)) AS b FROM a GROUP BY 1)
{_OUT.format("o")}"""
)
def doc_short_runs(spark, sf):
    """Runs of short bodies joined."""
    return _folded(spark, sf, lambda b: C.merge_short_runs(b, 300))


@query(
    f"""WITH RECURSIVE b AS (SELECT * FROM {_BODIES}), f AS (SELECT file_id, CAST(0 AS BIGINT) AS pos, CAST([] AS VARCHAR[]) AS o, CAST(NULL AS VARCHAR) AS run FROM b GROUP BY 1 UNION ALL
 SELECT file_id, pos, CASE WHEN length(j) >= 400 THEN list_append(o, j) ELSE o END, CASE WHEN length(j) >= 400 THEN NULL ELSE j END FROM (SELECT f.file_id, b.pos, f.o, CASE WHEN f.run IS NULL THEN b.x ELSE f.run || chr(10) || chr(10) || b.x END AS j FROM f JOIN b ON b.file_id = f.file_id AND b.pos = f.pos + 1)),
o AS (SELECT file_id, CASE WHEN run IS NULL THEN o WHEN len(o) > 0 THEN list_append(o[1:len(o) - 1], o[len(o)] || chr(10) || chr(10) || run) ELSE [run] END AS b FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY pos DESC) AS z FROM f) WHERE z = 1)
{_OUT.format("o")}"""
)
def doc_least_bodies(spark, sf):
    """Short bodies take in those that follow."""
    return _folded(spark, sf, lambda b: C.least_body(b, 400))


_RUN_END = "right(run, least(length(run), length(x), 200))"


@query(
    f"""WITH RECURSIVE b AS (SELECT * FROM {_BODIES}), f AS (SELECT file_id, CAST(0 AS BIGINT) AS pos, CAST([] AS VARCHAR[]) AS o, CAST('' AS VARCHAR) AS run FROM b GROUP BY 1 UNION ALL
 SELECT file_id, pos, CASE WHEN length(run) + length(y) > 2000 AND run <> '' THEN list_append(o, run) ELSE o END, CASE WHEN length(run) + length(y) > 2000 OR run = '' THEN y ELSE run || chr(10) || chr(10) || y END
 FROM (SELECT *, CASE WHEN run <> '' AND least(length(run), length(x), 200) >= 50 AND {_RUN_END} = left(x, least(length(run), length(x), 200)) AND regexp_matches({_RUN_END}, '[。！？；.!?;]$')
  THEN substring(x, coalesce(list_max(list_filter(range(1, 201), lambda k: k <= length(run) AND k <= length(x) AND right(run, k) = left(x, k))), 0) + 1) ELSE x END AS y
  FROM (SELECT f.file_id, b.pos, f.o, f.run, b.x FROM f JOIN b ON b.file_id = f.file_id AND b.pos = f.pos + 1))),
o AS (SELECT file_id, CASE WHEN run <> '' THEN list_append(o, run) ELSE o END AS b FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY pos DESC) AS z FROM f) WHERE z = 1)
{_OUT.format("o")}"""
)
def doc_packed_bodies(spark, sf):
    """Bodies packed up to a length."""
    return _folded(spark, sf, lambda b: C.pack_bodies(b, 2000))


_TAIL = "right(prev, least(length(prev), 300))"
_END = f"CASE WHEN contains({_TAIL}, chr(10) || chr(10)) THEN list_last(string_split({_TAIL}, chr(10) || chr(10))) WHEN regexp_matches({_TAIL}, '(?s)^.*{_MARK}(.{{50,}})$') THEN regexp_extract({_TAIL}, '(?s)^.*{_MARK}(.{{50,}})$', 1) ELSE right(prev, 100) END"


@query(
    f"""WITH p AS (SELECT *, lag(x) OVER (PARTITION BY file_id ORDER BY pos) AS prev FROM {_BODIES}), e AS (SELECT *, {_END} AS e FROM p),
w AS (SELECT *, coalesce(length(x) >= 128 AND length(prev) > 100 AND length(e) > 50 AND NOT starts_with(x, e) AND NOT (contains(right(prev, 200), left(x, 50)) AND coalesce(list_max(list_filter(range(1, 201), lambda k: k <= length(right(prev, 200)) AND k <= length(x) AND right(prev, k) = left(x, k))), 0) >= 50), false) AS wanted FROM e)
SELECT file_id, pos - 1 AS k, md5(r) AS hash, length(r) AS n FROM (SELECT *, CASE WHEN wanted THEN e || chr(10) || chr(10) || x ELSE x END AS r FROM w)"""
)
def doc_overlaps_added(spark, sf):
    """Bodies led by the end of the one before."""
    return _folded(spark, sf, lambda b: C.add_overlap(b, 100))


@query("SELECT doc_id, md5(coalesce(text, '')) AS hash, true AS within FROM documents WHERE coalesce(text, '') <> ''")
def doc_sentence_cover(spark, sf):
    """Chunks of whole sentences are the text again; tokens counted by a callback."""
    c = C.sentence_chunks(read(spark, sf, "documents"), size=400, overlap=0, count=len)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk"))), lambda r: r["chunk"])
    # more than the limit only where one sentence is
    return c.groupBy("doc_id").agg(F.md5(F.array_join(rows, "").cast("binary")).alias("hash"), F.max((F.length("chunk") <= 400) | (F.regexp_count(F.rtrim("chunk"), F.lit("[。！？!?\\n]+.")) <= F.length("chunk"))).alias("within"))


@query(
    """WITH d AS (SELECT DISTINCT file_id AS doc_id, node_index, node_type, trim(regexp_replace(coalesce(text, ''), '[\\s　]+', ' ', 'g')) AS t FROM document_node WHERE node_type <> 'root'),
k AS (SELECT *, length(t) - length(replace(t, '|', '')) >= 2 AND node_type <> 'heading' AS tab, max(CASE WHEN node_type = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS headed FROM d)
SELECT doc_id, count(*) AS total_nodes, count(*) FILTER (WHERE node_type = 'heading') AS heading_nodes FROM k WHERE headed = 1 AND NOT tab GROUP BY 1"""
)
def io_pipeline(spark, sf):
    """The document pipeline with its sinks; its statistics read back."""
    from tessel.plans.documents import Options, process_documents

    at = fresh_path(spark, "pipeline")
    process_documents(_outlines(spark, sf), at, Options(full_text=False, tree=False, chunk_files=False, merge_paths=True))
    return spark.read.json(f"{at}/statistics").select("doc_id", "total_nodes", "heading_nodes")


# trees and chunks ------------------------------------------------------------------------

_LEAF = (
    _TREE
    + """, up AS (WITH RECURSIVE u AS (SELECT doc_id, idx, CASE WHEN node_type = 'heading' THEN [t] ELSE CAST([] AS VARCHAR[]) END AS path, parent FROM p UNION ALL SELECT u.doc_id, u.idx, list_prepend(q.t, u.path), q.parent FROM u JOIN p q ON q.doc_id = u.doc_id AND q.idx = u.parent) SELECT doc_id, idx, path FROM u WHERE parent = 0),
leaf AS (SELECT p.doc_id, p.idx, p.t, array_to_string(up.path, ' > ') AS path FROM p JOIN up ON up.doc_id = p.doc_id AND up.idx = p.idx ANTI JOIN p c ON c.doc_id = p.doc_id AND c.parent = p.idx WHERE trim(p.t) <> ''),
"""
)


@query(_LEAF + "z AS (SELECT 1) SELECT doc_id, CAST(idx AS INT) AS node_idx, length(t) AS n, md5(path) AS path, true AS covered FROM leaf")
def doc_leaf_cover(spark, sf):
    """The chunks of every leaf, in order, under its titles, hold all of its text."""
    c = C.leaf_chunks(O.leaf_texts(O.outline_nodes(_outlines(spark, sf), paths=True)))
    path = F.array_join("path_titles", " > ")
    per = c.groupBy("doc_id", "node_idx").agg(F.first("original_text_length").cast("long").alias("n"), F.first(path).alias("path"), F.sum("chunk_text_length").alias("all"), F.count_distinct("chunk_index").alias("k"), F.max("chunk_index").alias("last"), F.min(F.startswith(F.col("content"), path).cast("int")).alias("titled"), F.max("chunk_text_length").alias("longest"))
    return per.select("doc_id", "node_idx", "n", F.md5(F.col("path").cast("binary")).alias("path"), ((F.col("all") >= F.col("n")) & (F.col("k") == F.col("last") + 1) & (F.col("titled") == 1) & (F.col("longest") <= 4096 + 602)).alias("covered"))


@query(_LEAF + "m AS (SELECT doc_id, path, min(idx) AS a, max(idx) AS b FROM leaf GROUP BY 1, 2) SELECT doc_id, md5(path) AS path, CAST(a AS INT) AS first_node, CAST(b AS INT) AS last_node, 'path_merged_' || a || '_to_' || b AS chunk_id FROM m")
def doc_merged_paths(spark, sf):
    """One group a path, with its first and last node."""
    m = C.merge_by_path(C.leaf_chunks(O.leaf_texts(O.outline_nodes(_outlines(spark, sf), paths=True))))
    return m.select("doc_id", F.md5(F.array_join("path_titles", " > ").cast("binary")).alias("path"), "first_node", "last_node", "chunk_id").distinct()


@query(_TREE + "SELECT doc_id, CAST(idx AS INT) AS node_idx, length(t) AS n FROM p WHERE trim(t) <> ''")
def doc_content_nodes(spark, sf):
    """nodes with text, a root only where it is all there is."""
    nodes = O.outline_nodes(_outlines(spark, sf))
    return O.content_nodes(nodes).where("node_type <> 'root'").select("doc_id", "node_idx", F.length("text").cast("long").alias("n"))


@query("SELECT n_nationkey AS id, md5('| k | ' || n_nationkey || ' |' || chr(10) || '| name | ' || n_name || ' |') AS hash, 'after' AS position FROM nation")
def doc_node_tables(spark, sf):
    """Runs of piped lines as tables of the node before them."""
    k, n = F.col("n_nationkey").cast("string"), F.col("n_name")
    text = F.concat(F.lit("Heading 1: "), n, F.lit("\nParagraph: before\n| k | "), k, F.lit(" |\n| name | "), n, F.lit(" |\nParagraph: after"))
    nodes = O.outline_nodes(read(spark, sf, "nation").select(F.col("n_nationkey").alias("doc_id"), text.alias("text")))
    t = nodes.select("doc_id", F.explode("tables").alias("t"))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    return t.select(F.col("doc_id").alias("id"), F.md5(F.array_join(F.transform("t.rows", line), "\n").cast("binary")).alias("hash"), "t.position")


@query("SELECT 'tables of ' || n_name AS question, n_name AS tables FROM nation")
def catalog_selected(spark, sf):
    """The tables of a catalog that a question names."""
    n = read(spark, sf, "nation").select(F.col("n_name").alias("Table"), F.lit("").alias("Description"), F.lit(None).cast("string").alias("Fields"))
    asked = [r["Table"] for r in n.collect()]  # 25 rows
    return spark.createDataFrame([(f"tables of {t}", K.select_tables(n, f"tables of {t}")[0]) for t in asked], "question string, tables string")


@query("SELECT 'tool_' || n_nationkey AS name, CASE WHEN n_regionkey < 3 THEN 'http' ELSE 'local' END AS type, false AS has_http, 503 AS status FROM nation WHERE n_regionkey < 3 UNION ALL SELECT 'tool_' || n_nationkey, 'local', false, 200 FROM nation WHERE n_regionkey >= 3")
def tool_catalog(spark, sf):
    """Tools for a prompt without their HTTP settings, and the status of a call of each."""
    r = Q.Registry()
    for x in read(spark, sf, "nation").collect():  # 25 rows
        name = f"tool_{x['n_nationkey']}"
        if x["n_regionkey"] < 3:
            r.register_http({"name": name, "description": x["n_name"], "http_config": {"url": "http://host"}})
        else:
            r.register(name, lambda: 1)
    return spark.createDataFrame([(t["name"], t["type"], "http_config" in t, r.call(t["name"], {})["status_code"]) for t in r.catalog()], "name string, type string, has_http boolean, status int")
