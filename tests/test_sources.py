import json
import zipfile

from pyspark.sql import functions as F

from tessel.operators.chunks import add_overlap, least_body, merge_short_runs, pack_bodies, recursive_split
from tessel.operators.report import filter_blocks, page_markdown, read_reports, tables_of, with_tables, blocks_of
from tessel.sources.files import list_files, read_outlines
from tessel.sources.sinks import load_index, write_index
from tessel.sources.tool_specs import parse_spec, read_specs
from tessel.streaming.ingest import stream_outlines

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def folder(tmp):
    (tmp / "sub").mkdir()
    (tmp / "a.MD").write_text("# T\n\ntext one\ntext two\n\n| h | i |\n|---|---|\n| 1 | 2 |\n")
    (tmp / "sub/b.txt").write_text("plain")
    (tmp / "bad.docx").write_text("no zip")
    (tmp / "skip.exe").write_text("x")
    with zipfile.ZipFile(tmp / "c.docx", "w") as z:
        z.writestr("word/styles.xml", f'<w:styles {W}><w:style w:styleId="H"><w:name w:val="heading 2"/></w:style></w:styles>')
        z.writestr("word/document.xml", f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="H"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    with zipfile.ZipFile(tmp / "d.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {S}><sheets><sheet name="S1"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {S}><si><t>id</t></si><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2"><v>7</v></c></row></sheetData></worksheet>')
    return tmp


def test_files_to_outlines(spark, tmp_path):
    files = list_files(spark, str(folder(tmp_path)))
    got = {r.name: r for r in read_outlines(files).collect()}
    assert set(got) == {"a.MD", "b.txt", "bad.docx", "c.docx", "d.xlsx"}
    assert got["a.MD"].outline == "Heading 1: T\nParagraph: text one text two\nParagraph: | h | i |\nParagraph: | 1 | 2 |"
    assert got["b.txt"].outline == "Heading 1: b\nParagraph: plain"
    assert got["c.docx"].outline == "Heading 2: Head\nParagraph: Body\nParagraph: | x | y |"
    assert got["d.xlsx"].outline == "Heading 1: S1\nHeading 2: | id | name |\nParagraph: | 7 |"
    assert got["bad.docx"].outline is None and "BadZipFile" in got["bad.docx"].error
    assert list_files(spark, str(tmp_path / "nowhere")).count() == 0


def test_stream_reads_each_file_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "one.txt").write_text("1")
    args = (spark, str(src), str(tmp_path / "out"), str(tmp_path / "ck"))
    stream_outlines(*args).awaitTermination()
    (src / "two.txt").write_text("2")
    stream_outlines(*args).awaitTermination()
    assert sorted(r.name for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["one.txt", "two.txt"]


def test_tool_specs(spark, tmp_path):
    text = "name: fx\ndescription: rates: live\nhttp_url: http://x/y\nhttp_method: get\nparameters:\nfrom: code\namount: a number\nrequired: from, "
    s = parse_spec(text, "stem")
    assert s["http_config"] == {"url": "http://x/y", "method": "GET"} and s["parameters"]["required"] == ["from"] and s["parameters"]["properties"]["amount"]["type"] == "number"
    assert parse_spec("description: d\nparameters:\n  required: []", "stem")["parameters"]["required"] == []
    (tmp_path / "a.txt").write_text(text)
    (tmp_path / "b.json").write_text(json.dumps({"name": "j", "description": "d"}))
    assert {r.name: r.kind for r in read_specs(spark, str(tmp_path)).collect()} == {"fx": "http", "j": "local"}


def test_report_pages(spark, tmp_path):
    blocks = [("page_header", "H"), ("section_header", "S"), ("paragraph", "List:"), ("list_item", "a"), ("list_item", "b"), ("paragraph", "P"), ("page_footer", "F"), ("text", "Table:"), ("table", None), ("footnote", "n")]
    report = {"metainfo": {"sha1_name": "r"}, "content": [{"page": 1, "content": [{"type": t, "text": x, "table_id": 0 if t == "table" else None} for t, x in blocks]}], "tables": [{"table_id": 0, "markdown": "| x |"}], "pictures": []}
    (tmp_path / "r.json").write_text(json.dumps(report))
    r = read_reports(spark, str(tmp_path / "r.json"))
    b = with_tables(filter_blocks(blocks_of(r)), tables_of(r))
    assert page_markdown(b).first().text == "\n# H\n\n\n## S\n\n\nList:\n- a\n- b\n\n\n\n### P\n\n\nTable:\n| x |\nn\n\n"


def test_groups_of_a_page(spark):
    def page(*blocks):
        rows = [("d", 1, i, t, x, "| m |" if t == "table" else None) for i, (t, x) in enumerate(blocks)]
        return page_markdown(spark.createDataFrame(rows, "doc_id string, page int, pos int, type string, text string, rendered string")).first().text

    # text behind a table belongs to it only where a footnote follows, and all footnotes do
    assert page(("table", None), ("text", "t"), ("footnote", "f"), ("footnote", "g"), ("text", "u")) == "\n| m |\nt\nf\ng\n\n\nu\n"
    assert page(("table", None), ("text", "t"), ("text", "u"), ("footnote", "f")) == "\n| m |\n\n\nt\n\nu\n\nf\n"
    assert page(("list_item", "a"), ("list_item", "b"), ("footnote", "f"), ("list_item", "c")) == "\n- a\n- b\nf\n\n\n\n- c\n\n"
    # two tables are two groups; a header with a colon heads none; blank text goes, code is fenced
    assert page(("table", None), ("table", None)) == "\n| m |\n\n\n\n| m |\n\n"
    assert page(("section_header", "S:"), ("list_item", "a"), ("text", " "), ("code", "x = 1")) == "\n# S:\n\n\n- a\n\n\n```\nx = 1\n```\n"
    assert page(("text", "")) == "" and page((None, "odd")) == "odd\n"


def test_chunk_folds(spark):
    one = lambda c, rows: spark.createDataFrame([(rows,)], "b array<string>").select(c(F.col("b")).alias("r")).first().r
    long, s = "x" * 300, "y" * 40
    assert one(lambda b: merge_short_runs(b, 100), [s, s, long, s, long, s]) == [s + "\n" + s, long + "\n" + s, long + "\n" + s]
    assert one(lambda b: merge_short_runs(b, 100), []) == []
    assert one(lambda b: pack_bodies(b, 650), [long, long, long]) == [long + "\n\n" + long, long]
    assert one(lambda b: least_body(b, 200), [s, long, s]) == [s + "\n\n" + long + "\n\n" + s]
    prev, cur = "First. " + "z" * 500 + "。 " + "t" * 80, "u" * 200
    assert one(lambda b: add_overlap(b, 100), [prev, cur]) == [prev, " " + "t" * 80 + "\n\n" + cur]
    text = "para one.\n\n" + "word " * 60 + "。end"
    parts = recursive_split(text, 50)
    assert "".join(parts) == text and max(map(len, parts)) <= 50


def test_index_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 1)], "node_id long, vector array<double>, centroid_id int")
    write_index(d, str(tmp_path / "ix"), {"nlist": 2, "nprobe": 10})
    back, info = load_index(spark, str(tmp_path / "ix"))
    assert back.count() == 2 and info["nprobe"] == "10"


def test_document_pipeline(spark, tmp_path):
    from tessel.plans.documents import Options, process_files

    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    got = process_files(spark, str(folder(src)), out, Options(merge_paths=True))
    assert {r.error[:10] for r in got["failed"].collect()} == {"BadZipFile"} and got["statistics"].count() == 4
    assert spark.read.json(f"{out}/chunks_json").select("doc_id").distinct().count() == got["chunks"].select("doc_id").distinct().count() == 4
    assert process_files(spark, str(src), str(tmp_path / "out2"), Options(chunking=False))["nodes"].count() == got["nodes"].count()
    assert process_files(spark, str(src), out, Options(incremental=True, statistics=False, chunk_files=False, json=False, index=False))["nodes"].count() == 0
