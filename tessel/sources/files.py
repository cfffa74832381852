"""Documents from files: listing, reading, outlines of Markdown, Word, Excel, text and PDF.

Files are read by Spark's binaryFile source, so listing and reading are
distributed; each file's own parsing is Python over Arrow batches. A file that
can't be read gives its error instead of text.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.sources.sinks import NO_DOC

EXTENSIONS = ("docx", "pdf", "md", "xlsx", "xls", "txt")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def list_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS, ordered: bool = False) -> DataFrame:
    """(path, name, extension, length, modificationTime, content) of a folder and those below, by path if ``ordered`` (S7); a missing folder has no files (S6, S21). Extensions compare without case (Q36)."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    try:
        df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    except Exception:  # noqa: BLE001
        df = spark.createDataFrame([], schema)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, "\\.([^.]+)$", 1))
    files = df.select("path", name.alias("name"), ext.alias("extension"), "length", "modificationTime", "content").where(F.col("extension").isin(*extensions))
    return files.orderBy("path") if ordered else files


# one file each ---------------------------------------------------------------------


def decode(raw: bytes) -> str:
    for code in ("utf-8-sig", "gb18030"):
        try:
            return raw.decode(code)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


def text_outline(raw: bytes, name: str) -> str:
    """A text file under its name as heading."""
    return f"Heading 1: {name.rsplit('.', 1)[0]}\nParagraph: {decode(raw)}"


def markdown_outline(raw: bytes, name: str) -> str:
    """Headings, paragraphs, lists, quotes, code and tables of a Markdown file, each element once."""
    out: list[str] = []
    run: list[str] = []
    fence = False

    def flush() -> None:
        if run:
            out.append("Paragraph: " + " ".join(run))
            run.clear()

    for line in decode(raw).splitlines():
        s = line.strip()
        if s.startswith("```"):
            flush()
            fence = not fence
        elif fence:
            out.append("Paragraph: " + line)
        elif m := re.match(r"(#{1,6})\s+(.*?)\s*#*$", s):
            flush()
            out.append(f"Heading {len(m[1])}: {m[2]}")
        elif s.startswith("|"):
            flush()
            if not re.fullmatch(r"[|\s:-]+", s):
                out.append("Paragraph: " + s)
        elif m := re.match(r"(?:[-*+]|\d+[.)])\s+(.*)", s):
            flush()
            out.append("Paragraph: - " + m[1])
        elif not s:
            flush()
        else:
            run.append(s.removeprefix(">").strip())
    flush()
    return "\n".join(out)


def docx_styles(z: zipfile.ZipFile) -> dict[str, int]:
    """Style id to outline level."""
    if "word/styles.xml" not in z.namelist():
        return {}
    out = {}
    for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(_W + "style"):
        level, name = s.find(f".//{_W}outlineLvl"), s.find(_W + "name")
        if level is not None:
            out[s.get(_W + "styleId")] = int(level.get(_W + "val")) + 1
        elif name is not None and (m := re.match(r"heading (\d)", name.get(_W + "val", ""), re.I)):
            out[s.get(_W + "styleId")] = int(m[1])
    return out


def docx_outline(raw: bytes, name: str) -> str:
    """Headings by style, outline level or numbering, lists by level, tables row by row."""
    out: list[str] = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        styles = docx_styles(z)
        body = ElementTree.fromstring(z.read("word/document.xml")).find(_W + "body")

    def text(p) -> str:
        return "".join(t.text or "" for t in p.iter(_W + "t")).strip()

    for e in body if body is not None else ():
        if e.tag == _W + "tbl":
            for row in e.iter(_W + "tr"):
                cells = [" ".join(filter(None, (text(p) for p in c.iter(_W + "p")))) for c in row.iter(_W + "tc")]
                if any(cells):
                    out.append("Paragraph: | " + " | ".join(cells) + " |")
        elif e.tag == _W + "p" and (t := text(e)):
            style, level = e.find(f".//{_W}pStyle"), e.find(f".//{_W}outlineLvl")
            depth = styles.get(style.get(_W + "val")) if style is not None else None
            if depth is None and level is not None:
                depth = int(level.get(_W + "val")) + 1
            if depth is None and (m := re.match(r"\s*(\d+(?:\.\d+){0,10})[.\s]+", t)) and len(t) <= 100:
                depth = min(6, m[1].count(".") + 1)
            item = e.find(f".//{_W}ilvl")
            out.append(f"Heading {depth}: {t}" if depth else "Paragraph: " + ("  " * int(item.get(_W + "val")) + "- " if item is not None else "") + t)
    return "\n".join(out)


def docx_plain(raw: bytes, name: str) -> str:
    """All text of a Word file, paragraph by paragraph, whatever its structure: the reader of last resort."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        xml = z.read("word/document.xml").decode("utf-8", "replace")
    lines = ["".join(re.findall(r"<w:t[^>]*>([^<]*)</w:t>", p)).strip() for p in xml.split("</w:p>")]
    return "\n".join("Paragraph: " + x for x in lines if x)


def xlsx_rows(raw: bytes) -> list[tuple[str, list[list[str]]]]:
    """(sheet, rows of cell texts) of an Excel workbook."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        shared = ["".join(t.text or "" for t in si.iter(_S + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(_S + "si")] if "xl/sharedStrings.xml" in names else []
        sheets = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(_S + "sheet")]
        out = []
        for k, sheet in enumerate(sheets, 1):
            rows = []
            for r in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{k}.xml")).iter(_S + "row"):
                cells: list[str] = []
                for c in r.iter(_S + "c"):
                    at = 0
                    for ch in re.match(r"[A-Z]*", c.get("r", ""))[0]:
                        at = at * 26 + ord(ch) - 64
                    cells += [""] * (at - 1 - len(cells))
                    v, kind = c.find(_S + "v"), c.get("t")
                    cells.append(shared[int(v.text)] if kind == "s" and v is not None else "".join(t.text or "" for t in c.iter(_S + "t")) if kind == "inlineStr" else (v.text or "") if v is not None else "")
                rows.append(cells)
            out.append((sheet, rows))
    return out


def excel_outline(raw: bytes, name: str) -> str:
    """Sheets as headings, rows as piped paragraphs, the header row as a heading of its own."""
    out = []
    for sheet, rows in xlsx_rows(raw):
        out.append(f"Heading 1: {sheet}")
        for k, r in enumerate(r for r in rows if any(x.strip() for x in r)):
            line = "| " + " | ".join(r) + " |"
            out.append(("Heading 2: " if k == 0 else "Paragraph: ") + line)
    return "\n".join(out)


def pdf_outline(raw: bytes, name: str) -> str:
    """Text of a PDF by page; needs the pypdf library, without which PDF files report an error."""
    try:
        import pypdf
    except ImportError as x:
        raise RuntimeError("no PDF library") from x
    pages = pypdf.PdfReader(io.BytesIO(raw)).pages
    return "\n".join(f"Heading 1: Page {k}\nParagraph: " + " ".join((p.extract_text() or "").split()) for k, p in enumerate(pages, 1))


Reader = Callable[[bytes, str], str]
#: By extension, in the order they are tried; callers may pass their own (S16 and the extractor map).
READERS: dict[str, tuple[Reader, ...]] = {"txt": (text_outline,), "md": (markdown_outline,), "docx": (docx_outline, docx_plain), "xlsx": (excel_outline,), "xls": (excel_outline,), "pdf": (pdf_outline,)}


def read_outlines(files: DataFrame, readers: dict[str, Reader | tuple[Reader, ...]] = READERS, workers: int | None = None) -> DataFrame:
    """(path, name, extension, outline, error) of listed files by their extension (S7, S8, S16): the first of its readers that doesn't fail; if all do, a null outline and the errors. An unknown extension gives no row. With ``workers`` the files are dealt to so many tasks."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, errors = [], []
            for name, ext, raw in zip(b.column("name").to_pylist(), b.column("extension").to_pylist(), b.column("content").to_pylist(), strict=True):
                text, failed = None, []
                chain = readers[ext]
                for read in chain if isinstance(chain, tuple) else (chain,):
                    try:
                        text = read(raw, name)
                        break
                    except Exception as x:  # noqa: BLE001 - one bad file must not stop the rest
                        failed.append(f"{type(x).__name__}: {x}")
                texts.append(text)
                errors.append("; ".join(failed) if text is None else None)
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("name"), b.column("extension"), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "name", "extension", "outline", "error"])

    known = files.where(F.col("extension").isin(*readers)).select("path", "name", "extension", "content")
    if workers:
        known = known.repartition(workers)
    return known.mapInArrow(go, "path string, name string, extension string, outline string, error string")


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, value) of text files, whole."""
    return spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")


def read_chunk_files(spark: SparkSession, folder: str, block: int = 4 << 20) -> DataFrame:
    """(doc_id, file_name, value) of what write_chunk_files wrote: only the documents' folders are listed by the driver, their files by the tasks that read them."""
    fs, at = FileSystem.from_uri(folder)
    below = [x.base_name for x in fs.get_file_info(FileSelector(at)) if x.base_name.startswith("doc_id=")]
    names = pa.schema([("doc_id", pa.string()), ("file_name", pa.string()), ("value", pa.string())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = FileSystem.from_uri(folder)
        rows, held = [], 0
        for b in batches:
            for name in b.column("folder").to_pylist():
                doc = unquote(name.removeprefix("doc_id="))
                for x in fs.get_file_info(FileSelector(f"{at}/{name}")):
                    if x.base_name[0] in "._":
                        continue
                    with fs.open_input_file(x.path) as f:
                        raw = f.read()
                    rows.append((None if doc == NO_DOC else doc, x.base_name, raw.decode()))
                    held += len(raw) + 100
                    if held > block:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=names)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=names)

    folders = spark.createDataFrame(pa.table({"folder": pa.array(below, pa.string())})).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return folders.mapInArrow(go, "doc_id string, file_name string, value string")


def read_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table over JDBC (S2); partitioning options are passed on."""
    return spark.read.jdbc(url, table, properties=options)


def read_questions(spark: SparkSession, path: str, columns: tuple[str, ...] = ("segments", "paper", "id", "category", "question", "content")) -> DataFrame:
    """Question sheets, only ``columns`` being read (S26): CSV by Spark, Excel by the reader above."""
    if path.lower().endswith((".xlsx", ".xls")):
        raw = spark.read.format("binaryFile").load(path).select("content").first()[0]
        rows = xlsx_rows(raw)[0][1]
        head = rows[0]
        data = [[(r[head.index(c)] if c in head and head.index(c) < len(r) else None) or None for c in columns] for r in rows[1:]]
        return spark.createDataFrame(data, ", ".join(f"{c} string" for c in columns))
    return spark.read.csv(path, header=True, multiLine=True, escape='"').select(*columns)


def read_companies(spark: SparkSession, path: str) -> DataFrame:
    """(sha1, company_name) of a CSV file, the name from company_name or else name, outer quotes stripped."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    name = F.coalesce(*[F.col(c) for c in ("company_name", "name") if c in df.columns])
    return df.select("sha1", F.regexp_replace(name, '^"+|"+$', "").alias("company_name"))


def run_script(spark: SparkSession, text: str) -> int:
    """Runs the statements of a script in order (S5); how many there were."""
    from tessel.plans.sql import pieces

    parts, run = [], ""
    for s, literal in pieces(re.sub(r"--[^\n]*", "", text)):
        if literal:
            run += s
            continue
        *whole, rest = s.split(";")
        for w in whole:
            parts.append(run + w)
            run = ""
        run += rest
    done = 0
    for s in [*parts, run]:
        if s.strip():
            spark.sql(s)
            done += 1
    return done
