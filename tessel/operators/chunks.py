"""Cutting, merging and overlapping chunks.

Orders within a document's path are folded in the JVM by ``aggregate`` over the
sorted array of its chunks; only the recursive splitter of oversized leaves is
Python, over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions.text import is_included, is_overlapping, overlap_text, with_titles, without_overlap, without_titles

#: Separators of the recursive splitter, strongest first.
SEPARATORS = ["\n\n", "\n", "。", "！", "？", "；", ".", "!", "?", ";"]
MAX_LENGTH, OVERLAP = 4096, (200, 400)
STRINGS = "array<string>"


def windows(length: Column, size: int, overlap: int = 0) -> Column:
    """Starts of fixed windows over ``length`` characters."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be below the size")
    return F.when(length > 0, F.sequence(F.lit(0), length - 1, F.lit(size - overlap))).otherwise(F.array(F.lit(0)))


def presplit(docs: DataFrame, doc: str = "doc_id", text: str = "text", size: int = 100_000, overlap: int = 0) -> DataFrame:
    """(doc, chunk_index, total_chunks, is_chunked, chunk): fixed windows over texts longer than ``size``."""
    t = F.coalesce(F.col(text), F.lit(""))
    starts = F.when(F.length(t) > size, windows(F.length(t), size, overlap)).otherwise(F.array(F.lit(0)))
    # generator and cut are one code-generated stage: the text is passed on by reference and dropped, never copied into a row a chunk
    rows = docs.select(F.col(doc), t.alias("_t"), starts.alias("_s")).select(doc, "_t", F.size("_s").alias("total_chunks"), F.posexplode("_s").alias("chunk_index", "_at"))
    return rows.select(doc, "chunk_index", "total_chunks", (F.col("total_chunks") > 1).alias("is_chunked"), F.substring("_t", F.col("_at") + 1, F.lit(size)).alias("chunk"))


def split_nodes(nodes: DataFrame, key: str, text: str = "text", size: int = 512, ratio: float = 0.0) -> DataFrame:
    """Child nodes of a fixed size with the parent's other columns, its text left out (R7): chunk_index, chunk_start, chunk_end, is_child_node, parent_text_length, child_text. A text within the size is one node that is no child; empty texts too."""
    step = size - int(size * ratio)
    if not 0 < step <= size:
        raise ValueError("the overlap ratio must be in [0, 1)")
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    starts = F.when(n > size, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array(F.lit(0)))
    others = [c for c in nodes.columns if c != text]
    # as in presplit, the text never becomes part of a child's row
    rows = nodes.select(*others, F.coalesce(F.col(text), F.lit("")).alias("_t"), n.alias("parent_text_length"), F.posexplode(starts).alias("chunk_index", "chunk_start"))
    return rows.select(*others, "chunk_index", "chunk_start", "parent_text_length", F.least(F.col("chunk_start") + size, F.col("parent_text_length")).alias("chunk_end"), (F.col("parent_text_length") > size).alias("is_child_node"), F.substring("_t", F.col("chunk_start") + 1, F.lit(size)).alias("child_text"))


def recursive_split(text: str, most: int, separators: list[str] = SEPARATORS) -> list[str]:
    """Parts of at most ``most`` characters, cut behind the strongest separators that serve; together they are the text."""
    if len(text) <= most:
        return [text] if text else []
    for k, s in enumerate(separators):
        if s not in text:
            continue
        parts = [p + s for p in text.split(s)]
        parts[-1] = parts[-1][: -len(s)]
        out, run = [], ""
        for p in parts:
            for q in [p] if len(p) <= most else recursive_split(p, most, separators[k + 1 :]):
                if run and len(run) + len(q) > most:
                    out.append(run)
                    run = ""
                run += q
        return [*out, run] if run else out
    return [text[i : i + most] for i in range(0, len(text), most)]


def leaf_chunks(leaves: DataFrame, most: int = MAX_LENGTH, least: int = 100, overlap: int = 400) -> DataFrame:
    """(doc_id, chunk_id, node_idx, chunk_index, path_titles, content, original_text_length, chunk_text_length) of nodes with path_titles and text."""
    base = leaves.select("doc_id", "node_idx", "path_titles", "node_type", F.coalesce("text", F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [recursive_split(t, most) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", "node_idx", "path_titles", "node_type", "text")], pa.array(parts, pa.list_(pa.string()))], names=["doc_id", "node_idx", "path_titles", "node_type", "text", "parts"])

    kind = leaves.schema["doc_id"].dataType.simpleString()
    long = base.where(F.length("text") > most).mapInArrow(cut, f"doc_id {kind}, node_idx int, path_titles array<string>, node_type string, text string, parts array<string>")
    parts = base.where(F.length("text") <= most).withColumn("parts", F.array("text")).unionByName(long)
    bodies = add_overlap(merge_short_runs(F.col("parts"), least), overlap)
    return (
        parts.select("doc_id", "node_idx", "path_titles", "node_type", F.length("text").alias("original_text_length"), F.posexplode(bodies).alias("chunk_index", "body"))
        .withColumn("chunk_id", F.concat(F.lit("node_"), F.col("node_idx"), F.lit("_chunk_"), F.col("chunk_index")))
        .withColumn("content", with_titles(F.col("path_titles"), F.col("body")))
        .withColumn("chunk_text_length", F.length("body"))
        .drop("body")
    )


def merge_short_runs(bodies: Column, least: int) -> Column:
    """Runs of bodies shorter than ``least`` are joined; a run that is still too short goes to the body before it."""
    state = "struct<out:array<string>,run:array<string>>"
    empty = F.struct(F.array().cast(STRINGS).alias("out"), F.array().cast(STRINGS).alias("run")).cast(state)

    def flush(s: Column) -> Column:
        run, out = F.array_join(s["run"], "\n"), s["out"]
        total = F.aggregate(s["run"], F.lit(0), lambda a, x: a + F.length(x))
        glued = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.concat(F.element_at(out, -1), F.lit("\n"), run)))
        return F.when(F.size(s["run"]) == 0, out).when((total < least) & (F.size(out) > 0), glued).otherwise(F.concat(out, F.array(run)))

    def step(s: Column, x: Column) -> Column:
        short = F.struct(s["out"].alias("out"), F.concat(s["run"], F.array(x)).alias("run"))
        long = F.struct(F.concat(flush(s), F.array(x)).alias("out"), F.array().cast(STRINGS).alias("run"))
        return F.when(F.length(x) < least, short).otherwise(long).cast(state)

    return F.aggregate(bodies, empty, step, flush)


def pack_bodies(bodies: Column, most: int = MAX_LENGTH) -> Column:
    """Bodies joined by blank lines up to ``most`` characters, what overlaps the end of the text so far being left out; a body beyond ``most`` stays whole."""
    state = "struct<out:array<string>,run:string>"
    empty = F.struct(F.array().cast(STRINGS).alias("out"), F.lit("").alias("run")).cast(state)

    def step(s: Column, x: Column) -> Column:
        b = F.when((s["run"] != "") & is_overlapping(s["run"], x), without_overlap(s["run"], x)).otherwise(x)
        over = F.length(s["run"]) + F.length(b) > most
        full = F.struct(F.when(s["run"] != "", F.concat(s["out"], F.array(s["run"]))).otherwise(s["out"]).alias("out"), b.alias("run"))
        more = F.struct(s["out"].alias("out"), F.when(s["run"] == "", b).otherwise(F.concat(s["run"], F.lit("\n\n"), b)).alias("run"))
        return F.when(over, full).otherwise(more).cast(state)

    return F.aggregate(bodies, empty, step, lambda s: F.when(s["run"] != "", F.concat(s["out"], F.array(s["run"]))).otherwise(s["out"]))


def least_body(bodies: Column, least: int = 200) -> Column:
    """A body shorter than ``least`` takes in those that follow until it is not; a short last one goes to the one before it."""
    state = "struct<out:array<string>,run:string>"
    empty = F.struct(F.array().cast(STRINGS).alias("out"), F.lit(None).cast("string").alias("run")).cast(state)
    join = lambda a, b: F.when(a.isNull(), b).otherwise(F.concat(a, F.lit("\n\n"), b))

    def step(s: Column, x: Column) -> Column:
        run = join(s["run"], x)
        done = F.struct(F.concat(s["out"], F.array(run)).alias("out"), F.lit(None).cast("string").alias("run"))
        return F.when(F.length(run) >= least, done).otherwise(F.struct(s["out"].alias("out"), run.alias("run"))).cast(state)

    def end(s: Column) -> Column:
        out = s["out"]
        glued = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(join(F.element_at(out, -1), s["run"])))
        return F.when(s["run"].isNull(), out).when(F.size(out) > 0, glued).otherwise(F.array(s["run"]))

    return F.aggregate(bodies, empty, step, end)


def add_overlap(bodies: Column, most: int, least_length: int = 128, least_overlap: int = 50) -> Column:
    """Each body but the first led by the end of the one before it as it was (D11, D14): if it is at least 128 long, the one before longer than ``most``, not included already, and the end longer than 50."""

    state = "struct<out:array<string>,prev:string>"
    empty = F.struct(F.array().cast(STRINGS).alias("out"), F.lit(None).cast("string").alias("prev")).cast(state)

    def step(s: Column, x: Column) -> Column:
        prev, end = s["prev"], overlap_text(s["prev"], most)
        wanted = (F.length(x) >= least_length) & (F.length(prev) > most) & ~is_included(prev, x, most) & (F.length(end) > least_overlap) & ~F.startswith(x, end)
        led = F.when(F.coalesce(wanted, F.lit(False)), F.concat(end, F.lit("\n\n"), x)).otherwise(x)
        return F.struct(F.concat(s["out"], F.array(led)).alias("out"), x.alias("prev")).cast(state)

    return F.aggregate(bodies, empty, step, lambda s: s["out"])


def merge_by_path(chunks: DataFrame, most: int = MAX_LENGTH, least: int = 200, overlap: int = 400) -> DataFrame:
    """(doc_id, path_titles, first_node, last_node, n_merged, chunk_index, chunk_id, content): the chunks of a path packed together, in order of node and chunk (A2, T7, D12-D15). Groups are a document's path."""
    body = without_titles(F.col("content"), F.col("path_titles"))
    rows = F.array_sort(F.collect_list(F.struct("node_idx", "chunk_index", body.alias("body"))))
    paths = chunks.groupBy("doc_id", "path_titles").agg(rows.alias("rows"))
    bodies = F.transform("rows", lambda r: r["body"])
    merged = add_overlap(least_body(pack_bodies(bodies, most), least), overlap)
    return (
        paths.select("doc_id", "path_titles", F.size("rows").alias("n_merged"), F.get("rows", F.lit(0))["node_idx"].alias("first_node"), F.element_at("rows", -1)["node_idx"].alias("last_node"), F.posexplode(merged).alias("chunk_index", "body"))
        .withColumn("chunk_id", F.concat(F.lit("path_merged_"), F.col("first_node"), F.lit("_to_"), F.col("last_node")))
        .withColumn("content", with_titles(F.col("path_titles"), F.col("body")))
        .drop("body")
    )


def chunk_index(chunks: DataFrame) -> DataFrame:
    """(doc_id, total_chunks, chunks_by_node, chunks_by_path): ids by node and by joined path (A3)."""
    ids = F.sort_array(F.collect_list("chunk_id"))
    by_node = chunks.groupBy("doc_id", "node_idx").agg(ids.alias("ids"))
    by_path = chunks.groupBy("doc_id", F.array_join("path_titles", " > ").alias("path")).agg(ids.alias("ids"))
    n = by_node.groupBy("doc_id").agg(F.sum(F.size("ids")).alias("total_chunks"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("node_idx", "ids")))).alias("chunks_by_node"))
    p = by_path.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "ids")))).alias("chunks_by_path"))
    return n.join(p, "doc_id")


def numbered_names(chunks: DataFrame, prefix: str) -> DataFrame:
    """File names of chunks in order, the sequence zero-padded to four digits or as many as the count has (K1)."""
    w = Window.partitionBy("doc_id")
    n = F.row_number().over(w.orderBy("node_idx", "chunk_index"))
    width = F.greatest(F.lit(4), F.length(F.count(F.lit(1)).over(w).cast("string")))
    return chunks.withColumn("file_name", F.concat(F.lit(prefix + "_"), F.lpad(n.cast("string"), width, F.lit("0")), F.lit(".txt")))


def sentence_chunks(docs: DataFrame, doc: str = "doc_id", text: str = "text", size: int = 1024, overlap: int = 200, count: Callable[[str], int] | None = None) -> DataFrame:
    """(doc, chunk_index, chunk): whole sentences up to ``size`` tokens, a chunk beginning with the last sentences of the one before it up to ``overlap`` tokens (D2). ``count`` gives the tokens of a sentence; by default a token is a word or a single Chinese character. A sentence beyond ``size`` stays whole."""
    import re

    sentence, token = re.compile(r"[^。！？.!?\n]*(?:[。！？!?\n]+|\.(?=\s|$)|\.|$)\s*"), re.compile(r"[一-鿿]|[^\s一-鿿]+")
    kind = docs.schema[doc].dataType.simpleString()
    tokens = count or (lambda s: len(token.findall(s)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, at, out = [], [], []
            for key, t in zip(b.column(doc).to_pylist(), b.column(text).to_pylist(), strict=True):
                run: list[tuple[str, int]] = []
                n = k = 0
                for m in sentence.finditer(t or ""):
                    s, c = m[0], tokens(m[0])
                    if run and n + c > size:
                        ids.append(key)
                        at.append(k)
                        out.append("".join(x for x, _ in run))
                        k += 1
                        back, held = [], 0
                        for x in reversed(run):
                            if held + x[1] > overlap or held + x[1] + c > size:
                                break
                            back.insert(0, x)
                            held += x[1]
                        run, n = back, held
                    if s:
                        run.append((s, c))
                        n += c
                if run:
                    ids.append(key)
                    at.append(k)
                    out.append("".join(x for x, _ in run))
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(doc).type), pa.array(at, pa.int32()), pa.array(out, pa.string())], names=[doc, "chunk_index", "chunk"])

    return docs.select(doc, text).mapInArrow(cut, f"`{doc}` {kind}, chunk_index int, chunk string")
