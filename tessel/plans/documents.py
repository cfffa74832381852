"""The document pipeline with its options: outlines to trees, chunks, files and statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.operators import chunks as C
from tessel.operators import outline as O
from tessel.operators.lookups import not_yet_done
from tessel.plans.lineage import Cut
from tessel.sources import files as S
from tessel.sources import sinks as W


@dataclass(frozen=True)
class Options:
    """What process_documents writes (D16). ``readers`` by extension; ``done`` names earlier outputs, whose inputs are left out if ``incremental``."""

    full_text: bool = True
    tree: bool = True
    chunk_files: bool = True
    chunking: bool = True
    most: int = C.MAX_LENGTH
    overlap: int = 400
    merge_paths: bool = False
    json: bool = True
    index: bool = True
    statistics: bool = True
    incremental: bool = False
    prefix: str = ""
    readers: dict | None = None


def process_files(spark: SparkSession, folder: str, out: str, options: Options = Options()) -> dict[str, DataFrame]:
    """process_documents over the files of a folder; files that can't be read are the frame ``failed``."""
    files = S.list_files(spark, folder)
    read = S.read_outlines(files, options.readers or S.READERS)
    got = process_documents(read.where("outline is not null").select(F.col("name").alias("doc_id"), F.col("outline").alias("text")), out, options)
    return got | {"failed": read.where("outline is null").select("path", "error")}


def process_documents(docs: DataFrame, out: str, options: Options = Options()) -> dict[str, DataFrame]:
    """Outlines (doc_id, text) to nodes, chunks and statistics, each also written below ``out`` as the options say: texts, trees, chunks, chunks_json, chunk_index, statistics. With ``incremental``, documents with a chunk in ``out`` are left out."""
    spark = docs.sparkSession
    cut = Cut(spark)
    if options.incremental and W.exists(spark, f"{out}/chunks_json"):
        done = spark.read.json(f"{out}/chunks_json").select(F.col("doc_id").cast("string").alias("key")).distinct()
        docs = not_yet_done(docs.withColumn("key", F.col("doc_id").cast("string")), [done], "key").drop("key")
    nodes = cut(O.outline_nodes(docs, paths=True), "nodes")
    found = {"nodes": nodes}
    if options.full_text:
        W.write_texts(docs, "text", f"{out}/texts")
    if options.tree:
        W.write_texts(O.tree_text(nodes), "tree", f"{out}/trees")
    if options.chunking:
        chunks = C.leaf_chunks(O.leaf_texts(nodes), options.most, overlap=options.overlap)
        if options.merge_paths:
            chunks = C.merge_by_path(chunks, options.most, overlap=options.overlap).withColumn("node_idx", F.col("first_node"))
        found["chunks"] = chunks = cut(chunks, "chunks")
        if options.chunk_files:
            W.write_chunk_files(chunks, f"{out}/chunks", options.prefix or "chunk")
        if options.json:
            W.write_json(chunks, f"{out}/chunks_json")
        if options.index:
            W.write_chunk_index(chunks, f"{out}/chunk_index")
    if options.statistics:
        found["statistics"] = stats = cut(O.tree_stats(nodes.where("node_type <> 'root'")), "statistics")
        W.write_json(stats, f"{out}/statistics")
    return found
