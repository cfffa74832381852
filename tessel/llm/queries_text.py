"""Queries p2, p7 and p8."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.functions.keys import is_blank
from tessel.llm.mixing import mix
from tessel.llm.packing import pack_all
from tessel.llm.splitting import split_oversized
from tessel.llm.tokens import with_tokens
from tessel.plans.lineage import Cut


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


# 2 ---------------------------------------------------------------------------


def p2_items(spark: SparkSession, sf: str) -> DataFrame:
    """(file_id, node_index, chunk_index, body, titles) of nodes other than roots and of chunks, each once."""
    nodes = (
        read(spark, sf, "document_node")
        .where(F.coalesce(F.lower(F.col("node_type")) != "root", F.lit(True)))
        .select("file_id", "node_index", F.lit(-1).alias("chunk_index"), F.col("text").alias("body"), F.lit("").alias("titles"))
    )
    titles = F.array_join(F.filter(F.coalesce("path_titles", F.array().cast("array<string>")), lambda t: ~is_blank(t)), " > ")
    chunks = read(spark, sf, "text_chunk").select("file_id", F.col("source_node_index").alias("node_index"), "chunk_index", F.col("content").alias("body"), titles.alias("titles"))
    # whole rows repeat: keys are hashed and only one of equal rows goes on
    return nodes.unionByName(chunks).dropDuplicates(["file_id", "node_index", "chunk_index"])


def p2_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split_oversized(p2_items(spark, sf), ["file_id", "node_index", "chunk_index"], "body", F.col("titles"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_pieces(spark, sf).where("oversize and piece = 0").select("file_id", "node_index", "chunk_index")


def p2_rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    """Every item put together again from what its pieces don't repeat: (file_id, node_index, chunk_index, n_chars, text_hash, within, out_of_overlap), the last being the pieces that repeat fewer than 200 or more than 400 characters although the one before is longer."""
    pieces = p2_pieces(spark, sf)
    own = F.right("content", F.col("end") - F.col("body_begin"))
    repeats, before = F.col("body_begin") - F.col("begin"), F.lag(F.col("end") - F.col("body_begin")).over(Window.partitionBy("file_id", "node_index", "chunk_index", "of_titles").orderBy("piece"))
    wrong = (F.col("body_begin") > 0) & ((repeats > 400) | (repeats < 200) & (before >= 200))
    rows = pieces.withColumn("own", F.when(F.col("body_begin") == F.col("end"), "").otherwise(own)).withColumn("wrong", wrong)
    parts = F.array_sort(F.collect_list(F.struct("of_titles", "piece", "own")))
    whole = rows.groupBy("file_id", "node_index", "chunk_index").agg(parts.alias("p"), F.max(F.length("content")).alias("longest"), F.count_if("wrong").alias("out_of_overlap"))
    text = F.array_join(F.transform(F.filter("p", lambda x: ~x["of_titles"]), lambda x: x["own"]), "")
    return whole.select("file_id", "node_index", "chunk_index", F.length(text).alias("n_chars"), F.md5(text.cast("binary")).alias("text_hash"), (F.col("longest") <= 4096).alias("within"), "out_of_overlap")


_WS = "chr(32) || chr(9) || chr(10) || chr(13) || chr(12288)"
P2_SQL = {
    "p2_found": f"""
SELECT DISTINCT file_id, node_index, chunk_index FROM (
 SELECT file_id, node_index, -1 AS chunk_index, length(trim(text, {_WS})) AS n FROM document_node WHERE node_type <> 'root' UNION ALL
 SELECT file_id, source_node_index, chunk_index, length(trim(content, {_WS})) + CASE WHEN t = '' THEN 0 ELSE length(t) + 2 END FROM
  (SELECT *, coalesce(array_to_string(list_filter(path_titles, lambda x: x IS NOT NULL AND trim(x, {_WS}) <> ''), ' > '), '') AS t FROM text_chunk))
WHERE n > 4096""",
    "p2_rebuilt": f"""
SELECT DISTINCT file_id, node_index, chunk_index, length(t) AS n_chars, md5(t) AS text_hash, true AS within, 0 AS out_of_overlap FROM (
 SELECT file_id, node_index, -1 AS chunk_index, coalesce(trim(text, {_WS}), '') AS t FROM document_node WHERE node_type IS NULL OR lower(node_type) <> 'root' UNION ALL
 SELECT file_id, source_node_index, chunk_index, coalesce(trim(content, {_WS}), '') FROM text_chunk)""",
}

# 7 ---------------------------------------------------------------------------


def _sizes(spark: SparkSession, sf: str, *keep: str) -> DataFrame:
    return Cut(spark)(with_tokens(read(spark, sf, "documents"), "text", ["doc_id", *keep]), "tokens")


def _packs(spark: SparkSession, sf: str):
    """(pack_id, capacity, rows, solution, containers of full parts) of each pack."""
    specs = read(spark, sf, "pack_specs").where("capacity_tokens > 0").groupBy("pack_id").agg(F.min("capacity_tokens").alias("c")).collect()  # configuration
    packed = pack_all(_sizes(spark, sf), "doc_id", "tokens", sorted({r["c"] for r in specs}))
    return [(r["pack_id"], r["c"], *packed[r["c"]]) for r in specs]


def _rows(packs) -> DataFrame:
    cols = lambda k, c, df: df.select(F.lit(k).alias("pack_id"), F.lit(c).alias("capacity_tokens"), "container", "doc_id", "part", "tokens")
    return reduce(DataFrame.unionByName, [cols(k, c, df) for k, c, df, *_ in packs])


def p7_pack(spark: SparkSession, sf: str) -> DataFrame:
    """The container of every document, or of each of its parts, for each capacity."""
    return _rows(_packs(spark, sf))


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    """For each capacity containers, the least number that any packing needs, the unused share, and the share of documents that the rounded linear program placed."""
    packs = _packs(spark, sf)
    one = _rows(packs).groupBy("pack_id", "capacity_tokens", "container").agg(F.sum("tokens").alias("t"))
    room = F.count(F.lit(1)) * F.first("capacity_tokens")
    facts = [(k, s.bound + full, float(s.relaxed_items / max(1, sum(t * sum(c.values()) for t, c in s.runs)))) for k, _, _, s, full in packs]
    told = spark.createDataFrame(facts, "pack_id string, least_containers long, relaxed_share double")
    return (
        one.groupBy("pack_id")
        .agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"), F.max(F.col("t") - F.col("capacity_tokens")).alias("most_over"), ((room - F.sum("t")) / room).alias("unused_share"))
        .join(F.broadcast(told), "pack_id")
    )


def p7_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of every packing: all documents are in it, none beyond its capacity, none whole in two containers, the parts of one document numbered from 0 without gaps and all but one full."""
    rows = _rows(_packs(spark, sf))
    docs = rows.groupBy("pack_id", "capacity_tokens", "doc_id").agg(F.count(F.lit(1)).alias("parts"), F.max("part").alias("last"), F.countDistinct("part").alias("distinct"), F.count_if(F.col("tokens") < F.col("capacity_tokens")).alias("short"))
    bad = (F.col("parts") != F.col("distinct")) | (F.col("last") + 1 != F.col("parts")) | (F.col("short") > 1)
    whole = docs.groupBy("pack_id", "capacity_tokens").agg(F.count(F.lit(1)).alias("docs"), F.count_if(bad).alias("docs_wrong"))
    full = rows.groupBy("pack_id", "container", "capacity_tokens").agg(F.sum("tokens").alias("t")).groupBy("pack_id").agg(F.count_if(F.col("t") > F.col("capacity_tokens")).alias("containers_over"))
    return whole.join(full, "pack_id").select("pack_id", "capacity_tokens", "docs", "docs_wrong", "containers_over")


P7_SQL = {
    "p7_invariants": """
SELECT pack_id, min(capacity_tokens) AS capacity_tokens, (SELECT count(*) FROM documents) AS docs, 0 AS docs_wrong, 0 AS containers_over
FROM pack_specs WHERE capacity_tokens > 0 GROUP BY pack_id"""
}

# 8 ---------------------------------------------------------------------------


def _mix(spark: SparkSession, sf: str, size: str = "asked") -> tuple[DataFrame, DataFrame]:
    return mix(_sizes(spark, sf, "source"), read(spark, sf, "mix_targets"), size=size)


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of each mix and how often each is used."""
    return _mix(spark, sf)[0]


def _shares(chosen: DataFrame, rates: DataFrame) -> DataFrame:
    got = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mix_tokens"), F.count(F.lit(1)).alias("docs_used"), F.max("copies").alias("most_copies"))
    all_ = got.groupBy("mix_id").agg(F.sum("mix_tokens").alias("all_tokens"))
    asked = F.col("target_tokens") / F.col("target_share")
    return (
        rates.join(got, ["mix_id", "source"], "left")
        .join(all_, "mix_id", "left")
        .select(
            "mix_id", "source", "target_share", (F.coalesce("mix_tokens", F.lit(0)) / F.col("all_tokens")).alias("actual_share"), (F.coalesce("mix_tokens", F.lit(0)) / asked).alias("share_of_size_asked"),
            "limited", "max_repeats", F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce("docs_used", F.lit(0)).alias("docs_used"), F.coalesce("mix_tokens", F.lit(0)).alias("mix_tokens"), "target_tokens", "size_factor",
        )
    )


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual share of each source of each mix: of what came out, and of the size asked for."""
    return _shares(*_mix(spark, sf))


def p8_met_report(spark: SparkSession, sf: str) -> DataFrame:
    """The same for mixes that shrink until every source that has documents meets its share."""
    return _shares(*_mix(spark, sf, "met"))


def p8_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of every mix: no document twice or beyond its cap, none without text or from a source not listed."""
    chosen, rates = _mix(spark, sf)
    listed = rates.select("mix_id", F.col("source").alias("_listed"), "max_repeats")
    on = (chosen["mix_id"] == listed["mix_id"]) & (chosen["source"] == listed["_listed"])
    docs = chosen.join(F.broadcast(listed), on, "left").select(chosen["mix_id"], "doc_id", "copies", "tokens", "_listed", "max_repeats")
    per = docs.groupBy("mix_id", "doc_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("copies") > F.col("max_repeats")).alias("over"), F.count_if(F.col("_listed").isNull()).alias("foreign"), F.count_if(F.col("tokens") <= 0).alias("empty"))
    bad = per.groupBy("mix_id").agg(F.count_if(F.col("rows") > 1).alias("docs_twice"), F.sum("over").alias("docs_over_cap"), F.sum("foreign").alias("docs_not_listed"), F.sum("empty").alias("docs_empty"))
    return rates.groupBy("mix_id").agg(F.count(F.lit(1)).alias("sources")).join(bad, "mix_id")


P8_SQL = {
    "p8_invariants": """
SELECT mix_id, count(DISTINCT source) AS sources, 0 AS docs_twice, 0 AS docs_over_cap, 0 AS docs_not_listed, 0 AS docs_empty FROM mix_targets GROUP BY mix_id"""
}


QUERIES = {f.__name__: f for f in (p2_found, p2_pieces, p2_rebuilt, p7_pack, p7_report, p7_invariants, p8_mix, p8_report, p8_met_report, p8_invariants)}
SQL = P2_SQL | P7_SQL | P8_SQL
