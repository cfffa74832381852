"""What retrieval shuffles: the best of each query, never pairs of queries and documents, nor the texts of the corpus."""

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from tessel import queries_docs, queries_io
from tessel.operators import retrieval as V


def shuffled(spark, run):
    """The result of ``run``, and the rows and bytes its stages have shuffled."""
    sc = spark._jsc.sc()
    gateway, lists = spark.sparkContext._gateway, spark._jvm.java.util.ArrayList

    def stages():
        sc.listenerBus().waitUntilEmpty(30_000)
        seen = sc.statusStore().stageList(lists(), False, False, gateway.new_array(gateway.jvm.double, 0), lists())
        every = [seen.apply(i) for i in range(seen.size())]
        return {(s.stageId(), s.attemptId()): (s.shuffleWriteRecords(), s.shuffleWriteBytes()) for s in every}

    before = stages()
    out = run()
    new = [x for k, x in stages().items() if k not in before]
    return out, sum(x[0] for x in new), sum(x[1] for x in new)


def words(t):
    return re.findall("[a-z0-9]+|[一-鿿]", (t or "").lower())


def bm25(docs, q, k):
    terms, n = dict.fromkeys(words(q)), len(docs)
    avg, df = sum(len(words(t)) for _, t in docs) / n, Counter(w for _, t in docs for w in set(words(t)))
    out = []
    for key, t in docs:
        tf, size = Counter(words(t)), len(words(t))
        parts = [math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * size / avg)) for w in terms if tf[w]]
        if parts:
            out.append((-round(sum(parts), 9), key))
    return [(key, -s) for s, key in sorted(out)[:k]]


def test_bm25_shuffles_no_pairs(spark):
    docs = [(f"n{i}", f"common w{i % 300} w{i % 7} 卡{'片' * (i % 3)} " + "x " * (i % 11)) for i in range(3000)] + [("none", None), ("other", "nothing")]
    asked = [(i, f"Common w{i} common 片") for i in range(300)] + [(1000, None), (1001, ""), (1002, "absent"), (1003, "w5 片 common")]
    d = spark.createDataFrame(docs, "node_id string, text string").repartition(4)
    q = spark.createDataFrame(asked, "query_id long, query string")
    got, rows, _ = shuffled(spark, lambda: V.bm25_top_k(d, q, 3).collect())
    assert rows < 100_000  # of 900,000 pairs
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.node_id, r.score))
    assert set(found) == {*range(300), 1003} and [r[0] for r in found[1003]] == [r[0] for r in found[5]]
    for i in (0, 5, 77, 299):
        want = bm25(docs, asked[i][1], 3)
        assert [x[0] for x in found[i]] == [x[0] for x in want] and all(abs(x[1] - y[1]) < 2e-9 for x, y in zip(found[i], want, strict=True))


def test_bm25_takes_queries_in_turns(spark, monkeypatch):
    d = spark.createDataFrame([(i, f"a{i % 5} b{i % 3} c") for i in range(60)], "node_id long, text string")
    q = spark.createDataFrame([(i, f"a{i % 5} b{i % 2} c") for i in range(20)], "query_id long, query string")
    want = sorted(V.bm25_top_k(d, q, 4).collect())
    monkeypatch.setattr(V, "MAX_QUERIES", 3)
    monkeypatch.setattr(V, "BLOCK_WEIGHTS", 1)
    assert len(want) == 80 and sorted(V.bm25_top_k(d, q, 4).collect()) == want
    assert V.bm25_top_k(d, q.where("query_id < 0"), 4).count() == V.bm25_top_k(d.where("node_id < 0"), q, 4).count() == 0


def test_fusion_shuffles_no_pairs(spark):
    n = 24_000
    d = spark.range(n).select(F.col("id").alias("node_id"), F.concat(F.lit("common w"), F.col("id") % 5).alias("text"), F.array((F.col("id") % 97).cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    q = spark.range(50).select(F.col("id").alias("query_id"), F.concat(F.lit("common w"), F.col("id")).alias("query"))
    v = q.select("query_id", F.array(F.lit(1.0), F.col("query_id").cast("double")).alias("query"))
    got, rows, _ = shuffled(spark, lambda: V.reciprocal_rank_fusion([V.dense_top_k(d, v, 10), V.bm25_top_k(d, q, 10)], 20).collect())
    assert rows < 100_000  # of 1,200,000 pairs
    dense = sorted((-(i % 97 + 3.0), i) for i in range(n))[:10]
    sparse = [i for i in range(n) if i % 5 == 3][:10]
    score = Counter()
    for kept in ([i for _, i in dense], sparse):
        for rank, i in enumerate(kept):
            score[i] += 1 / (60 + rank)
    want = sorted((-round(s, 9), i) for i, s in score.items())[:20]
    assert [(r.node_id, r.rank) for r in sorted(got, key=lambda r: r.rank) if r.query_id == 3] == [(i, k) for k, (_, i) in enumerate(want)]


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    """1,000 documents of 19,200 characters that don't compress, and a table of vectors."""
    at = str(tmp_path_factory.mktemp("long"))
    text = F.concat(F.lit("common "), *[F.sha2(F.concat_ws("-", "id", F.lit(i)), 256) for i in range(300)])
    spark.range(1000).repartition(8).select(F.col("id").alias("doc_id"), F.concat(F.lit("Common w"), F.col("id")).alias("title"), text.alias("text")).write.parquet(f"{at}/documents.parquet")
    spark.range(60).select(F.col("id").alias("vec_id"), F.array((F.col("id") % 7).cast("float"), F.lit(1.0).cast("float")).alias("embedding")).write.parquet(f"{at}/embeddings.parquet")
    return at


def least_shuffle(spark, at, name):
    got, _, size = shuffled(spark, lambda: {**queries_docs.QUERIES, **queries_io.QUERIES}[name](spark, at).collect())
    assert got and size < 4_000_000, size  # of 19,200,000 characters


def test_split_rerank_shuffles_no_texts(spark, long_texts):
    least_shuffle(spark, long_texts, "rag_split_rerank")


def test_parent_max_shuffles_no_texts(spark, long_texts):
    least_shuffle(spark, long_texts, "rag_parent_max")


def test_served_shuffles_no_texts(spark, long_texts):
    least_shuffle(spark, long_texts, "rag_served")


def test_dense_search_embeds_a_text_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        made.add(len(texts))
        return texts.map(lambda t: None if t == "none" else [float(len(t)), 1.0])

    d = spark.createDataFrame([(i, "none" if i % 10 == 0 else "x" * (i % 7)) for i in range(200)], "node_id long, text string").repartition(3)
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [-1.0, 0.0])], "query_id long, query array<double>")
    got = V.dense_top_k(d.select("node_id", embed("text").alias("embedding")), q, 3).collect()
    assert made.value == 200
    longest, shortest = ([i for i in range(200) if i % 10 and i % 7 == n][:3] for n in (6, 0))
    assert sorted((r.query_id, r.rank, r.node_id) for r in got) == [(i, k, x) for i in (1, 2, 3, 5) for k, x in enumerate(longest if i % 2 and i < 5 else shortest)]


def test_hash_embedding_counts_hashed_words(spark):
    texts = ["Pay pay the bill 卡片卡", None, "", "--", "a " * 500 + "b"]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.v for r in d.select("i", V.hash_embedding(16)("t").alias("v")).orderBy("i").collect()]
    for t, v in zip(texts, got, strict=True):
        want = np.zeros(16)
        for w in words(t):
            h = xxhash.xxh64_intdigest(w)
            want[h % 16] += 1 if h >> 63 else -1
        assert v == (want / (np.linalg.norm(want) or 1)).astype(np.float32).tolist()
