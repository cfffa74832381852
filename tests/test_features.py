from datetime import datetime as T

import pytest
from pyspark.sql import functions as F

from tessel.operators.current import current_facts, current_rows
from tessel.operators.features import feature_blocks, open_blocks, type_features

SCHEMA = "e string, k string, at timestamp, amt double, st string, entity string, features_0 int"


def build(spark, rows, entities, block=64):
    f = type_features(spark.createDataFrame([(*r[:3], None if r[3] is None else float(r[3]), *r[4:]) for r in rows], SCHEMA), "e", "k", "at", "amt", "st", "2024-12-31", ("SUCCESS", "FAILED"))
    return feature_blocks(f, spark.createDataFrame(entities, "id string, entity string, n int"), "id", block)


def test_features_and_blocks(spark):
    t = T(2024, 12, 1)
    rows = [("a", "X", t, 1.5, "SUCCESS", "q", 1), ("a", "X", T(2024, 1, 1), None, None, None, None), ("a", "Y", t, 2, "FAILED", "q", 1), (None, "X", t, 1, "SUCCESS", "q", 1), ("a", None, t, 1, "SUCCESS", "q", 1), ("zz", "X", t, 1, "SUCCESS", "q", 1)]
    rows += [("a", f"T{i}", t, 1, "OTHER", "q", 1) for i in range(20)]
    out = build(spark, rows, [("a", "e1", 5), ("b", None, None)], block=4)
    assert len([c for c in out.columns if c.startswith("features_")]) > 3 and {"id", "entity", "n"} <= set(out.columns)
    assert {r.id: r.entity for r in out.collect()} == {"a": "e1", "b": None}
    got = {(r.id, r.kind): r for r in open_blocks(out, "id").collect()}
    assert len(got) == 22
    x = got["a", "X"]
    assert (x.n, float(x.total), x.recency_days, x.n_success, x.n_failed, x.n_other) == (2, 1.5, 30, 1, 0, 1)
    assert got["a", "T3"].n_other == 1


def test_blocks_need_no_further_shuffle(spark):
    out = build(spark, [("a", f"T{i}", T(2024, 1, 1), 1, "SUCCESS", "", 0) for i in range(9)], [("a", "", 1)], block=3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan, plan


def test_empty_and_clash(spark):
    assert build(spark, [], [("a", "e", 1)]).count() == 1
    assert build(spark, [("a", "X", None, None, None, None, None)], []).count() == 0
    f = type_features(spark.createDataFrame([], SCHEMA), "e", "k", "at", "amt", "st", "2024-12-31", ("SUCCESS",))
    with pytest.raises(ValueError):
        feature_blocks(f, spark.createDataFrame([("a", 1)], "id string, features_0 int"), "id")


def test_current_rows(spark):
    rows = [("1", 1, "a", 5), ("1", 2, "b", None), ("1", 2, "c", 1), ("2", None, "x", 2), ("2", None, "x", 2), (None, 1, "n", 1), (None, 1, "n", 1)]
    d = spark.createDataFrame(rows, "tid string, sent int, v string, id int")
    got = sorted((r.id or "", r.v) for r in current_rows(d, "tid", "sent", v=F.col("v")).collect())
    assert got == [("", "n"), ("", "n"), ("1", "c"), ("2", "x")]


def test_current_facts(spark):
    rows = [("1", 1, "A ", 5.0, 3), ("1", 2, "a", None, 1), ("1", 2, "a", 5.0, 0), ("2", None, "b", 2.0, 2), ("2", None, "b", 2.0, 2), (None, 1, "n", 1.0, 1), (None, 1, "n", 1.0, 1)]
    d = spark.createDataFrame([(i, None if s is None else T(2024, 1, s), k, v, c) for i, s, k, v, c in rows], "tid string, sent timestamp, k string, v double, c int").withColumn("id", F.lit("clash"))
    out = current_facts(d, "tid", "sent", {"key": F.upper(F.trim("k"))}, {"v": F.col("v")}, F.col("c"))
    assert sorted((r.id or "", r.key, r.v, r.code) for r in out.collect()) == [("", "N", 1.0, 1), ("", "N", 1.0, 1), ("1", "A", 5.0, 1), ("2", "B", 2.0, 2)]
    assert current_facts(d.limit(0), "tid", "sent", {"key": F.col("k")}, {"v": F.col("v")}).count() == 0
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
