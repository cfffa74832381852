from datetime import datetime as T

from tessel.operators.references import deletions_of, orphan_references, parents_of

EVENTS = "id string, a string, b string, at timestamp, kind string, raw string, key string"
FIELDS = {"a": "acc", "b": "acc"}


def run(spark, events, parents, deletions=()):
    p = parents_of(spark.createDataFrame(parents, "k string, made timestamp, created string"), "acc", "k", "made")
    d = deletions_of(spark.createDataFrame(list(deletions), "entity string, record_id string, deleted_time timestamp, restored_time timestamp"))
    rows = orphan_references(spark.createDataFrame(events, EVENTS), FIELDS, "id", "at", [p], d).collect()
    return {(r.id, r.field): r.reason for r in rows}


def ev(i, a, b=None, at=T(2024, 1, 10)):
    return (i, a, b, at, "x", "y", "z")


def test_reasons_and_spellings(spark):
    parents = [("A1", T(2023, 1, 1), None), ("A2", T(2024, 1, 20), None), ("A3", None, None), (None, None, None), ("A1", T(2025, 1, 1), None)]
    dels = [("acc", "A3", T(2024, 1, 5), T(2024, 1, 10)), ("acc", "a3 ", T(2024, 1, 12), None), ("other", "A1", T(2020, 1, 1), None), ("acc", "A1", None, None)]
    events = [ev("1", " a1\t"), ev("2", "Ａ２"), ev("3", "A2", at=T(2024, 1, 20)), ev("4", "A3"), ev("5", "A3", at=T(2024, 1, 9)), ev("6", "A3", at=T(2024, 1, 13)), ev("7", "nope", "A1"), ev("7", "nope "), ev("8", None, "　"), ev("9", "A1", at=None)]
    assert run(spark, events, parents, dels) == {("2", "a"): "created_later", ("5", "a"): "deleted", ("6", "a"): "deleted", ("7", "a"): "missing", ("9", "a"): "created_later"}


def test_empty_tables(spark):
    assert run(spark, [], [("A1", None, None)]) == {}
    assert run(spark, [ev("1", "A1")], []) == {("1", "a"): "missing"}


def test_long_and_hot_keys(spark):
    long = "K" * 50_000
    events = [ev(str(i), "HOT") for i in range(500)] + [ev("l", long)]
    assert run(spark, events, [(long, None, None)]) == {(str(i), "a"): "missing" for i in range(500)}


def test_tables_go_with_their_cut(spark):
    from pyspark.errors import AnalysisException

    from tessel.plans.lineage import Cut
    from tessel.sources.sinks import exists

    with Cut(spark) as cut:
        at = cut(spark.range(3), "one")._tessel_path
        cut(spark.range(3), "two")
        assert exists(spark, at) and len(cut.paths) == 2
    assert not exists(spark, at) and not cut.paths
    import pytest

    with pytest.raises(AnalysisException):
        spark.read.parquet(at)
