from pyspark.sql import functions as F

from tessel.operators.lookups import lookup, nan_to_null, share_of_total
from tessel.operators.ranking import ranks_in_groups
from tessel.plans.lineage import Cut
from tessel.plans.sized import small_side, written_bytes


def test_ranks_run_on_across_tasks(spark):
    rows = [(None if i % 7 == 0 else "hot" if i % 3 else f"g{i % 5}", i % 50, i) for i in range(600)] + [("hot", None, -1)]
    d = spark.createDataFrame(rows, "g string, o int, i int").repartition(7)
    got = ranks_in_groups(d, ["g"], ["o"]).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r.g, []).append((r["rank"], -1 if r.o is None else r.o))
    assert len(got) == len(rows)
    for v in by.values():
        v.sort()
        assert [k for k, _ in v] == list(range(len(v))) and [o for _, o in v] == sorted(o for _, o in v)
    assert ranks_in_groups(d.limit(0), ["g"], ["o"]).count() == 0


def test_broadcast_only_when_small(spark):
    t = Cut(spark)(spark.range(1000), "t")
    assert written_bytes(t) > 0
    plan = lambda most: spark.range(10).join(small_side(t, most), "id")._jdf.queryExecution().logical().toString()
    assert "ResolvedHint" in plan(1 << 20) or "UnresolvedHint" in plan(1 << 20)
    assert "Hint" not in plan(1)


def test_lookup_states(spark):
    t = spark.createDataFrame([("a", 1)], "k string, v int")
    q = spark.createDataFrame([("a", "good"), ("a", "bad"), ("b", "good"), (None, "good")], "k string, who string")
    got = lookup(q, t, ["k"], F.col("who") == "good").collect()
    assert sorted((r.k or "", r.who, r.status_code, r.v) for r in got) == [("", "good", 404, None), ("a", "bad", 401, None), ("a", "good", 200, 1), ("b", "good", 404, None)]


def test_shares_and_nan(spark):
    d = spark.createDataFrame([("x", 1.0), ("x", 3.0), ("y", float("nan"))], "g string, v double")
    clean = nan_to_null(d)
    assert sorted(r.percent or -1 for r in share_of_total(clean, "v", ["g"]).collect()) == [-1, 25.0, 75.0]
    assert sorted(r.percent or -1 for r in share_of_total(clean, "v").collect()) == [-1, 25.0, 75.0]
