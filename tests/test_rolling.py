from datetime import date, timedelta

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessel.operators.rolling import MAX, MIN, SUM, daily, rolling_totals, two_stack


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=40), st.integers(1, 12))
def test_two_stack_is_the_window(values, w):
    x = np.array([values, values[::-1]], dtype=np.int64)
    for monoid, f in ((SUM, np.sum), (MIN, np.min), (MAX, np.max)):
        want = np.array([[f(r[max(0, t - w + 1) : t + 1]) for t in range(len(r))] for r in x])
        assert (two_stack(x, w, monoid) == want).all()


def test_against_brute_force(spark):
    first, last = date(2024, 1, 1), date(2024, 3, 1)
    rnd = np.random.default_rng(3)
    rows = [(str(rnd.integers(4)), first + timedelta(days=int(rnd.integers(-20, 60))), None if rnd.random() < 0.2 else float(rnd.integers(-500, 500)) / 100, "x") for _ in range(150)]
    rows += [(None, first, 1.0, "x"), ("0", None, 1.0, "x"), ("9", first, 1.0, "x")]
    ev = spark.createDataFrame(rows, "e string, d date, a double, entity string").selectExpr("e", "d", "cast(a as decimal(15,2)) a", "entity")
    ents = spark.createDataFrame([(str(i),) for i in range(6)], "k string")
    out = rolling_totals(ents, "k", daily(ev, "e", "d", "a"), first, last, (7, 30), ("count", "total", "avg", "min", "max")).collect()
    assert len(out) == 6 * 61
    for r in out:
        for w in (7, 30):
            mine = [a for e, d, a, _ in rows if e == r.k and d is not None and r.day - timedelta(days=w - 1) <= d <= r.day]
            full = [a for a in mine if a is not None]
            assert r[f"count_{w}"] == len(mine)
            assert abs(float(r[f"total_{w}"]) - sum(full)) < 1e-9
            if full:
                assert abs(r[f"avg_{w}"] - sum(full) / len(full)) < 1e-9 and float(r[f"min_{w}"]) == min(full) and float(r[f"max_{w}"]) == max(full)
            else:
                assert r[f"avg_{w}"] is None and r[f"min_{w}"] is None and r[f"max_{w}"] is None


def test_huge_amounts_and_empty(spark):
    big = ev = spark.range(6 * 2**11).selectExpr("'a' e", "date '2024-01-01' d", "cast('9999999999999.99' as decimal(15,2)) a")
    out = rolling_totals(spark.createDataFrame([("a",)], "k string"), "k", daily(big, "e", "d", "a"), date(2024, 1, 1), date(2024, 1, 2), (7,)).collect()
    assert str(out[1]["total_7"]) == str(9999999999999_99 * 6 * 2**11)[:-2] + "." + str(9999999999999_99 * 6 * 2**11)[-2:]
    none = spark.createDataFrame([], "k string")
    assert rolling_totals(none, "k", daily(ev, "e", "d", "a"), date(2024, 1, 1), date(2024, 1, 2), (7,)).count() == 0
    assert rolling_totals(spark.createDataFrame([("z",)], "k string"), "k", daily(ev.limit(0), "e", "d", "a"), date(2024, 1, 1), date(2024, 1, 2), (7,)).count() == 2
