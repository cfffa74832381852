import random

import pytest

from tessel.operators.hierarchy import Hierarchy

SCHEMA = "file_id long, node_index int, parent_index int, children_indices array<int>, g string, level int"


def brute(rows):
    par, have = {}, {(f, v) for f, v, *_ in rows if f is not None and v is not None}
    for f, v, p, c, *_ in rows:
        if (f, v) in have and p is not None:
            par[f, v] = min(p, par.get((f, v), p))
    claims = {}
    for f, v, p, c, *_ in rows:
        if v is not None:
            for x in c or []:
                if x is not None:
                    claims[f, x] = min(v, claims.get((f, x), v))
    out = {}
    for f, v in have:
        path, at = [v], v
        while True:
            p = par.get((f, at), claims.get((f, at)))
            if p is None or (f, p) not in have:
                out[f, v] = path[::-1]
                break
            if p in path:
                out[f, v] = "loop" if p == v else "into"
                break
            path.append(p)
            at = p
    return out


def run(spark, rows):
    h = Hierarchy(spark.createDataFrame(rows, SCHEMA))
    got = {(r.g, r.v): r for r in h.nodes.collect()}
    paths = {(r.g, r.v): r.path for r in h.paths().collect()}
    below = {}
    for r in h.descendants(3).collect():
        below.setdefault((r.g, r.v), []).append(r.descendant)
    return got, paths, below


def check(spark, rows):
    want = brute(rows)
    got, paths, below = run(spark, rows)
    assert set(got) == set(want)
    for k, path in want.items():
        r = got[k]
        if isinstance(path, str):
            assert r.status == ("loop" if path == "loop" else "into_loop") and r.depth is None, (k, path, r)
        else:
            assert (r.status, r.depth, r.root) == ("tree", len(path) - 1, path[0])
            assert paths[k] == path
            down = sorted(v for (f, v), q in want.items() if f == k[0] and not isinstance(q, str) and k[1] in q[:-1])
            assert sorted(below.get(k, [])) == down and r.size == len(down) + 1
    pre = [(r.g, r.root, r.pre) for r in got.values() if r.status == "tree"]
    assert len(pre) == len(set(pre))


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for f in range(5):
        n = rnd.choice([1, 8, 40])
        for v in range(n):
            p = rnd.choice([None, rnd.randrange(n), rnd.randrange(max(1, v)) if v else None, v - 1 if v else None, 999])
            rows.append((f, v, p, [rnd.randrange(n) for _ in range(rnd.randrange(2))] or None, "x", None))
    rows += rows[:7]
    check(spark, rows)


def test_one_chain_and_one_star(spark):
    rows = [(1, v, v - 1 if v else None, [], "x", v) for v in range(70)] + [(2, v, 0 if v else None, None, None, 1) for v in range(70)]
    check(spark, rows)


def test_empty_and_nulls(spark):
    check(spark, [])
    check(spark, [(None, 1, None, None, None, None), (1, None, 3, [4], None, None), (1, 4, None, [None], None, None), (1, 5, 5, None, None, None)])
