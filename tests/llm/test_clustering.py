"""Dual-tree Lloyd against plain Lloyd on integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_texts import sql_of

from webquarry.llm import clustering
from webquarry.llm.queries import OP12_SQL

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def fixture(n=400):
    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(9)]
    rows = [(i, [x + rng.gauss(0, 0.25) for x in rng.choice(centres)]) for i in range(n)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # copies
    rows += [(2000, None), (2001, [0.5] * 63), (2002, [0.5] * 65), (2003, [None] * 64), (2004, [float("nan")] * 64), (2005, [float("inf")] + [0.0] * 63), (2006, []), (None, rows[9][1]), (5, rows[11][1]), (5, rows[5][1]), (2007, [0.0] * 64)]
    return rows


def brute(rows, clusters=8, rounds=10):
    kept = [(i, tuple(math.floor(1024 * float(np.float32(x))) for x in e)) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    c = [list(v) for _, v in sorted(kept, key=key)[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            if mine := [v for (_, v), k in zip(kept, own, strict=True) if k == j]:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [(i, *near(v)[::-1]) for i, v in kept]
    each = {}
    for _, j, d in last:
        each[j] = each.get(j, 0) + d
    return sorted(((i, j, d, each[j], sum(each.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in last), key=repr)


@pytest.mark.parametrize("limits", [{}, {"BLOCK": 50, "LEAF": 4, "CUT": 3, "AT_ONCE": 100}])
def test_against_plain_rounds(spark, monkeypatch, limits):
    for name, v in limits.items():
        monkeypatch.setattr(clustering, name, v)
    rows = fixture()
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).repartition(3).select("*", *[F.lit(1).alias(c) for c in ("v", "cluster", "distance", "ids")])
    assert sorted((tuple(r) for r in clustering.clustered(df).collect()), key=repr) == brute(rows)


def test_sql_agrees():
    rows = [r for r in fixture(150) if r[0] is not None]
    names, got = sql_of(OP12_SQL, embeddings=([(i, e) for i, e in rows], ["vec_id", "embedding"]))
    assert sorted(got, key=repr) == brute(rows)


def test_few_and_no_vectors(spark):
    one = [(3, [0.5] * 64), (4, [0.25] * 64)]
    assert sorted((tuple(r) for r in clustering.clustered(spark.createDataFrame([(*r, 0) for r in one], SCHEMA)).collect()), key=repr) == brute(one)
    assert clustering.clustered(spark.createDataFrame([], SCHEMA)).count() == 0
    assert clustering.clustered(spark.createDataFrame([(1, None, 0), (2, [1.0], 0)], SCHEMA)).count() == 0


def test_too_large_components_are_told(spark):
    df = spark.createDataFrame([(i, [1e30 * (i + 1)] * 64, 0) for i in range(3)], SCHEMA)
    with pytest.raises(Exception, match="too large"):
        clustering.clustered(df).collect()


def test_cover_tree_holds_its_bounds():
    rng = np.random.default_rng(1)
    x = rng.integers(-500, 500, (700, 6))
    x[100:160] = x[3]
    order, tree = clustering.cover_tree(x, leaf=8)
    assert sorted(order.tolist()) == list(range(700))
    y = x[order].astype(float)
    for n in range(len(tree["centre"])):
        low, high = tree["low"][n], tree["high"][n]
        away = np.sqrt(((y[low:high] - y[tree["centre"][n]]) ** 2).sum(1))
        assert away.max() <= tree["radius"][n] + 1e-9
        kids = range(tree["child"][n], tree["child"][n] + tree["children"][n])
        assert not kids or ([tree["low"][k] for k in kids][0], [tree["high"][k] for k in kids][-1]) == (low, high)
        if len(kids):
            apart = y[tree["centre"][list(kids)]]
            gap = np.sqrt(((apart[:, None] - apart[None]) ** 2).sum(2))[~np.eye(len(kids), dtype=bool)]
            reach = 2.0 ** (np.ceil(np.log2(tree["radius"][n])) - 1)
            assert (gap > reach).all() and tree["radius"][list(kids)].max() <= reach


def test_most_distances_are_pruned_on_clustered_vectors():
    rng = np.random.default_rng(4)
    centres = rng.integers(-3000, 3000, (8, 16))
    x = (centres[rng.integers(0, 8, 2000)] + rng.integers(-40, 40, (2000, 16))).astype(np.int64)
    order, tree = clustering.cover_tree(x)
    runs, exact, spent = clustering.walk(x[order], tree, centres)
    covered = sorted([i for low, high, _ in runs for i in range(low, high)] + [i for rows, _ in exact for i in rows.tolist()])
    assert covered == list(range(2000)) and spent < 2000 * 8 * 0.05
    plain = ((x[order][:, None] - centres[None]) ** 2).sum(2).argmin(1)
    assert (clustering.assigned(x[order], tree, centres) == plain).all()


def test_ties_go_to_the_smaller_number():
    x = np.array([[0, 0], [2, 0], [1, 5], [1, 1], [1, 1]] * 20, np.int64)
    c = np.array([[2, 0], [0, 0], [2, 0]], np.int64)
    order, tree = clustering.cover_tree(x, leaf=2)
    assert (clustering.assigned(x[order], tree, c) == ((x[order][:, None] - c[None]) ** 2).sum(2).argmin(1)).all()
