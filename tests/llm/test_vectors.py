import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from webquarry.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, k=5):
    vecs = {i: [math.floor(256 * float(np.float32(x))) for x in e] for i, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)}
    out = set()
    for q, a in vecs.items():
        if q % 50 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in vecs.items() if i != q)[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(found)}
    return out


@pytest.mark.parametrize("limits", [{}, {"SLICE_BYTES": 8 * 12 * 50, "GROUP": 3}, {"SLICE_BYTES": 8 * 12 * 50, "GROUP": 9, "STEP": 2}])
def test_topk(spark, monkeypatch, limits):
    for name, v in limits.items():
        monkeypatch.setattr(topk, name, v)
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) * (1 + 9 * (i % 17 == 0)) for _ in range(12)]) for i in range(600)]
    rows += [(1000 + i, rows[50][1]) for i in range(8)]  # ties
    rows += [(700, None), (750, [None] * 12), (800, [float("nan")] * 12), (850, [float("inf")] + [0.0] * 11), (900, []), (950, [0.0] * 12)]
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA).select("*", F.lit(1).alias("v"), F.lit(2).alias("slice"))
    assert {tuple(r) for r in topk.exact_topk(df, F.col("vec_id") % 50 == 0).collect()} == brute(rows)


def test_no_vectors(spark):
    assert topk.exact_topk(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 0), (1, [1.0, 0.0], 0)], SCHEMA)
    assert [tuple(r) for r in topk.exact_topk(df, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 256 * 256)]


def test_repeated_queries(spark):
    df = spark.createDataFrame([(0, [1.0], 0), (0, [1.0], 0), (1, [2.0], 0), (1, [2.0], 0)], SCHEMA)
    assert [tuple(r) for r in topk.exact_topk(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()] == [(0, 1, 1, 131072), (0, 2, 1, 131072)]


def test_reach_of_queries():
    tops = np.array([100.0, 50.0, 20.0, 1.0])
    # 10 * 50 reaches 500 and 10 * 20 doesn't; no floor sees all; a zero query with a floor of 0 too
    assert topk.reaches(np.array([10.0, 10.0, 0.0, 0.0, 10.0]), np.array([500.0, -np.inf, 0.0, 5.0, 2000.0]), tops).tolist() == [2, 4, 4, 0, 0]


def test_most_slices_are_skipped(spark, monkeypatch):
    """Vectors of falling length in one direction: the longest few answer all queries."""
    monkeypatch.setattr(topk, "SLICE_BYTES", 8 * 4 * 20)
    seen = []
    plain = topk.reaches
    monkeypatch.setattr(topk, "cut", lambda df, name, cut=topk.cut: (seen.append((name, out := cut(df, name))), out)[1])
    rows = [(i, [300.0 / (i + 1), 1.0 / (i + 1), 0.0, 0.0]) for i in range(400)]
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA)
    assert {tuple(r) for r in topk.exact_topk(df, F.col("vec_id") % 50 == 0).collect()} == brute(rows)
    tables = dict(seen)
    slices = tables["slices"].select("slice").distinct().count()
    assert plain is topk.reaches and slices > 5 and tables["reaches"].count() <= 2


def test_bounds_hold_with_floors():
    rng = np.random.default_rng(3)
    x, q = rng.integers(-200, 200, (300, 10)), rng.integers(-200, 200, (20, 10))
    rotation = np.linalg.svd((x.T @ x).astype(float))[0]
    scores = q @ x.T
    floor = np.sort(scores, 1)[:, -5].astype(float)
    row, name, score = topk.best(x, np.arange(300), q, np.full(20, -1), rotation, 5, floor=floor)
    assert all(sorted(score[row == i].tolist()) == sorted(np.sort(scores[i])[-5:].tolist()) for i in range(20))


def test_an_id_of_several_vectors_asks_with_its_greatest(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (0, [0.0, 9.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.0], 0)], SCHEMA)
    got = [tuple(r) for r in topk.exact_topk(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 65536), (0, 2, 1, 0)]
