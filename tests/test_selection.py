"""Exact percentiles and exact nearest neighbours by pruning, against plain searches."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textstrata.operators import evaluation, pivots, search
from textstrata.sources.commits import staged


def nearest_rank(values, p):
    order = sorted(values, key=lambda v: (math.isnan(v), v))
    return order[max(1, math.ceil(len(order) * p)) - 1]


def sample(kind, n, r):
    return {
        "plain": [r.gauss(0, 1) for _ in range(n)], "same": [7.5] * n, "few": [float(r.randrange(3)) for _ in range(n)], "steep": [10 ** r.uniform(-200, 200) for _ in range(n)],
        "odd": [r.choice([float("nan"), float("inf"), float("-inf"), 1.0, -0.5]) for _ in range(n)],
    }[kind]


def test_percentiles_are_nearest_rank(spark):
    r = random.Random(1)
    rows = [(k, v) for k, n in (("plain", 5000), ("same", 900), ("few", 700), ("steep", 3000), ("odd", 333)) for v in sample(k, n, r)]
    rows += [(None, float(i)) for i in range(20)] + [("nulls", None)] * 3 + [("one", 4.0), ("plain", None)]
    got = {x.g: x for x in evaluation.percentiles(spark.createDataFrame(rows, "g string, v double").repartition(5), "v", ["g"]).collect()}
    for g in {k for k, _ in rows}:
        own = [v for k, v in rows if k == g and v is not None]
        x = got[g]
        assert x.n == len(own)
        for p, said in ((0.5, x.p50), (0.95, x.p95)):
            want = nearest_rank(own, p) if own else None
            assert said == want or (math.isnan(said) and math.isnan(want)), (g, p, said, want)
    assert evaluation.percentiles(spark.createDataFrame([], "v int"), "v").collect()[0].asDict() == {"n": 0, "mean": None, "p50": None, "p95": None, "max": None}


def test_a_rank_outside_its_range_is_found_among_all(spark, monkeypatch):
    r = random.Random(2)
    values = [r.randrange(100_000) for _ in range(4000)]
    monkeypatch.setattr(evaluation, "MARGIN", -0.2)
    df = spark.createDataFrame([(v,) for v in values], "v long")
    x = evaluation.percentiles(df, "v").first()
    assert (x.p50, x.p95) == (nearest_rank(values, 0.5), nearest_rank(values, 0.95))


def stage(df):
    return staged(df, "test")


def plain_nearest(rows, asked, k, farthest=None):
    fit = {i: np.array(v, float) / np.abs(v).max() for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in fit.items()}
    out = []
    for q, v in asked:
        if not v or not any(v):
            continue
        u = np.array(v, float) / np.linalg.norm(v)
        near = sorted((round(1 - float(u @ w), 9) + 0.0, i) for i, w in unit.items())
        out += [(q, i, d, n + 1) for n, (d, i) in enumerate([x for x in near if farthest is None or x[0] <= farthest][:k])]
    return out


@pytest.mark.parametrize("farthest", [None, 0.05])
def test_pruned_neighbours_are_the_nearest(spark, farthest):
    r = np.random.default_rng(4)
    centres = r.standard_normal((20, 8)) * 5
    rows = [(i, (centres[i % 20] + r.standard_normal(8) * 0.2).tolist()) for i in range(1500)]
    rows += [(5000 + i, rows[3][1]) for i in range(15)] + [(9000, None), (9001, [0.0] * 8), (9002, [float("nan")] * 8), (9003, [1.0] * 7 + [None]), (9004, [1e-300] * 8), (9005, [-1e300] * 8)]
    asked = [(i, v) for i, v in rows[:1500:100]] + [(-1, rows[3][1]), (-2, [0.0] * 8)]
    vectors = spark.createDataFrame([(*x, 1.0) for x in rows], "vec_id long, embedding array<double>, away double")
    index = pivots.pivot_index(vectors, stage)
    found, compared = pivots.nearest_by_pivots(index, spark.createDataFrame(asked, "query_id long, query array<double>"), 7, stage, farthest=farthest)
    got = sorted((x.query_id, x.vec_id, x.distance, x["rank"]) for x in found.collect())
    want = sorted(plain_nearest(rows, asked, 7, farthest))
    assert [(q, n) for q, _, _, n in got] == [(q, n) for q, _, _, n in want]
    assert all(abs(a[2] - b[2]) < 1e-8 for a, b in zip(got, want))
    assert {(q, i) for q, i, d, _ in got if d > 1e-8} == {(q, i) for q, i, d, _ in want if d > 1e-8}
    share = compared.agg(F.sum("compared")).first()[0] / (16 * index.size)
    assert share < 0.35, share


def test_pruned_neighbours_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    one = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query array<double>")
    assert pivots.nearest_by_pivots(pivots.pivot_index(empty, stage), asked, 3, stage)[0].count() == 0
    assert pivots.nearest_by_pivots(pivots.pivot_index(one, stage), asked.limit(0), 3, stage)[0].count() == 0
    assert [tuple(x) for x in pivots.nearest_by_pivots(pivots.pivot_index(one, stage), asked, 3, stage)[0].collect()] == [(1, 1, 0.0, 1)]


@pytest.mark.parametrize("k", [None, 1, 7, 500])
def test_nearest_by_blocks_are_the_nearest(spark, monkeypatch, k):
    """Against brute force over many blocks, with copies, and vectors that have no angle: null, zero, with null or no number, shorter."""
    monkeypatch.setattr(search, "VECTOR_BLOCK", 9)
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    monkeypatch.setattr(search, "ASKED_AT_ONCE", 4)
    draw = random.Random(3)
    good = {i: [draw.gauss(0, 1) for _ in range(4)] for i in range(60)}
    good |= {100 + i: v for i, v in good.items() if i < 20} | {200: [2.0 * x for x in good[0]]}
    odd = [(300, None), (301, [0.0] * 4), (302, [1.0, None, 2.0, 3.0]), (303, [1.0, math.nan, 2.0, 3.0]), (304, [1.0, 2.0]), (None, [1.0] * 4)]
    vectors = spark.createDataFrame([*good.items(), *odd], "vec_id long, embedding array<double>")
    queries = vectors.filter("vec_id % 10 = 0 OR vec_id > 299").selectExpr("cast(vec_id AS string) AS query_id", "embedding AS query").filter("query_id <> '304'")
    found = search.within_many(vectors, queries, 0.4) if k is None else search.nearest_many(vectors, queries, k)

    def away(a, b):
        dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
        return 1 - dot(a, b) / math.sqrt(dot(a, a) * dot(b, b))

    want = set()
    for q in (i for i in good if i % 10 == 0):
        near = sorted((away(good[q], v), i) for i, v in good.items())
        want |= {(str(q), i) for d, i in near if d <= 0.4} if k is None else {(str(q), i) for _, i in near[:k]}
    got = [(r.query_id, r.vec_id) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
