"""Queries over odd tables: whole results, equal to their SQL."""

import math
import random

import pytest
from compare import compare

from textstrata.catalogue import oracle_sql, queries
from textstrata.operators import search


def _same(spark, folder, name):
    said = compare(spark, str(folder), name, queries()[name], oracle_sql()[name])
    assert said.startswith("ok"), said


def _documents(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")


ODD = ["", " ", "<html><body>a</body></html>", "<!-- a --><!DOCTYPE html>", "a\0b", "%PDF-1.7 /JavaScript", "PK\3\4", "﻿a", "a"]


@pytest.mark.parametrize("known", [[(5, "a"), (10, "b")], [(5, None), (10, "a")], []])
def test_all_new_texts_are_registered(spark, tmp_path, known):
    """Of whatever kind: the SQL rejects none. A row without an id has a text too; nulls are SQL's."""
    _documents(spark, tmp_path, [*[(10 * i + 1, t) for i, t in enumerate(ODD)], (3, "a"), (7, None), (None, "c"), *known])
    _same(spark, tmp_path, "import_registration")


def _vectors(spark, folder, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")


def test_every_vector_is_asked(spark, sf):
    assert queries()["retrieval_metrics"](spark, sf).first().n_scored == spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert "% 100" not in oracle_sql()["retrieval_metrics"] and "% 100" in oracle_sql()["knn_exact"]


@pytest.mark.parametrize("n", [3, 18, 150])
def test_metrics_of_odd_vectors(spark, tmp_path, monkeypatch, n):
    """Copies, labels that are null or stand alone, and vectors that are null, zero or no numbers; blocks are many, tables small."""
    monkeypatch.setattr(search, "EACH_BLOCK", 16)
    monkeypatch.setattr(search, "EACH_SHARE", 40)
    draw = random.Random(n)
    rows = [(i, [float(draw.randint(-3, 3)) + 0.5 for _ in range(4)], draw.randint(0, 2)) for i in range(n)]
    rows += [(1000 + i, rows[0][1], i % 2) for i in range(n // 3)]
    odd = [(-5, None, 1), (400, None, 1), (405, [0.0] * 4, 2), (401, [0.0] * 4, 0), (410, [math.nan, 1.0, 1.0, 1.0], 1), (None, [1.0, 2.0, 0.0, 0.0], 1), (500, [1.0, 1.0, 2.0, 1.0], None), (505, [3.0, 1.0, 2.0, 1.0], 9)]
    _vectors(spark, tmp_path, rows + odd)
    _same(spark, tmp_path, "retrieval_metrics")


def test_each_ones_nearest_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "EACH_BLOCK", 16)
    monkeypatch.setattr(search, "EACH_SHARE", 32)
    draw = random.Random(5)
    good = {i: [draw.gauss(0, 1) for _ in range(5)] for i in range(90)}
    good |= {200 + i: good[7] for i in range(30)} | {300 + i: [x + 1e-12 * i for x in good[8]] for i in range(9, 0, -1)}
    vectors = spark.createDataFrame(list(good.items()), "vec_id long, embedding array<double>").repartition(3)

    def away(a, b):
        dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
        return round(1 - dot(a, b) / math.sqrt(dot(a, a) * dot(b, b)), 9)

    want = {(q, v, n + 1) for q in good for n, (_, v) in enumerate(sorted((away(good[q], x), v) for v, x in good.items() if v != q)[:6])}
    assert {(r.query_id, r.vec_id, r["rank"]) for r in search.nearest_each(vectors, 6).collect()} == want
    assert search.nearest_each(vectors.limit(0), 6).count() == 0
