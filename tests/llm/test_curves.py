from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kartoteka.llm import curves
from kartoteka.llm.queries import op8_curves
from kartoteka.registry.base import table


def brute(rows, is_query, k):
    """{query id: [(vec_id, score)]} of all rows that take part."""
    rows = sorted({(i, tuple(x)) for i, x in rows if i is not None and x and all(c is not None and math.isfinite(c) for c in x) and any(x)})
    out = {}
    for i, x in rows:
        if is_query(i):
            scored = [(-float(np.dot(np.array(x, float), np.array(y, float))), j) for j, y in rows if j != i]
            out[i] = [(j, -s) for s, j in sorted(scored)[:k]]
    return out


def results(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("dimensions, bits", [(2, 4), (3, 3), (1, 5)])
def test_a_curve_visits_every_cell_by_single_steps(dimensions, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dimensions)))
    keys = curves.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_recall_on_the_given_vectors(spark, scale):
    folder = f"/root/testdata/{scale}"
    rows = [(r.vec_id, r.embedding) for r in table(spark, folder, "embeddings").collect()]
    expected = brute(rows, lambda i: i % 20 == 0, 20)
    got = results(op8_curves(spark, folder))
    assert got.keys() == expected.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in expected)
    assert hits >= 0.9 * sum(map(len, expected.values()))
    truth = {(q, i): s for q in expected for i, s in expected[q]}
    assert all(math.isclose(s, truth[q, i], rel_tol=1e-12) for q in got for i, s in got[q] if (q, i) in truth)


def test_recall_in_clusters(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16)) * 3
    data = np.concatenate([centres[rng.integers(0, 20, 2500)] + rng.normal(size=(2500, 16)) * 0.2,
                           centres[0] + rng.normal(size=(1500, 16)) * 1e-4])  # a third of all in one spot
    rows = [(i, x.tolist()) for i, x in enumerate(data)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    expected, got = brute(rows, lambda i: i % 20 == 0, 20), results(curves.nearest(df, F.col("vec_id") % 20 == 0))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in expected)
    assert hits >= 0.9 * sum(map(len, expected.values()))


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, nan]), (4, [inf, 1.0]), (5, [1.0, None]), (None, [1.0, 1.0]), (6, []),
            *[(i, [1.0, 0.0]) for i in range(10, 60)], (70, [0.5, 0.5]), (70, [0.5, 0.5]), (71, [-1.0, -0.0]), (72, [-1.0, 0.0]), (80, [3.0])]
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "vec_id long, embedding array<double>, score int")
    expected = brute([(i, x) for i, x in rows if not (x and len(x) == 1)], lambda i: i % 20 == 0, 20)
    assert results(curves.nearest(df, F.col("vec_id") % 20 == 0)) == expected
    few = df.where("vec_id in (0, 70, 71)")
    assert [i for i, _ in results(curves.nearest(few, F.col("vec_id") == 0))[0]] == [70, 71]
    assert curves.nearest(df.limit(0), F.lit(True)).count() == 0
    assert curves.nearest(df, F.lit(False)).count() == 0


def test_every_length_is_searched(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8 if i % 5 else 4).tolist()) for i in range(200)] + [(200, [1.0])]
    got = results(curves.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0))
    expected = {}
    for size in (4, 8):
        expected.update(brute([(i, x) for i, x in rows if len(x) == size], lambda i: i % 20 == 0, 20))
    assert {q: [i for i, _ in near] for q, near in got.items()} == {q: [i for i, _ in near] for q, near in expected.items()}
