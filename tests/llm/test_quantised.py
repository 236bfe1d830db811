from __future__ import annotations

import numpy as np
import pytest

from kartoteka.llm import quantised, sql
from kartoteka.llm.queries import op11_quantised
from oracle import TESTDATA, compare, connect

SCHEMA = "vec_id long, label int, embedding array<double>, rep string, n int"


def brute(rows, least=0.93):
    """(vec_id, n_links, component_id, kept), by all pairs."""
    rows = {(i, lab, None if x is None else tuple(x)) for i, lab, x in rows}
    links = {i: 0 for i, _, _ in rows}
    parent = {i: i for i in links}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    groups = {}
    for i, lab, x in rows:
        if i is not None and lab is not None and x and all(c is not None and np.isfinite(c) for c in x) and any(x):
            unit = np.array(x) / np.abs(x).max()
            groups.setdefault((lab, len(x)), []).append((i, unit / np.linalg.norm(unit)))
    for members in groups.values():
        ids, unit = [i for i, _ in members], np.array([x for _, x in members])
        linked = unit @ unit.T >= least
        np.fill_diagonal(linked, False)
        for i, n in zip(ids, linked.sum(axis=1).tolist()):
            links[i] += n
        for a, b in zip(*np.nonzero(linked)):
            low, high = sorted((find(ids[a]), find(ids[b])))
            parent[high] = low
    return sorted([(i, n, find(i), find(i) == i) for i, n in links.items()], key=repr)


def result(df, **kw):
    return sorted(map(tuple, quantised.near_vectors(df, **kw).collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA)


def test_against_sql(spark):
    folder = TESTDATA / "sf0.001"
    assert compare(op11_quantised(spark, str(folder)), connect(folder), sql.NEAR_VECTORS) == ([], [])


def planted(rng, n, size):
    """Isotropic vectors, partners near the threshold, a third of all in one clump, exact copies and chains."""
    base = rng.normal(size=(n, size))
    near = base[:n // 3] + rng.normal(size=(n // 3, size)) * rng.uniform(0.1, 0.5, size=(n // 3, 1))
    clump = rng.normal(size=size) + rng.normal(size=(n // 2, size)) * 0.15
    data = np.concatenate([base, near, clump, base[:n // 10]])
    labels = np.concatenate([np.arange(n) % 3, np.arange(n // 3) % 3, np.ones(n // 2, int), np.arange(n // 10) % 3])
    return [(i, int(lab), x.tolist()) for i, (lab, x) in enumerate(zip(labels, data))]


@pytest.mark.parametrize("size", [64, 24, 5])
def test_recall_against_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(quantised, "LIST_ROWS", 24)  # more lists than so few vectors would get
    monkeypatch.setattr(quantised, "RESIDENTS", 64)
    monkeypatch.setattr(quantised, "VISITORS", 128)
    rows = planted(np.random.default_rng(size), 1500, size)
    got, expected = result(frame(spark, rows)), brute(rows)
    found, there = sum(r[1] for r in got), sum(r[1] for r in expected)
    assert there > 1000 and found <= there and found >= 0.995 * there
    assert all(g[1] <= e[1] for g, e in zip(got, expected, strict=True))
    assert sum(g[2:] == e[2:] for g, e in zip(got, expected)) >= 0.99 * len(got)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.0]), (0, 1, [1.0, 0.0]), (1, 1, None), (2, 1, [0.0, 0.0]), (3, 1, [nan, 1.0]), (4, 1, [1.0, None]), (5, None, [1.0, 0.0]),
            (6, 1, [1.0, 0.0]), (7, 1, [1.0, -0.0]), (8, 1, [-1.0, 0.0]), (9, 2, [1.0, 0.0]), (10, 1, [1.0]), (11, 1, [2.0]), (12, 1, [-2.0]), (13, 1, []),
            (14, 1, [1e200, 1e199]), (15, 1, [1e-300, 0.0]), (16, 1, [inf, 0.0]), (17, 1, [1.0, 0.39]), (18, 1, [1.0, 0.40])]
    assert result(frame(spark, rows)) == brute(rows)
    assert result(frame(spark, [])) == []
    assert result(frame(spark, [(None, 1, [1.0]), (None, None, None), (3, 1, [1.0])])) == [(3, 0, 3, True), (None, 0, None, True)]
    assert result(frame(spark, [(1, 1, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 1, [0.0, 2.0])])) == [(1, 1, 1, True)] * 2 + [(2, 1, 1, False)]


def test_codes_are_never_off_by_more_than_their_error():
    rng = np.random.default_rng(0)
    unit = quantised._unit(rng.normal(size=(600, 37)))
    index = quantised.fit_index(unit[:300], 3000)
    lists = index.own(unit)
    codes, errors = index.encode(unit, lists)
    cosine = unit @ index.centres(lists).T
    for m, table in enumerate(index.tables(unit)):
        cosine = cosine + table[:, codes[:, m]]
    assert (np.abs(cosine - unit @ unit.T) <= errors + quantised._SLACK).all()
    visited = index.visited(unit)
    assert (visited[:, 0] == lists).all() and visited.shape[1] == index.probes and all(len(set(v)) == len(v) for v in visited.tolist())
    assert all(index.ranks(unit[:5], visited[:5, k]).max() <= k for k in range(index.probes))
