"""Whitening: the factorisations against numpy, and the query against its contract written out."""

from __future__ import annotations

import math

import numpy as np
import pytest

from filetide.llm import whitening

from .corpora import folder


def test_factor_and_rotations():
    draw = np.random.default_rng(1)
    for d, rank in ((1, 1), (2, 2), (5, 3), (8, 8), (64, 64), (65, 20)):
        points = draw.normal(size=(300, rank)) @ draw.normal(size=(rank, d))
        scatter = points.T @ points
        factor = whitening.pivoted_cholesky(scatter)
        assert factor.shape == (d, rank) and np.allclose(factor @ factor.T, scatter)
        filled = np.array([np.flatnonzero(row)[-1] for row in factor if row.any()])
        assert sorted(np.sort(filled)[:rank].tolist()) == list(range(rank)) or d > rank  # triangular after the pivots
        turned = whitening.jacobi_columns(factor)
        gram = turned.T @ turned
        norms = np.sqrt(np.diag(gram))
        assert np.abs(gram - np.diag(np.diag(gram))).max() <= 1e-12 * norms.max() ** 2
        assert np.allclose(np.sort(norms**2)[::-1], np.linalg.eigvalsh(scatter)[::-1][:rank], rtol=1e-9)


def plain(rows, components=4):
    """The contract in exact integers and numpy."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(256 * float(np.float32(c))) for c in v] for _, v in good]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, float) - np.array([s / n for s in sums])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    out = []
    for (i, _), v in zip(good, x):
        deviation = sum((n * c - s) ** 2 for c, s in zip(v, sums))
        z = (np.array(v, float) - np.array([s / n for s in sums])) @ axes[:, order] / np.sqrt(values[order])
        out += [(i, k + 1, n, deviation, z[k], values[order[k]] / values.sum()) for k in range(len(order))]
    return out


def test_query_equals_contract(spark, tmp_path):
    draw = np.random.default_rng(7)
    spread = np.array([0.5, 0.35, 0.2, 0.12, 0.08, 0.03])
    rows = [(i, [float(c) for c in draw.normal(size=6) * spread]) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(200)] + [(5, rows[4][1]), (None, rows[6][1])]
    rows += [(2000, None), (2001, [None] + [0.1] * 5), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5), (2004, [-0.0] * 6), (2005, [])]
    got = whitening.query(spark, folder(spark, tmp_path / "in", [], vectors=[(i, v, 0) for i, v in rows]))
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    key = lambda r: (r[0] is not None, r[0] or 0, r[3], r[1])
    ours, want = sorted(map(tuple, got.collect()), key=key), sorted(plain([r for r in rows if r[0] != 2005]), key=key)
    assert [r[:4] for r in ours] == [r[:4] for r in want]
    z, y = (np.array([r[4] for r in t]).reshape(-1, 4) for t in (ours, want))
    assert np.abs(z * np.sign((z * y).sum(axis=0)) - y).max() < 1e-9
    assert np.allclose([r[5] for r in ours], [r[5] for r in want], rtol=1e-9)
    assert len({r[6] for r in ours}) == 1 and ours[0][6] < 1e-10


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, n int, component string")


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [0.5, 0.25])], [(i, [0.5, 0.25]) for i in range(50)]])
def test_nothing_to_whiten(spark, rows):
    assert whitening.whiten(frame(spark, rows)).collect() == []


def test_fewer_directions_than_components(spark):
    rows = [(i, [i / 256, 2 * i / 256, 0.0]) for i in range(9)] + [(20, [1.0, 2.0])]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert sorted((r["vec_id"], r["component"]) for r in got) == [(i, 1) for i in range(9)]
    assert all(abs(r["explained"] - 1) < 1e-12 for r in got)
    assert [round(r["whitened"] * math.sqrt(60 / 9)) for r in sorted(got)] == list(range(-4, 5))


def test_wide_and_huge_entries(spark):
    """Exact sums and deviations at 2^33 an entry, and null where a long ends."""
    values = [(i, [float(2**33 + i * 4096), float(i % 7)]) for i in range(40)]
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(frame(spark, values)).collect()}
    x = [[int(np.float32(c)) * 256 for c in v] for _, v in values]
    sums = [sum(c) for c in zip(*x)]
    for i, v in enumerate(x):
        exact = sum((len(x) * c - s) ** 2 for c, s in zip(v, sums))
        assert got[i, 1]["deviation"] == (exact if exact < 2**63 else None)
    far = whitening.whiten(frame(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])])).collect()
    assert {r["vec_id"] for r in far} == {1, 2, 3} and any(r["deviation"] is None for r in far)
