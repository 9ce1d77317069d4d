"""Sentence matching in order, against tables filled cell by cell."""

from __future__ import annotations

import numpy as np
import pytest

from lodestar.operators import align


def cell_by_cell(m: np.ndarray, shared: bool) -> float:
    rows, cols = m.shape
    table = [[0.0] * (cols + 1)] * (rows + 1) if shared else [[0.0] * (cols + 1) for _ in range(rows + 1)]
    for i in range(1, rows + 1):
        for j in range(1, cols + 1):
            table[i][j] = max(table[i - 1][j - 1] + m[i - 1, j - 1], table[i - 1][j] + m[i - 1, j - 1], table[i][j - 1])
    return table[-1][-1]


@pytest.mark.parametrize("shape", [(1, 1), (1, 6), (5, 1), (4, 7), (8, 3)])
def test_soft_lcs(shape):
    m = np.random.default_rng(sum(shape)).random((20, *shape)).round(2)
    for shared in (False, True):
        assert align.soft_lcs(m, shared) == pytest.approx([cell_by_cell(x, shared) for x in m])


def test_smart_l_over_pairs_of_many_sizes(spark):
    rng = np.random.default_rng(1)
    items = {i: rng.random((rng.integers(1, 5), rng.integers(1, 6))).round(2) for i in range(60)}
    rows = [(k, h, p, float(m[p, h])) for k, m in items.items() for p in range(m.shape[0]) for h in range(m.shape[1])]
    scored = spark.createDataFrame(rows, "id int, h int, p int, score double").repartition(3)
    for r in align.smart_l(scored, "id").collect():
        m = items[r.id]
        assert r.soft == pytest.approx(cell_by_cell(m, False) / m.shape[0])
        assert r.soft_shared == pytest.approx(cell_by_cell(m, True) / m.shape[0])
        plain = np.zeros((m.shape[0] + 1, m.shape[1] + 1))
        for i in range(m.shape[0]):
            for j in range(m.shape[1]):
                plain[i + 1, j + 1] = max(plain[i, j] + m[i, j], plain[i, j + 1], plain[i + 1, j])
        assert r.precision == pytest.approx(plain[-1, -1] / m.shape[1])
        assert r.recall == pytest.approx(plain[-1, -1] / m.shape[0])
    assert align.smart_l(scored.where("id < 0"), "id").count() == 0
