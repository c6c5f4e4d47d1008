"""Neighbours in cells against neighbours in all pairs of blocks."""

import numpy as np
import pytest

from quillon.operators import neighbours

NAMES = [f"x{i}" for i in range(6)]


def frame(spark, x):
    return spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "id long, " + ", ".join(f"{c} double" for c in NAMES))


def edges(df):
    return sorted((r.a, r.b, round(r.d2, 9)) for r in df.collect())


@pytest.mark.parametrize("kind", ["clusters", "copies", "few"])
def test_same_edges(spark, kind):
    rng = np.random.default_rng(4)
    x = {
        "clusters": rng.standard_normal((600, 6)) * 0.1 + np.repeat(rng.standard_normal((12, 6)) * 10, 50, 0),
        "copies": np.concatenate([np.ones((150, 6)), rng.integers(0, 2, (100, 6))]),  # ties; a cell that holds most rows
        "few": rng.standard_normal((4, 6)),
    }[kind]
    df = frame(spark, x)
    found, asked = neighbours.nearest_in_cells(df, "id", NAMES, 5, 20)
    assert edges(found) == edges(neighbours.nearest(df, "id", NAMES, 5))
    if kind == "clusters":
        pairs = sum(r.n for r in asked.collect())
        assert pairs < 0.5 * len(x) * (len(x) // 20 - 1)  # more than half of the comparisons are left out


def test_empty(spark):
    found, asked = neighbours.nearest_in_cells(frame(spark, np.zeros((0, 6))), "id", NAMES, 3)
    assert found.count() == 0 and asked.count() == 0
