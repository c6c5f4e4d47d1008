"""Hard negatives against sorted lists of Python's integers."""

import math

import numpy as np
import pytest

from quillon.llm import negatives

COLUMNS = "vec_id long, label int, embedding array<double>, slot string, block string, v string"


def plain(rows, anchors, positives, negatives_, low, high):
    """MINED rows from (vec_id, label, vector), by sorting every list whole."""

    def usable(r):
        return r[0] is not None and r[1] is not None and r[2] and all(x is not None and math.isfinite(x) for x in r[2])

    def whole(v):
        return [math.floor(256 * x) for x in v]

    rows = [(i, y, whole(v)) for i, y, v in filter(usable, rows)]
    out = []
    for i, y, v in {(i, y, tuple(whole(v))) for i, y, v in filter(usable, anchors)}:
        scored = [(-sum(p * q for p, q in zip(v, w)), j, z) for j, z, w in rows if j != i and len(w) == len(v)]
        for s, j, _ in sorted(x for x in scored if x[2] == y)[:positives]:
            fits = sorted(x for x in scored if x[2] != y and low * -s <= 100 * -x[0] <= high * -s)[:negatives_]
            out += [(i, j, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, every=3, **options):
    df = spark.createDataFrame([(*r, "s", "b", "v") for r in rows], COLUMNS)
    typed = negatives.typed(df)
    return sorted(map(tuple, negatives.mine(typed, typed.where(f"vec_id % {every} = 0"), **options).collect()))


@pytest.mark.parametrize("blocks", [1, 5])
def test_against_sorted_lists(spark, monkeypatch, blocks):
    rng = np.random.default_rng(blocks)
    monkeypatch.setattr(negatives, "TILE_ROWS", 37)
    monkeypatch.setattr(negatives, "_ANCHORS", 16)
    rows = [(int(i), int(rng.integers(0, 4)), (rng.integers(-3, 4, 8) / 8 + (rng.random(8) / 50 if i % 2 else 0)).tolist()) for i in rng.permutation(300)]
    rows += [(400 + i, i % 4, rows[0][2]) for i in range(40)]  # ties
    rows += [(500, 1, rows[1][2])] * 3 + [(501, 1, rows[1][2])] * 2  # repeated rows, also of an anchor (501)
    rows += [(600, None, [1.0] * 8), (603, 1, None), (606, 1, []), (609, 2, [None] * 8), (612, 2, [float("nan")] * 8), (615, 2, [float("inf")] * 8), (None, 1, [1.0] * 8)]
    rows += [(700 + i, i % 2, [0.5, i / 10, -0.25]) for i in range(30)]  # another length
    if blocks > 1:
        monkeypatch.setattr(negatives, "BLOCK_BYTES", 113 * 8 * 8 // blocks)
    for low, high in ((50, 95), (0, 100)):
        want = plain(rows, [r for r in rows if r[0] is not None and r[0] % 3 == 0], 5, 3, low, high)
        got = mined(spark, rows, low=low, high=high)
        assert got == want and len(got) > 300


def test_exact_beyond_doubles(spark):
    """Components whose products no double holds."""
    rng = np.random.default_rng(4)
    rows = [(i, i % 2, [float(x) for x in rng.integers(-(2**18), 2**18, 4)]) for i in range(60)]
    assert mined(spark, rows, low=0, high=100) == plain(rows, rows[::3], 5, 3, 0, 100)
    a, b = (np.array([[2.0**31, 3.0], [1.0, 2.0]]), np.array([[2.0**31, 1.0], [5.0, 7.0]]))
    assert negatives.products(a, b).tolist() == [[2**62 // 2**62 * negatives._MOST, 5 * 2**31 + 21], [2**31 + 2, 19]]


def test_few_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(3, 1, [1.0, 0.0])]) == []
    rows = [(3, 1, [1.0, 0.0]), (4, 1, [1.0, 0.0]), (5, 2, [0.75, 0.0]), (6, 1, [-1.0, 0.0]), (7, 2, [0.0, 0.0])]
    assert mined(spark, rows) == plain(rows, rows[::3], 5, 3, 50, 95) == [(3, 4, 1, 5, 65536, 49152)]
