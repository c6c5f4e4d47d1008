"""Pairs of features that one row has settled leave the others'."""

import numpy as np

from quillon.operators import granular


def test_covering_leaves_beaten_pairs():
    rng = np.random.default_rng(6)
    p, balls = 12, 3_000
    centre, smooth = rng.random((p, balls)), np.ones(p, bool)
    rows = rng.random((6, p))

    def plain(v):
        m = granular.kernel(v, centre, smooth, 0.1)
        return (np.maximum(1 - m[:, None], m).min(2) / np.minimum(m[:, None], m).max(2)).ravel()

    every = granular._covering(rows[0], centre, smooth, 0.1, np.zeros(p * p), None)
    assert np.array_equal(every.at, np.flatnonzero(plain(rows[0]) > 0)) and np.array_equal(every.ratio(), plain(rows[0])[every.at])
    for v in rows[1:]:
        most = plain(rows[0])
        left = granular._covering(v, centre, smooth, 0.1, most, None)
        want = np.flatnonzero(plain(v) > most)
        assert np.array_equal(left.at, want) and np.array_equal(left.ratio(), plain(v)[want])
    first = granular._first_balls(rows[1], centre[:, :16], smooth, 0.1, np.full(p * p, 5.0))
    assert len(first.at) < p * p / 2  # a few balls settle most pairs
