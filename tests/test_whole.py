"""The queries over embeddings that take the whole table, against brute force on a small one."""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quillon.operators import support
from quillon.plans import catalog

ROWS, WIDTH = 40, 12


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    """The signal is in the components behind the eighth."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(ROWS, WIDTH))
    x[:, 9] = np.repeat([-3, 3], ROWS // 2) + rng.normal(0, 0.2, ROWS)
    x[:, 11] = x[:, 9] + rng.normal(0, 0.2, ROWS)
    folder = tmp_path_factory.mktemp("whole")
    pq.write_table(pa.table({"vec_id": pa.array(range(ROWS), pa.int64()), "embedding": pa.array(x.astype(np.float32).tolist(), pa.list_(pa.float32()))}), folder / "embeddings.parquet")
    return str(folder), x.astype(np.float32).astype(float)


def scaled(x):
    middle = np.median(x, axis=0)
    return np.clip((x - middle) / (1.4826 * np.median(np.abs(x - middle), axis=0)), -4.5, 4.5)


def statistics(profiles, rest, i, j):
    mass = np.array([np.bincount(i, g, ROWS) + np.bincount(j, g, ROWS) for g in profiles.T])
    mass /= mass.sum(1, keepdims=True)
    logs = np.log(mass, where=mass > 0, out=np.zeros_like(mass))
    return np.sqrt(profiles / profiles.sum(0) * rest).sum(0), np.exp(-(mass * logs).sum(1)) / ROWS


def brute_report(x, draws=200):
    z, (i, j) = scaled(x), np.triu_indices(ROWS, 1)
    g = (z[i] - z[j]) ** 2
    p = g / g.sum(0)
    rest = (p.sum(1, keepdims=True) - p) / (WIDTH - 1)
    rest /= rest.sum(0)
    null = []
    for b in range(draws):
        order = sorted(range(ROWS), key=lambda k, b=b: (hashlib.md5(f"perm:0:{b}:{k}".encode()).hexdigest(), k))
        null.append(statistics((z[order][i] - z[order][j]) ** 2, rest, i, j))
    return support.calibrate(*statistics(g, rest, i, j), np.array([a for a, _ in null]).T, np.array([c for _, c in null]).T, 2.0)


def nearest(x, k=5):
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    return {(a, b) for a in range(len(x)) for b in [b for b in np.argsort(d[a], kind="stable") if b != a][:k]}


def test_report_has_all_features(spark, small):
    folder, x = small
    found = {r.feature: r for r in catalog.QUERIES["feature_report_whole"](spark, folder).collect()}
    want = brute_report(x)
    most = want.null_effective.max(0)
    assert set(found) == {f"f{k}" for k in range(WIDTH)}
    for k in range(WIDTH):
        r = found[f"f{k}"]
        assert (r.support_z, r.sample_coverage, r.effective_support) == pytest.approx((want.robust_z[k], want.coverage[k], want.effective[k]), abs=1e-4)
        assert r.max_null_adjusted_p == pytest.approx((1 + (most >= want.effective[k]).sum()) / 201, abs=1e-6)
    assert {r.feature for r in found.values() if r.selected} & {"f9", "f11"}


def test_neighbours_are_those_of_whole_vectors(spark, small):
    """Of standardised columns."""
    folder, x = small
    z = (x - x.mean(0)) / x.std(0)
    assert {(r.a, r.b) for r in catalog.QUERIES["knn_edges"](spark, folder).collect()} == nearest(z)
    every, half = nearest(z, 10), nearest(z[:, : WIDTH // 2], 10)
    assert catalog.QUERIES["knn_preservation"](spark, folder).first().preservation == pytest.approx(len(every & half) / len(every), abs=1e-6)


def test_scaled_columns_and_gram_are_whole(spark, small):
    folder, x = small
    rows = catalog.QUERIES["scale_robust"](spark, folder).orderBy("vec_id").collect()
    assert np.array([tuple(r)[1:] for r in rows]) == pytest.approx(scaled(x), abs=1e-6)
    z, (i, j) = scaled(x), np.triu_indices(ROWS, 1)
    g = (z[i] - z[j]) ** 2
    g /= np.sqrt((g * g).sum(0))
    found = {(r.a, r.b): r.c for r in catalog.QUERIES["unit_gram"](spark, folder).collect()}
    assert found == pytest.approx({(a, b): g[:, a] @ g[:, b] for a in range(WIDTH) for b in range(WIDTH)}, abs=1e-6)
