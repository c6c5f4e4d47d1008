"""All pairs of rows in blocks: what is sent and written grows with the rows, not with their pairs."""

import numpy as np
import pytest

from quillon.operators import blocks, metrics, neighbours, rankers

WIDTH = 8
NAMES = [f"x{i}" for i in range(WIDTH)]


def frame(spark, x):
    names = NAMES[: x.shape[1]]
    return spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "id long, " + ", ".join(f"{c} double" for c in names))


def shuffled(spark, run):
    """What ``run`` gives, and the bytes that its shuffles wrote."""
    context = spark.sparkContext._jsc.sc()

    def so_far():
        context.listenerBus().waitUntilEmpty(30_000)
        return context.statusStore().executorSummary("driver").totalShuffleWrite()

    before = so_far()
    return run(), so_far() - before


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 20)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 20)


def brute(x, k):
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    return {(i, int(j)) for i, row in enumerate(d) for j in np.lexsort((np.arange(len(x)), row))[:k]}


def test_nearest_sends_rows_once_or_twice(spark, small):
    x = np.random.default_rng(1).standard_normal((1_200, WIDTH))
    df = frame(spark, x).persist()
    df.count()
    found, sent = shuffled(spark, lambda: {(r.a, r.b) for r in neighbours.nearest(df, "id", NAMES, 3).collect()})
    assert found == brute(x, 3)
    assert sent < 6 * x.nbytes  # 60 blocks: 120 times when every pair of blocks was sent


@pytest.mark.parametrize("kind", ["far", "large", "tiny", "equal", "mixed"])
def test_nearest_of_odd_numbers(spark, small, kind):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((90, WIDTH))
    x = {"far": x + 1e6, "large": x * 1e20, "tiny": x * 1e-25, "equal": np.ones_like(x), "mixed": np.where(rng.random((90, 1)) < 0.1, x * 1e18, x)}[kind]
    df = frame(spark, x)
    assert {(r.a, r.b) for r in neighbours.nearest(df, "id", NAMES, 4).collect()} == brute(x, 4)
    assert {(r.a, r.b) for r in neighbours.nearest_in_cells(df, "id", NAMES, 4, 20)[0].collect()} == brute(x, 4)


def test_fewer_rows_than_neighbours(spark):
    x = np.random.default_rng(3).standard_normal((3, WIDTH))
    assert neighbours.nearest(frame(spark, x), "id", NAMES, 5).count() == 6


def test_kernel_and_silhouette_send_rows_once_or_twice(spark, small):
    x = np.random.default_rng(4).standard_normal((900, WIDTH))
    df = frame(spark, x).selectExpr("*", "cast(id % 3 as int) as c").persist()
    df.count()
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    found, sent = shuffled(spark, lambda: {r.id: r.d for r in rankers.kernel_sums(df.drop("c"), "id", NAMES, 0.5, columns=False).collect()})
    assert [found[i] for i in range(len(x))] == pytest.approx(np.exp(-0.5 * d2).sum(1), rel=1e-12)
    assert sent < 6 * x.nbytes
    found, sent = shuffled(spark, lambda: metrics.silhouette(df, "id", NAMES, "c"))
    means = np.stack([(np.sqrt(d2) * (np.arange(len(x)) % 3 == c)).sum(1) / (300 - (np.arange(len(x)) % 3 == c)) for c in range(3)])
    own = means[np.arange(len(x)) % 3, np.arange(len(x))]
    means[np.arange(len(x)) % 3, np.arange(len(x))] = np.inf
    near = means.min(0)
    assert found == pytest.approx(((near - own) / np.maximum(near, own)).mean(), abs=1e-12)
    assert sent < 6 * x.nbytes


def test_kernel_directions_take_few_passes(spark, monkeypatch):
    """Columns beside each other on a sphere have directions about alike; a start from few random vectors took 20 passes."""
    x = np.random.default_rng(5).standard_normal((300, 24))
    names = [f"x{i}" for i in range(24)]
    x /= np.sqrt((x * x).sum(1))[:, None]
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "id long, " + ", ".join(f"{c} double" for c in names))
    passes, product = [], rankers.kernel_product
    monkeypatch.setattr(rankers, "kernel_product", lambda *a: passes.append(a) or product(*a))
    found = rankers.spec(df, "id", names, 3, style=3).scores
    assert len(passes) <= 12
    k = np.exp(-((x[:, None] - x[None]) ** 2).sum(2))
    root = np.sqrt(k.sum(1))
    values, vectors = np.linalg.eigh(k / np.outer(root, root))
    f = x * root[:, None]
    along = vectors[:, ::-1][:, 1:3].T @ f
    assert found == pytest.approx(-(along**2 * (1 + values[::-1][1:3])[:, None]).sum(0) / (f * f).sum(0), abs=1e-6)
