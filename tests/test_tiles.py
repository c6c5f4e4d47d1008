"""Order statistics, geometry in tiles, gap evidence and rankers of whole matrices, against plain numpy."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon import cli
from quillon.functions import order
from quillon.operators import evidence, gates, granular, neighbours, pairs, rankers, residual, resume, scaling, spectra, support, tiles
from quillon.operators.selector import GeometrySelector, ParameterError
from quillon.sources.files import read_npy, write_npy
from quillon.sources.matrix import MatrixError, matrix, vector_matrix


def frame(spark, x):
    names = [f"x{j}" for j in range(x.shape[1])]
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"{c} double" for c in names)), names


@pytest.mark.parametrize(("values", "counts"), [(100_000, 1 << 18), (3, 64)])
def test_quantiles_of_many_series(spark, monkeypatch, values, counts):
    monkeypatch.setattr(order, "MANY_VALUES", values)
    monkeypatch.setattr(order, "MANY_COUNTS", counts)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(701, 4))
    x[:, 1] = np.round(x[:, 1])
    x[:9, 2] = np.nan, np.inf, -np.inf, 1e300, -1e300, 0.0, -0.0, 5e-324, np.nan
    x[:, 3] = np.nan
    df, names = frame(spark, x)
    shares = (0, 0.25, 0.5, 0.95, 1)
    got = order.quantiles(order.Columns(df, names), shares)
    for k in range(3):
        own = x[np.isfinite(x[:, k]), k]
        assert got[k] == pytest.approx(np.quantile(own, shares), rel=1e-12)
    assert np.isnan(got[3]).all()
    groups = order.Groups(df.selectExpr("cast(id % 3 as int) as g", "x0"), "g", "x0")
    assert order.quantiles(groups, (0.5,))[:, 0] == pytest.approx([np.median(x[int(g) :: 3, 0]) for g in groups.names])
    assert order.quantiles(order.Columns(df.where("id < 0"), names), (0.5,)).shape == (4, 1)
    arrays = order.Components(df.selectExpr("array(x0, x1) as v"), "v", 2, np.array([0.5, 1.0]))
    assert order.quantiles(arrays, (0.5,))[:, 0] == pytest.approx(np.median(np.abs(x[:, :2] - [0.5, 1.0]), axis=0))


def test_robust_scaling_of_flat_columns(spark):
    """Deviation, quartiles, spread and 1, each where the one before is nothing."""
    x = np.array([[0, 0, 0, 5], [0, 1, 0, 5], [0, 0, 0, 5], [0, 0, 0, 5], [9, 1, 0, 5], [0, 3, 2, 5], [0, 2, 0, 5]], float)
    df, names = frame(spark, x)
    got = scaling.robust(df, names)
    assert got.location == pytest.approx(np.median(x, axis=0))
    for k in range(4):
        mad, q = np.median(np.abs(x[:, k] - np.median(x[:, k]))), np.quantile(x[:, k], (0.25, 0.75))
        want = next((v for v in (1.4826 * mad, (q[1] - q[0]) / 1.349, x[:, k].std()) if v > 1e-12), 1.0)
        assert got.scale[k] == pytest.approx(want)
    z = scaling.mean_sd(df, names)
    both = scaling.mean_sd_vectors(df.selectExpr("array(x0, x1, x2, x3) as v"), names)
    assert (both.location, both.scale) == (pytest.approx(z.location), pytest.approx(z.scale))


def test_matrices_of_arrays(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0, float(-i)]) for i in range(5)], "id long, e array<double>")
    m = vector_matrix(df, "id", "e")
    assert (m.features, m.rows) == (("f0", "f1", "f2"), 5)
    assert [tuple(r) for r in m.data.orderBy("pos").collect()][2] == (2, 2, 2.0, 1.0, -2.0)
    for bad in ([1.0], [1.0, None, 2.0], [1.0, float("nan"), 2.0], None):
        with pytest.raises(MatrixError):
            vector_matrix(df.unionByName(spark.createDataFrame([(9, bad)], df.schema)), "id", "e")
    with pytest.raises(MatrixError):
        matrix(df.selectExpr("id % 2 as id", "e[0] as a", "e[1] as b"), "id")


def test_units_agree_with_both_engines(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 7))
    x[:, 2] += np.repeat([-3, 3], 25)
    x[:, 3] = x[:, 2] + 0.1 * rng.normal(size=50)
    df, _ = frame(spark, x)
    fits = {e: GeometrySelector(2, n_permutations=9, max_pairs=300, engine=e).fit(df, "id") for e in ("relational", "arrow", "tiles")}
    monkeypatch.setattr(tiles, "TILE", 3)
    monkeypatch.setattr(tiles, "UNIT_BYTES", 4_000)
    monkeypatch.setattr(tiles, "_CHUNK", 50)
    fits["small"] = GeometrySelector(2, n_permutations=9, max_pairs=300).fit(df, "id")
    want = fits["relational"].support
    for f in fits.values():
        assert f.selected == fits["relational"].selected
        for name in ("affinity", "coverage", "null_median", "null_scale", "effective", "null_effective"):
            assert getattr(f.support, name) == pytest.approx(getattr(want, name), rel=1e-8, abs=1e-9)
    g = fits["tiles"].geometry
    rows = np.array([r.g for r in g.table.collect()])
    h = residual.unit_gram(rows.T @ rows)
    gram = tiles.Gram(g.table, 7)
    assert gram.block([4], [4]) == pytest.approx(h[4, 4]) and not gram.columns
    assert gram.block([2, 4], [1, 2, 3]) == pytest.approx(h[np.ix_([2, 4], [1, 2, 3])]) and set(gram.columns) == {2, 4}
    assert gram.block([0, 1, 2], [2]) == pytest.approx(h[np.ix_([0, 1, 2], [2])]) and set(gram.columns) == {2, 4}
    found = {(r.a, r.b): r.c for r in tiles.unit_gram_table(g.table, 7).collect()}
    assert found == pytest.approx({(a, b): h[a, b] for a in range(7) for b in range(7)})
    rest = tiles.rest_profiles(g.table, rows.sum(0)).orderBy("pair_id").collect()
    wide = support.rest_profiles(g.profiles, g.source.features).orderBy("pair_id").collect()
    assert np.array([r.r for r in rest]) == pytest.approx(np.array([tuple(r)[3:] for r in wide]), rel=1e-9)


def test_five_thousand_features(spark):
    """The plan is the same as for fifty, and so are the numbers of the first of them that a plain version gives."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 5_000)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, e array<double>")
    sizes = []
    for width in (50, 5_000):
        source = vector_matrix(df.selectExpr("id", f"slice(e, 1, {width}) as e"), "id", "e")
        g = GeometrySelector(2, n_permutations=20, max_pairs=200).geometry(source)
        bank = pairs.permutation_bank(source.table.select("id", "pos"), 5, 0)
        found = tiles.statistics(g.table, g.z, bank, width, 40, 5)
        sizes.append(len(found._jdf.queryExecution().optimizedPlan().toString()))
        got = {(r.b, r.k): (r.affinity, r.coverage) for r in found.where("k < 3").collect()}
        g.release()
    assert len(got) == 18 and sizes[1] < 1.2 * sizes[0]
    middle = np.median(x, axis=0)
    z = np.clip((x - middle) / (1.4826 * np.median(np.abs(x - middle), axis=0)), -4.5, 4.5)
    edges = {r.pair_id: (r.i, r.j) for r in g.table.select("pair_id", "i", "j").collect()}
    i, j = np.array([edges[k] for k in range(200)]).T
    p = (z[i] - z[j]) ** 2
    p /= p.sum(0)
    rest = (p.sum(1, keepdims=True) - p[:, :3]) / 4_999
    rest /= rest.sum(0)
    mass = np.stack([np.bincount(i, p[:, k], 40) + np.bincount(j, p[:, k], 40) for k in range(3)]) / 2
    for k in range(3):
        m = mass[k][mass[k] > 0]
        assert got[-1, k] == pytest.approx((np.sqrt(p[:, k] * rest[:, k]).sum(), np.exp(-(m * np.log(m)).sum()) / 40), rel=1e-7)


@pytest.mark.parametrize("rows", [23, 50_000])
def test_gap_evidence_of_all_columns(spark, monkeypatch, rows):
    """As one column at a time, wherever tasks begin."""
    monkeypatch.setattr(evidence, "GAP_ROWS", rows)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 4))
    x[:, 1] += np.repeat([-3, 3], 30)
    x[:, 2] = np.round(x[:, 2])
    x[:, 3] = 1.0
    df, names = frame(spark, x)
    got = evidence.balanced_gaps(df.selectExpr("id as pos", "array(x0, x1, x2, x3) as v"), 4, 60)
    assert got == pytest.approx([evidence.balanced_gap(df, c, "id").first().evidence for c in names], rel=1e-9)
    assert got[0] > 0 and got[1] > 0 and got[3] == 0
    assert (evidence.balanced_gaps(df.where("id < 5").selectExpr("id as pos", "array(x0, x1) as v"), 2, 5) == 0).all()


def plain_balls(x):
    """Row sets of all balls, by the definition: full distance matrices, the second of the ordered farthest pairs."""

    def halves(rows):
        d = np.sqrt(((x[rows][:, None] - x[rows][None]) ** 2).sum(2))
        r, c = np.where(d == d.max())
        left = d[:, r[1]] < d[:, c[1]]
        return rows[left], rows[~left]

    def centre_distances(rows):
        return np.sqrt(((x[rows] - x[rows].mean(0)) ** 2).sum(1))

    def density(rows):
        return centre_distances(rows).sum() or len(rows)

    root = len(x) ** 0.5
    least = 16 if root > 16 else 8 if root > 8 else int(root)
    balls = [np.arange(len(x))]
    while True:
        after = []
        for b in balls:
            parts = halves(b) if len(b) >= least and len(b) > 1 else ()
            dense = parts and all(map(len, parts)) and sum(len(p) * density(p) for p in parts) / len(b) < density(b)
            after += parts if dense else [b]
        if len(after) == len(balls):
            break
        balls = after
    radii = [centre_distances(b).max() for b in balls if len(b) > 1]
    wide = 2 * max(np.median(radii), np.mean(radii))
    while True:
        after = []
        for b in balls:
            after += halves(b) if len(b) > 1 and centre_distances(b).max() > wide else [b]
        if len(after) == len(balls):
            return after
        balls = after


def plain_scores(x, centres, smooth, width=0.1):
    p = x.shape[1]
    kernel = [np.exp(-((x[:, j, None] - centres[None, :, j]) ** 2) / (2 * width**2 + 1e-12)) if smooth[j] else (x[:, j, None] == centres[None, :, j]).astype(float) for j in range(p)]
    graph = np.zeros((p, p))
    for i in range(p):
        for j in range(p):
            low, high = np.maximum(1 - kernel[i], kernel[j]).min(1), np.minimum(kernel[i], kernel[j]).max(1)
            graph[i, j] = max((a / b for a, b in zip(low, high) if b > 0), default=0.0)
    moves = graph / (graph.sum(1, keepdims=True) + 1e-8)
    back = 1 / (1 + np.log(graph.sum(1).mean() + 1 + 1e-12))
    now = last = np.ones(p) / p
    visits = np.zeros(p)
    for _ in range(10_000):
        new = back / p + (1 - back) * (((0.8 * now + 0.2 * last) / (1 + 0.1 * visits)) @ moves)
        visits = visits + new / new.sum()
        if new.sum() > 0.8:  # all are positive: the same is taken from each until nothing is below zero
            low, high = 0.0, new.max()
            for _ in range(200):
                cut = (low + high) / 2
                low, high = (cut, high) if np.maximum(new - cut, 0).sum() > 0.8 else (low, cut)
            new = np.maximum(new - high, 0)
        if np.abs(new - now).sum() < 1e-4:
            now = new
            break
        now, last = new, now
    return (now - now.min()) / (now.max() - now.min())


@pytest.mark.parametrize(("rows", "size"), [(4_000, 16 << 20), (40, 16 << 20), (25, 900)])
def test_granular_walk(spark, monkeypatch, rows, size):
    """Balls split by one task or over rounds of jobs, centres sent at once or in blocks."""
    monkeypatch.setattr(granular, "BALL_ROWS", rows)
    monkeypatch.setattr(granular, "BLOCK_ROWS", 30)
    monkeypatch.setattr(granular, "CENTRE_BYTES", size)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(150, 5))
    x[:, 0] += np.repeat([-4, 0, 4], 50)
    x[:, 1] = x[:, 0] + 0.2 * rng.normal(size=150)
    x[100:110] = x[100]  # equal rows
    df, names = frame(spark, np.column_stack([x, np.full(150, 3.0)]))
    unit = (x - x.min(0)) / (x.max(0) - x.min(0))
    want = plain_balls(unit)
    if rows != 40:
        placed = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(unit)], "pos long, v array<double>")
        found: dict = {}
        for r in granular.balls(placed).collect():
            found.setdefault(r.ball, set()).add(r.pos)
        assert {frozenset(b) for b in found.values()} == {frozenset(b.tolist()) for b in want}
        assert len(want) > 10
    got = granular.granular_walk(df, "id", names, 3)
    scores = plain_scores(unit, np.array([unit[b].mean(0) for b in want]), [True] * 5)
    assert got.scores == pytest.approx([*scores, -1.0], abs=1e-9)
    assert list(got.selected) == list(np.argsort(-scores, kind="stable")[:3])


def test_granular_kernel_of_equality(spark):
    """Columns that do not span 0 to 1 are matched, where nothing is rescaled."""
    rng = np.random.default_rng(12)
    x = np.column_stack([rng.integers(0, 3, 40), rng.integers(0, 2, 40), rng.normal(size=40)]).astype(float)
    x[:, 2] = (x[:, 2] - x[:, 2].min()) / (x[:, 2].max() - x[:, 2].min())
    df, names = frame(spark, x)
    want = plain_scores(x, np.array([x[b].mean(0) for b in plain_balls(x)]), [False, True, True])
    assert granular.granular_walk(df, "id", names, 1, rescale=False).scores == pytest.approx(want, abs=1e-9)
    assert granular.to_l1(np.array([0.1, -0.2]), 0.8).tolist() == [0.1, -0.2]
    assert granular.to_l1(np.array([1.0, -0.5, 0.1]), 0.8) == pytest.approx([0.65, -0.15, 0.0])
    with pytest.raises(ParameterError):
        granular.granular_walk(df.selectExpr("id", "1.0 as a", "2.0 as b"), "id", ["a", "b"], 1)


def dense_graph(x, k):
    z = (x - x.mean(0)) / x.std(0)
    d = ((z[:, None] - z[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    w = np.zeros_like(d)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    t = np.median(np.take_along_axis(d, near, 1))
    for a, row in enumerate(near):
        w[a, row] = np.exp(-d[a, row] / t)
    return z, np.maximum(w, w.T)


def test_spectra_of_kernel_and_graph(spark):
    """Spectral style 3, the eigengap, and scores of sparse regression on the leading coordinates."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(70, 5)) * 0.6
    x[:, 0] += np.repeat([-1.0, 0.2, 1.1], [20, 27, 23])
    x[:, 1] += np.repeat([0.0, 1.3, 0.1], [20, 27, 23])
    df, names = frame(spark, x)
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    w = np.exp(-0.5 * d2)
    d = w.sum(1)
    values, u = np.linalg.eigh(np.eye(70) - w / np.sqrt(np.outer(d, d)))
    for style in (2, 3, 5):
        want = []
        for j in range(5):
            f = np.sqrt(d) * x[:, j]
            a = ((f / np.linalg.norm(f)) @ u) ** 2
            want.append(-(a[1:style] * (2 - values[1:style])).sum())
        assert rankers.spec(df, "id", names, 2, gamma=0.5, style=style).scores == pytest.approx(want, abs=1e-6)
    with pytest.raises(ParameterError):
        rankers.spec(df, "id", names, 2, style=1)
    z, w = dense_graph(x, 5)
    d = w.sum(1)
    values, u = np.linalg.eigh(np.eye(70) - w / np.sqrt(np.outer(d, d)))
    gaps = {k: values[k] - values[k - 1] for k in range(2, 11)}
    clusters = max(gaps, key=gaps.get)
    assert rankers.spectral_clusters(df, "id", names, 5) == clusters
    weights = []
    for c in range(1, 3):
        b, y = np.zeros(5), u[:, c] - u[:, c].mean()
        for _ in range(3_000):  # proximal gradient steps
            b = b + 0.2 * z.T @ (y - z @ b) / 70
            b = np.sign(b) * np.maximum(np.abs(b) - 0.2 * 0.01, 0)
        weights.append(np.abs(b))
    assert rankers.mcfs(df, "id", names, 2, clusters=2).scores == pytest.approx(np.max(weights, axis=0), abs=1e-5)
    assert neighbours.heat_graph(neighbours.nearest(scaling.mean_sd(df, names).apply(df), "id", names, 5)).count() == (w > 0).sum()


def test_npy_sink(spark, tmp_path, capsys):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(61, 4))
    df, names = frame(spark, x)
    write_npy(df.repartition(7), "id", ["x2", "x0"], f"{tmp_path}/out.npy", 10)
    assert (np.load(tmp_path / "out.npy") == x[:, [2, 0]]).all()
    assert (np.array([tuple(r)[1:] for r in read_npy(spark, f"{tmp_path}/out.npy", 9).orderBy("row_id").collect()]) == x[:, [2, 0]]).all()
    write_npy(df, "id", names, f"{tmp_path}/out.npy")  # replaces the file
    np.save(tmp_path / "in.npy", x)
    got = cli.main([f"{tmp_path}/in.npy", "--output", f"{tmp_path}/few.npy", "--n-features", "2", "--permutations", "20", "--max-pairs", "100"], spark)
    assert (np.load(tmp_path / "few.npy") == x[:, sorted(got["selected_indices"])]).all()
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["n_features_selected"] == 2
    assert sorted(p.name for p in tmp_path.iterdir()) == ["few.npy", "in.npy", "out.npy"]


def test_gates_read_csv(spark, tmp_path):
    rows = [(f"d{i}", m, 0.5 + 0.01 * i + (0.2 if m == "geometry" else 0.0), "failed" if i == 3 and m == "b" else None, f"canonical:{m}") for i in range(8) for m in ("geometry", "a", "b", "c")]
    df = spark.createDataFrame(rows, "dataset string, method string, balanced_accuracy double, error string, implementation_source string")
    df.coalesce(1).write.option("header", True).csv(f"{tmp_path}/results.csv")
    for gate in (gates.superiority_gate, gates.publication_gate):
        got, want = gate(f"{tmp_path}/results.csv"), gate(df)
        assert [c["name"] for c in got["checks"]] == [c["name"] for c in want["checks"]]
        assert [c["passed"] for c in got["checks"]] == [c["passed"] for c in want["checks"]]
        assert [c["observed"] for c in got["checks"]] == pytest.approx([c["observed"] for c in want["checks"]])


def test_resumed_run(spark, tmp_path):
    """A run that dies within a batch, and one between rows and log: nothing is lost, nothing counts twice."""
    store = resume.Store(spark, f"{tmp_path}/store", "task long, part string, value double", ("task", "part"))
    tasks = spark.createDataFrame([(i, p) for i in range(5) for p in "ab"], "task long, part string")
    seen = []

    def work(batch):
        seen.extend(batch)
        if len(seen) == 6:
            raise RuntimeError("the machine is gone")
        return spark.createDataFrame([(i, p, i + 0.5) for i, p in batch for _ in range(2)], "task long, part string, value double")

    assert store.rows().count() == 0 and store.todo(tasks).count() == 10
    with pytest.raises(RuntimeError):
        store.run(tasks, work, 2)
    assert len(seen) == 6 and store.rows().count() == 8
    lost = store.commit([(9, "x")], spark.createDataFrame([(9, "x", 1.0)], store.schema))
    (tmp_path / "store" / "log" / lost / "_SUCCESS").unlink()  # as if the driver had died before the log was whole
    assert store.done().count() == 4 and store.rows().where("task = 9").isEmpty()
    done = store.run(tasks, work, 2)
    assert sorted(tuple(r)[:2] for r in done.collect()) == sorted((i, p) for i in range(5) for p in "ab" for _ in range(2))
    assert seen.count((0, "a")) == 1 and store.todo(tasks).isEmpty() and store.run(tasks, work).count() == 20
    store.commit([(0, "a")], spark.createDataFrame([(0, "a", 7.0)], store.schema))
    assert store.rows().count() == 21 and store.last("value").count() == 10
    assert store.commit([(0, "a")], spark.createDataFrame([(0, "a", 8.0)], store.schema)) and store.rows().count() == 21
    assert {r.value for r in store.last("value").where("task = 0 and part = 'a'").collect()} == {8.0}
    store.commit([(7, "c")], spark.createDataFrame([], store.schema))
    assert store.todo(spark.createDataFrame([(7, "c"), (8, "c")], "task long, part string")).collect() == [(8, "c")]


def test_lanczos_that_ends_at_a_restart(spark, monkeypatch):
    """Vectors come from the basis as it is, also when the last step has turned it."""
    monkeypatch.setattr(spectra, "MOST_WIDTH", 0)
    rng = np.random.default_rng(17)
    a = rng.normal(size=(30, 30))
    a = a @ a.T / 30
    edges = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(30) for j in range(30)], "a long, b long, w double").persist()

    def apply(y):
        sums = edges.join(y.select(F.col("a").alias("b"), "y"), "b").groupBy("a").agg(*(F.sum(F.col("w") * F.get("y", F.lit(k))).alias(f"s{k}") for k in range(3)))
        return sums.select("a", F.filter(F.array("s0", "s1", "s2"), lambda x: x.isNotNull()).alias("z"))

    values, y = spectra.leading(apply, edges.select("a").distinct(), 1, steps=3)
    got = np.array([r.y[0] for r in y.orderBy("a").collect()])
    assert np.linalg.norm(got) == pytest.approx(1) and got @ a @ got == pytest.approx(values[0]) and values[0] > 0.8 * np.linalg.eigvalsh(a)[-1]
