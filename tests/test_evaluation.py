"""Modules beside the core, where SQL says little: against plain versions on small tables."""

import hashlib
import json

import numpy as np
import pytest

from quillon import cli
from quillon.functions import order
from quillon.operators import concordance, downstream, evidence, gates, metrics, neighbours, prepare, rankers, ranks, records, residual, stability
from quillon.operators.groups import StructuralGroups, SubstitutionGroups
from quillon.operators.selector import GeometrySelector, ParameterError
from quillon.sources.files import read_npy
from quillon.sources.matrix import MatrixError, read_csv


def frame(spark, x, first="id"):
    names = [f"x{j}" for j in range(x.shape[1])]
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], f"{first} long, " + ", ".join(f"{c} double" for c in names)), names


@pytest.fixture(scope="module")
def blobs():
    """Three groups of rows; columns 0 and 2 tell them apart, 1 and 3 nearly copy them, the rest is noise."""
    rng = np.random.default_rng(3)
    label = np.repeat([0, 1, 2], 24)
    a, b = np.array([-4, 0, 4])[label] + rng.normal(0, 0.3, 72), np.array([0, 5, 0])[label] + rng.normal(0, 0.3, 72)
    x = np.column_stack([a, a + rng.normal(0, 0.05, 72), b, b + rng.normal(0, 0.05, 72), rng.normal(size=(72, 3))])
    return x, label


@pytest.fixture(scope="module")
def fit(spark, blobs):
    df, _ = frame(spark, blobs[0])
    return GeometrySelector(2, n_permutations=20, max_pairs=2_000).fit(df, "id")


def graph(x, k):
    z = (x - x.mean(0)) / x.std(0)
    d = ((z[:, None] - z[None]) ** 2).sum(2)
    edges = [(a, b) for a in range(len(x)) for b in [b for b in np.argsort(d[a], kind="stable") if b != a][:k]]
    t = np.median([d[e] for e in edges if d[e] > 0])
    w = np.zeros_like(d)
    for a, b in edges:
        w[a, b] = w[b, a] = np.exp(-d[a, b] / t)
    return z, w


def spectrum(w):
    d = w.sum(1)
    return np.linalg.eigh(np.eye(len(w)) - w / np.sqrt(np.outer(d, d)))


def test_eigenpairs_and_eigengap(spark, blobs):
    x, _ = blobs
    df, names = frame(spark, x)
    _, w = graph(x, 7)
    want, vectors = spectrum(w)
    z = rankers.scaling.mean_sd(df, names).apply(df)
    values, y = rankers.smallest_eigenpairs(neighbours.heat_graph(neighbours.nearest(z, "id", names, 7)), 4, rounds=8)
    assert values == pytest.approx(want[:4], abs=1e-4)
    got = np.array([r.y for r in y.orderBy("a").collect()])
    assert np.abs(got.T @ got - np.eye(4)).max() < 1e-6
    assert np.linalg.norm(got - vectors[:, :4] @ (vectors[:, :4].T @ got)) < 0.05
    assert rankers.eigengap([0.0, 0.01, 0.02, 0.9, 0.95], 2, 4) == 3 and rankers.eigengap([0.0, 0.5], 2, 4) == 2


def test_lasso_and_mcfs(spark, blobs, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 4))
    y = 2 * x[:, 1] + 0.01 * rng.normal(size=50)
    b = rankers.lasso(x.T @ x / 50, x.T @ y / 50, 0.1)
    slope = x.T @ (y - x @ b) / 50
    assert all(abs(s) <= 0.1 + 1e-8 if c == 0 else s == pytest.approx(0.1 * np.sign(c), abs=1e-8) for s, c in zip(slope, b))
    df, names = frame(spark, blobs[0])
    found = rankers.mcfs(df, "id", names, 2, clusters=3, rounds=3)
    assert set(found.selected) <= {0, 1, 2, 3}
    with pytest.raises(ParameterError):
        rankers.mcfs(df, "id", names, 2, clusters=1)


def test_spec_of_the_spectrum(spark, blobs):
    """The sums agree with the definition by eigenvectors."""
    x = blobs[0] / 4
    df, names = frame(spark, x)
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    w = np.exp(-d2)
    d = w.sum(1)
    values, u = spectrum(w)
    for style in (-1, 0):
        want = []
        for j in range(x.shape[1]):
            f = np.sqrt(d) * x[:, j]
            a = ((f / np.linalg.norm(f)) @ u) ** 2
            want.append((a * values).sum() if style == -1 else (a[1:] * values[1:]).sum() / (1 - a[0]))
        assert rankers.spec(df, "id", names, 3, style=style).scores == pytest.approx(want, rel=1e-6)


def test_rankings(spark, blobs):
    df, names = frame(spark, blobs[0])
    z, w = graph(blobs[0], 5)
    d = w.sum(1)
    f = z - (d @ z) / d.sum()
    want = [(f[:, j] @ ((np.diag(d) - w) @ f[:, j])) / (f[:, j] @ (d * f[:, j])) for j in range(len(names))]
    found = rankers.laplacian(df, "id", names, 3)
    assert found.scores == pytest.approx(want, rel=1e-6)
    assert list(found.selected) == list(np.argsort(want, kind="stable")[:3])
    assert found.transform(df, "id").columns == ["id", *(names[j] for j in sorted(found.selected))]
    assert rankers.top_k("abc", [1.0, 2.0, 2.0], 2).selected == (1, 2) and rankers.top_k("abc", [1.0, 2.0, 2.0], 1, False).selected == (0,)
    assert rankers.external_ranking("abc", [2, 0, 1], 2).get_support(indices=True) == [2, 0]
    assert rankers.constants_last(("a", "b", "c", "d"), ("b", "d"), [1, 0]) == [3, 1, 0, 2]
    for bad in ([0, 1], [0, 0, 2]):
        with pytest.raises(ParameterError):
            rankers.external_ranking("abc", bad, 1)


def test_groups(spark, fit):
    groups = StructuralGroups(fit)
    h = fit.geometry.unit_gram
    for r, members in groups.groups.items():
        for j in members:
            want = 1.0 if j == r else residual.substitution(h, fit.selected, r, j)
            assert groups.similarity[j] == want and (j == r or want >= 0.85)
    found = {g.representative: g for g in groups.structural()}
    assert {frozenset(g.members) for g in found.values()} == {frozenset({"x0", "x1"}), frozenset({"x2", "x3"})}
    for g in found.values():
        values = list(g.member_cgs_similarity.values())
        assert (g.mean_member_cgs_similarity, g.min_member_cgs_similarity) == pytest.approx((np.mean(values), min(values))) and 1.0 in values
        assert (g.n_members, g.n_substitutes, g.is_singleton, g.output_feature) == (2, 1, False, g.representative)
    alone = StructuralGroups(fit, 1.0)
    assert all((g.is_singleton, g.mean_member_cgs_similarity, g.min_member_cgs_similarity) == (True, 1.0, 1.0) for g in alone.structural())
    assert [r.group_id for r in groups.report(spark).collect()] == ["SG01", "SG02"] and len(groups.report(spark).columns) == 16
    every = groups.feature_map()
    assert every["x4"] is None and "x4" not in groups.feature_map(unassigned=False) and every["x0"] == every["x1"] != every["x2"]
    assert groups.summary()["n_contextual_substitutes"] == 2 and groups.representatives() == [fit.features[j] for j in fit.selected]
    members = SubstitutionGroups(fit).members(spark).collect()
    assert [m.is_selected_representative for m in members] == [True, False, True, False]
    with pytest.raises(ParameterError):
        SubstitutionGroups(fit, 1.5)


def test_fused_selectors(spark, blobs):
    df, names = frame(spark, blobs[0])
    base = GeometrySelector(2, n_permutations=20, max_pairs=2_000)
    for kind, weight in (("gaps", 0.5), ("concordance", 0.5), ("concordance", 0.0)):
        model = concordance.FusedSelector(base, kind, weight).fit(df, "id")
        assert len(model.selected) == 2 and {0, 1} & set(model.selected) and {2, 3} & set(model.selected)
        assert model.fused == pytest.approx((1 - weight) * evidence.rank01(model.support.effective) + weight * model.other)
    score, second = np.array([1.0, 0.95, 0.5]), np.array([0.1, 0.9, 1.0])
    assert [j for j, _, _ in concordance.greedy_with_ties(score, second, None, 0.5, 3, 0.1)] == [1, 0, 2]
    assert [j for j, _, _ in concordance.greedy_with_ties(score, second, None, 0.5, 3, 0.0)] == [0, 1, 2]
    for bad in ({"weight": 2.0}, {"kind": "x"}, {"base": GeometrySelector()}):
        with pytest.raises(ParameterError):
            concordance.FusedSelector(**{"base": base} | bad).fit(df, "id")
    with pytest.raises(ParameterError):
        concordance.jackknife(model.geometry, 2)


def plain_gap(x):
    z, n = np.sort(x), len(x)
    gaps = np.diff(z)
    positive = gaps[gaps > 1e-12]
    if n < 12 or not np.isfinite(z).all() or not len(positive):
        return 0.0
    floor, best = max(np.median(positive) / 4, 1e-12), 0.0
    for cut in range(int(np.ceil(0.1 * n)), int(np.floor(0.9 * n)) + 1):
        g, found = cut - 1, []
        for w in (2, 4, 8):
            near = np.concatenate([gaps[max(0, g - w) : g], gaps[g + 1 : g + 1 + w]])
            near = near[near > 1e-12]
            if len(near) >= 2:
                found.append(gaps[g] / max(np.median(near), floor))
        if found and gaps[g] > 1e-12:
            best = max(best, 4 * cut / n * (1 - cut / n) * np.log1p(max(0, min(found) - 1)))
    return best


def test_balanced_gap(spark, blobs):
    x = blobs[0]
    cases = [x[:, 0], x[:, 4], np.r_[np.zeros(20), np.ones(20)], np.arange(11.0), np.r_[x[:30, 0], np.nan], np.r_[x[:30, 0], np.inf], np.zeros(30)]
    for values in cases:
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id long, x double")
        assert evidence.balanced_gap(df, "x", "id").first().evidence == pytest.approx(plain_gap(values), abs=1e-9)


def test_metrics(spark, blobs):
    x, label = blobs
    df, names = frame(spark, x)
    labelled = df.join(spark.createDataFrame([(i, int(c)) for i, c in enumerate(label)], "id long, label int"), "id")
    use = metrics.clustering_utility(labelled, "id", "label", ["x0", "x2"], 3, restarts=3)
    assert (use["ari"], use["nmi"]) == pytest.approx((1, 1)) and use["silhouette"] > 0.7
    assert metrics.clustering_utility(labelled, "id", "label", [], 3) == {"ari": None, "nmi": None, "silhouette": None}
    z = (x - x.mean(0)) / x.std(0)
    i, j = np.triu_indices(len(x), 1)
    g = (z[i] - z[j]) ** 2
    g /= np.linalg.norm(g, axis=0)
    c = g.T @ g
    assert metrics.geometry_redundancy(df, names) == pytest.approx(c[np.triu_indices(len(names), 1)].mean(), rel=1e-6)
    s = np.linalg.svd(z, compute_uv=False) ** 2
    q = s / s.sum()
    assert metrics.effective_rank(df, names) == pytest.approx(np.exp(-(q * np.log(q)).sum()) / len(names), rel=1e-6)
    assert (metrics.geometry_redundancy(df, ["x0"]), metrics.effective_rank(df, ["x0"]), metrics.effective_rank(df, [])) == (0.0, 1.0, None)
    assert neighbours.preservation(df, "id", names, names).first()[0] == 1.0 and neighbours.preservation(df, "id", names, []).first()[0] is None


def test_stability(spark, blobs):
    df, names = frame(spark, blobs[0])
    fit = lambda part, seed: rankers.max_variance(part, names, 2).get_support(indices=True)
    found = stability.selections(fit, df, "id", 4)
    assert len(found) == 4 and all(len(x) == 2 for x in found)
    assert stability.subsample(df, "id", 0.8, 0).count() == round(0.8 * 72) and stability.subsample(df, "id", 0.01, 0).count() == 3
    picks = [[0, 2], [1, 2], [0, 3]]
    got = stability.substitution_stability(picks, {0: [1], 2: [3]})
    assert got["mean_substitution_aware_jaccard"] == 1.0 and got["mean_exact_jaccard"] == pytest.approx((1 / 3 + 1 / 3 + 0) / 3)
    assert stability.subsample_stability([[1]])["mean_jaccard"] == 1.0
    labelled = df.selectExpr("*", "cast(id % 3 as int) as label")
    peeks = lambda part, seed: [part.where("label = 0").agg({"id": "sum"}).first()[0]]
    trials = stability.label_audit({"blind": fit, "peeks": peeks}, labelled, "id", "label", 2)
    summary = {r.method: (r.all_trials_identical, r.fraction_identical) for r in stability.audit_summary(trials).collect()}
    assert summary["blind"] == (True, 1.0) and summary["peeks"][0] is False


def result_rows(spark, better=0.2):
    rng = np.random.default_rng(0)
    rows = []
    for d in range(30):
        base = rng.random()
        for m, source, plus in (("geometry", "native_or_local", better), ("A", "canonical:a", 0.0), ("B", "author_code:b", 0.0), ("C", "local", 0.0)):
            rows.append((f"d{d}", m, source, float(base + plus + 0.01 * rng.random()), ""))
    return spark.createDataFrame(rows, "dataset string, method string, implementation_source string, balanced_accuracy double, error string")


def test_gates(spark):
    good = gates.superiority_gate(result_rows(spark))
    assert good["passed"] and {c["name"]: c["observed"] for c in good["checks"]}["holm_significant_canonical_wins"] == 2
    bad = gates.superiority_gate(result_rows(spark, -0.2), evidence={"passed": False})
    failed = {c["name"] for c in bad["checks"] if not c["passed"]}
    assert failed == {"minimum_evidence_publication_gate", "candidate_best_mean_rank", "holm_significant_canonical_wins", "no_holm_significant_canonical_losses"}
    audits = spark.createDataFrame([(f"d{i}", True) for i in range(30)], "dataset string, eligible boolean")
    blind = spark.createDataFrame([("geometry", True)], "method string, all_trials_identical boolean")
    assert gates.publication_gate(result_rows(spark), audits=audits, label_audit=blind)["passed"]
    none = gates.publication_gate(result_rows(spark))
    assert {c["name"] for c in none["checks"] if not c["passed"]} == {"dataset_source_integrity_audit", "candidate_label_blindness_audit"}
    for call in (gates.publication_gate, gates.superiority_gate):
        with pytest.raises(ValueError):
            call(result_rows(spark).drop("method"))
    post = ranks.compare_methods(result_rows(spark), "dataset", "method", "balanced_accuracy", "geometry")["posthoc"]
    assert all(r["significant_holm"] and r["mean_difference"] > 0 and r["rank_biserial"] == 1.0 for r in post)


def test_records(spark, tmp_path):
    record = records.ranking_record([2, 0, 1], "m", "d", "s", commit="abc")
    path = f"{tmp_path}/sub/ranking.json"
    records.write_ranking_record(spark, record, path)
    assert records.read_ranking_record(spark, path, features=3, dataset_id="d") == record
    assert records.ranking_from_record(record, "abc", 1).source == "author_code:s@abc"
    bad = [{"indexing": "one"}, {"ranking": [0, 0, 1]}, {"schema_version": 2}, {"source": {"name": " "}}, {"selection_used_y": True}, {"selection_used_y": None}, {"feature_count": 4}]
    for change in bad:
        with pytest.raises(records.RecordError):
            records.check_ranking_record(record | change)
    x = np.arange(6.0).reshape(3, 2)
    assert records.array_fingerprint(x, ["a", "b"]) == hashlib.sha256(b"(3, 2)" + x.tobytes() + b'["a","b"]').hexdigest()
    df, names = frame(spark, x)
    assert records.table_fingerprint(df, "id", names) == records.table_fingerprint(df.repartition(3), "id", names) != records.table_fingerprint(df.where("id > 0"), "id", names)
    entries = [records.IntegrityRecord("a", "u"), {"dataset": "b", "source_uri": "u"}, {"dataset": "c", "source_uri": "u", "provenance_complete": True, "scaling_used_y": True}, {"dataset": "d", "source_uri": "u", "provenance_complete": True, "raw_feature_space_preserved": None}]
    got = records.audit_manifest(records.read_manifest(spark, entries))
    assert got["counts"] == {"PASS": 1, "FAIL": 2, "REVIEW": 1} and got["eligible_datasets"] == ["a"]
    records.write_audit(spark, got, f"{tmp_path}/audit.json")
    assert json.load(open(f"{tmp_path}/audit.json"))["n_records"] == 4
    json.dump({"records": [{"dataset": "e", "source_uri": "u", "provenance_complete": True}]}, open(f"{tmp_path}/m.json", "w"))
    open(f"{tmp_path}/m.csv", "w").write("dataset,source_uri,provenance_complete,scaling_used_y\nf,u,true,\ng,u,true,True\n")
    assert records.audit_manifest(records.read_manifest(spark, f"{tmp_path}/m.json"))["eligible_datasets"] == ["e"]
    assert records.audit_manifest(records.read_manifest(spark, f"{tmp_path}/m.csv"))["eligible_datasets"] == ["f"]


def test_downstream(spark, blobs):
    x, label = blobs
    df, names = frame(spark, x)
    data = df.join(spark.createDataFrame([(i, "abc"[c], int(i // 4)) for i, c in enumerate(label)], "id long, label string, part int"), "id")
    methods = {"MaxVariance": downstream.development_methods()["MaxVariance"], "broken": lambda *a: 1 / 0}
    for groups in (None, "part"):
        ds = downstream.Dataset("blobs", data, "id", "label", tuple(names), groups)
        rows = downstream.foldwise(spark, [ds], methods, folds=2).collect()
        assert len(rows) == 4 and {r.fold for r in rows} == {0, 1}
        assert all(r.balanced_accuracy > 0.9 and r.k == 3 for r in rows if r.method == "MaxVariance")
        assert all("ZeroDivisionError" in r.error and r.selected == "" for r in rows if r.method == "broken")
    coded = downstream.coded(ds).data
    nothing = downstream.predict(coded, coded, [], "label").select("prediction").distinct().collect()
    assert [r.prediction for r in nothing] == [0.0]
    for kind in ("linear_svm", "forest"):
        assert downstream.scores(downstream.predict(coded, coded, ["x0", "x2"], "label", kind), "label")["accuracy"] > 0.9
    panel = downstream.panel(spark, [ds], {"MaxVariance": methods["MaxVariance"]}, restarts=1).collect()
    assert {r.k for r in panel} == set(downstream.k_grid(7)) and all(r.error == "" and r.implementation_kind == "native_or_local" for r in panel)
    assert [downstream.downstream_k(p) for p in (1, 2, 3, 9, 10, 100)] == [1, 2, 2, 3, 4, 10]
    assert downstream.k_grid(50) == [2, 5, 10, 12, 20, 25] and downstream.k_grid(2) == [1] and downstream.k_grid(1) == [1]


def test_encoder(spark):
    rows = [(i, float(i % 7) if i % 5 else None, "ab"[i % 2] if i % 9 else None) for i in range(100)] + [(100, 1.0, "rare")]
    df = spark.createDataFrame(rows, "id long, x double, c string")
    encoder = prepare.fit_encoder(df, ["x", "c"])
    assert encoder.names() == ("x", "c=a", "c=b", "c=*") and encoder.modes == {"c": max("ab", key=lambda v: sum(r[2] == v for r in rows))}
    new = encoder.apply(spark.createDataFrame([(1, None, "unseen"), (2, 3.0, None)], df.schema), "id").orderBy("id").collect()
    assert tuple(new[0])[2:] == (0.0, 0.0, 1.0) and new[0].x == np.median([r[1] for r in rows if r[1] is not None])
    assert sum(tuple(new[1])[2:]) == 1.0


def test_order_statistics(spark, monkeypatch):
    monkeypatch.setattr(order, "FEW_VALUES", 10)
    monkeypatch.setattr(order, "BAND", 5)
    monkeypatch.setattr(order, "BINS", 8)
    rng = np.random.default_rng(4)
    x = np.r_[rng.normal(size=300), np.full(50, 0.25), 1e9]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        assert order.quantile(df, "x", q) == pytest.approx(np.quantile(x, q), rel=1e-12)
    assert order.median(df.where("false"), "x") is None


def test_command_line(spark, blobs, tmp_path, capsys):
    x = blobs[0]
    names = [f"x{j}" for j in range(7)]
    rows = "\n".join(",".join(map(str, [*r, "t"])) for r in x)
    open(f"{tmp_path}/in.csv", "w").write(",".join([*names, "label"]) + "\n" + rows + "\n")
    np.save(f"{tmp_path}/in.npy", x)
    common = ["--n-features", "2", "--permutations", "20", "--max-pairs", "500"]
    got = cli.main([f"{tmp_path}/in.csv", "--exclude-columns", "label", "--output", f"{tmp_path}/out", "--report", f"{tmp_path}/r/report.json", "--structural-groups", *common], spark)
    assert json.load(open(f"{tmp_path}/r/report.json")) == json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == json.loads(json.dumps(got))
    assert len(got["selected_indices"]) == 2 and got["structural_group_output"]["summary"]["n_structural_groups"] == 2 and not got["selection_used_y"]
    out = spark.read.csv(f"{tmp_path}/out", header=True)
    assert out.columns == got["selected_features"] and out.count() == 72
    again = cli.main([f"{tmp_path}/in.npy", "--output", f"{tmp_path}/out2", *common], spark)
    assert spark.read.parquet(f"{tmp_path}/out2").count() == 72 and again["n_features_in"] == 7
    few = read_npy(spark, f"{tmp_path}/in.npy", 10).orderBy("row_id").collect()
    assert np.array([tuple(r)[1:] for r in few]) == pytest.approx(x)
    with pytest.raises(MatrixError):
        read_csv(spark, f"{tmp_path}/in.csv")
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["x", "--n-features", "0"])
