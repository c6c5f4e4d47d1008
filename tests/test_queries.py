"""Every registered query against SQL or, where SQL can't express it, against a plain check."""

import importlib.util
import shutil
import subprocess
import sys

import numpy as np
import pytest

import __spark_entry__ as entry
from quillon.functions import special
from quillon.operators import evidence, governance, groups, pairs, ranks, residual, support
from quillon.operators.selector import GeometrySelector, ParameterError
from quillon.plans import catalog
from quillon.sources.matrix import MatrixError, matrix
from tests.conftest import DATA, same


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_sql(spark, name):
    same(catalog.QUERIES[name](spark, DATA), catalog.ORACLE_SQL[name])


#: Held against brute force on small tables in test_whole.py and test_evaluation.py instead.
SLOW = {"feature_report_whole", "foldwise_downstream", "gap_selection", "select_auto"}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL) - SLOW))
def test_rows(spark, name):
    catalog.QUERIES[name](spark, DATA).collect()


def test_entry(spark):
    assert entry.entry(spark).count() == catalog.WIDTH
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())


def test_nothing_else_imports_llm():
    code = "import sys, quillon.plans.catalog; assert not [m for m in sys.modules if m.startswith('quillon.llm')]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=importlib.util.find_spec("__spark_entry__").origin.rpartition("/")[0])


def test_entry_without_llm(tmp_path):
    """With the llm folders and corpus_pipeline.py, or the folders alone, taken away the rest still works."""
    top = importlib.util.find_spec("__spark_entry__").origin.rpartition("/")[0]
    shutil.copy(f"{top}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{top}/quillon", tmp_path / "quillon", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; assert 'holm' in e.queries() and 'op1_bpe' not in e.queries() and 'pipeline' not in e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
    if importlib.util.find_spec("corpus_pipeline"):
        shutil.copy(f"{top}/corpus_pipeline.py", tmp_path)
        subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)


def test_balanced_pairs_are_balanced(spark):
    for n, target in ((7, 10), (10, 23), (101, 500)):
        found = [(r.left, r.right) for r in pairs.balanced_slots(spark, n, target).orderBy("seq").collect()]
        assert len(found) == min(target, n * (n - 1) // 2) == len({frozenset(p) for p in found})
        degree = np.bincount(np.array(found).ravel(), minlength=n)
        assert degree.max() - degree.min() <= 2


def test_random_pairs_are_nested(spark):
    few = {(r.i, r.j) for r in pairs.random_pairs(spark, 60, 40, 3).collect()}
    many = {(r.i, r.j) for r in pairs.random_pairs(spark, 60, 90, 3).collect()}
    assert len(few) == 40 and len(many) == 90 and few <= many and all(i < j for i, j in many)


def signal(spark):
    rng = np.random.default_rng(7)
    a, b = np.repeat([-2, 2], 60), np.tile([-2, 2], 60)
    x = np.column_stack([a + rng.normal(0, 0.3, 120), b + rng.normal(0, 0.3, 120), a + rng.normal(0, 0.3, 120), b + rng.normal(0, 0.3, 120), rng.normal(size=(120, 4))])
    names = [f"x{i}" for i in range(x.shape[1])]
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"{c} double" for c in names))


def test_selection_finds_complementary_signals(spark):
    model = GeometrySelector(n_features=2, n_permutations=20, max_pairs=3000).fit(signal(spark), "id")
    assert {0, 2} & set(model.selected) and {1, 3} & set(model.selected)
    assert model.transform(signal(spark), "id").columns == ["id", *model.get_feature_names_out()]
    found = groups.StructuralGroups(model, 0.5).structural()
    assert {frozenset(g.members) for g in found} == {frozenset({"x0", "x2"}), frozenset({"x1", "x3"})}


def test_engines_agree(spark):
    a, b = (GeometrySelector(n_features=2, n_permutations=10, max_pairs=500, engine=e).fit(signal(spark), "id") for e in ("relational", "arrow"))
    assert a.selected == b.selected
    assert a.support.null_effective == pytest.approx(b.support.null_effective, rel=1e-8, abs=1e-8)


def test_arrow_engine_is_left_where_it_does_not_fit(spark, monkeypatch):
    """The limit holds for engine='arrow' too, and counts what the driver collects; the bank has no window by draw."""
    assert not support.fits_arrow(1_000_000, 2_000, 20) and not support.fits_arrow(500_000, 2_000, 20)
    monkeypatch.setattr(support, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(support, "support_arrow", None)
    a, b = (GeometrySelector(n_features=2, n_permutations=5, max_pairs=100, engine=e).fit(signal(spark), "id") for e in ("relational", "arrow"))
    assert a.selected == b.selected
    x = matrix(signal(spark), "id")
    plan = pairs.permutation_bank(x.data.select("id", "pos"), 5, 0)._jdf.queryExecution().optimizedPlan().toString()
    assert "partitionBy" not in plan and "row_number" not in plan


def test_parameters_and_matrices(spark):
    for bad in ({"n_features": 0}, {"alpha": 1.0}, {"n_permutations": 3}, {"support_mode": "raw_affinity", "n_features": "auto"}):
        with pytest.raises(ParameterError):
            GeometrySelector(**bad).validate(4)
    with pytest.raises(MatrixError):
        matrix(spark.createDataFrame([(1, 1.0, None)] * 3, "id long, a double, b double"), "id")


def test_residual_solvers_agree():
    rng = np.random.default_rng(4)
    g = np.abs(rng.normal(size=(50, 6)))
    h = residual.unit_gram(g.T @ g)
    for chosen in ([0], [0, 3], [1, 2, 4]):
        rest = [j for j in range(6) if j not in chosen]
        assert residual.residuals(h, chosen, rest) == pytest.approx(residual.residuals(h, chosen, rest, "batched_cd"), abs=1e-8)


def test_statistics():
    assert special.chi2_sf(3.541818181818, 4) == pytest.approx(0.471548351984, abs=1e-9)
    assert ranks.holm([0.01, 0.04, 0.03]) == pytest.approx([0.03, 0.06, 0.06])
    assert special.clopper_pearson(13, 200) == pytest.approx((0.0351, 0.1086), abs=1e-4)
    assert evidence.substitution_jaccard([0, 1], [2, 3], {0: [2], 1: [3]}) == 1.0
    assert evidence.jaccard([], []) == 1.0 and evidence.relevant_precision([], [[0]]) == 0.0
    assert list(evidence.rank01([3.0, 1.0, 1.0])) == [1.0, 0.25, 0.25]


def test_audit(spark):
    rows = spark.createDataFrame([("a", "u", False, True), ("b", "u", True, True), ("c", "", False, True), ("d", "u", None, True), ("e", "u", False, False)], "dataset string, source_uri string, scaling_used_y boolean, provenance_complete boolean")
    assert {r.dataset: r.status for r in governance.audit(rows).collect()} == {"a": "PASS", "b": "FAIL", "c": "REVIEW", "d": "PASS", "e": "REVIEW"}
