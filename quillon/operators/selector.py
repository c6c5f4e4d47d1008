"""Label-free selection of features by sample geometry: estimators with fit, models with transform."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..sources.matrix import Matrix, columns_of, matrix
from . import pairs as pairing
from . import residual, scaling, tiles
from . import support as supports

PATH_SCHEMA = """step int, feature_index int, feature_name string, support_z double, sample_coverage double, effective_support double,
max_null_adjusted_p double, residual_novelty double, selection_score double, conservative_step_p double, auto_threshold double, forced_selection boolean"""
REPORT_SCHEMA = """feature string, selected boolean, rank int, support_z double, sample_coverage double, effective_support double,
max_null_adjusted_p double, residual_novelty_at_selection double, selection_score double, conservative_step_p double"""


class ParameterError(ValueError):
    """A parameter is outside its range."""


@dataclass
class Geometry:
    """What a fit computes once: scaled rows (key, pos, v), and pairs with their profiles (pair_id, i, j, g), all features in one
    array.  ``scaled`` and ``profiles`` show them with a column for each feature."""

    source: Matrix
    z: DataFrame
    table: DataFrame
    n_pairs: int
    _gram: tiles.Gram | None = None

    @property
    def pairs(self) -> DataFrame:
        return self.table.select("pair_id", "i", "j")

    @property
    def scaled(self) -> DataFrame:
        return columns_of(self.z, "v", self.source.features)

    @property
    def profiles(self) -> DataFrame:
        return columns_of(self.table, "g", self.source.features)

    @property
    def gram(self) -> tiles.Gram:
        """Of unit profiles, a column at a time."""
        if self._gram is None:
            self._gram = tiles.Gram(self.table, self.source.width)
        return self._gram

    @property
    def unit_gram(self) -> np.ndarray:
        """All of it, for few features."""
        known = list(self.gram.columns)
        self.gram.ensure(range(self.source.width))
        out = np.stack([self.gram.columns[x] for x in range(self.source.width)])
        new = [x for x in range(self.source.width) if x not in known]
        out[np.ix_(new, known)] = out[np.ix_(known, new)].T  # the numbers that have been used
        out[new, new] = self.gram.diagonal[new]
        return out

    def release(self) -> None:
        self.table.unpersist()
        self.z.unpersist()


@dataclass
class Model:
    """A fitted selection.  ``path``: a dictionary for each step, in order."""

    features: tuple[str, ...]
    selected: list[int]
    path: list[dict]
    support: supports.Support | None = None
    adjusted_p: np.ndarray | None = None
    threshold: float = float("-inf")
    geometry: Geometry | None = None
    info: dict = field(default_factory=dict)

    @property
    def support_mask(self) -> list[bool]:
        return [j in set(self.selected) for j in range(len(self.features))]

    def get_support(self, indices: bool = False) -> list:
        """The mask, or the indices in order of selection."""
        return list(self.selected) if indices else self.support_mask

    def get_feature_names_out(self) -> list[str]:
        """In the order of the columns."""
        return [self.features[j] for j in sorted(self.selected)]

    def transform(self, df: DataFrame, *keep: str) -> DataFrame:
        """The selected columns in column order (after the columns named in ``keep``): pruned down to the scan."""
        if missing := [c for c in self.features if c not in df.columns]:
            raise ParameterError(f"columns are missing: {missing}")
        return df.select(*keep, *self.get_feature_names_out())

    def ranking(self) -> list[int]:
        """Selected first, in order; the others by effective support, then index."""
        effective = self.support.effective if self.support is not None else np.zeros(len(self.features))
        rest = [j for j in range(len(self.features)) if j not in self.selected]
        return self.selected + sorted(rest, key=lambda j: (-effective[j], j))

    def path_frame(self, spark: SparkSession) -> DataFrame:
        names = [x.split()[0] for x in PATH_SCHEMA.replace("\n", " ").split(", ")]
        return spark.createDataFrame([tuple(p.get(k) for k in names) for p in self.path], PATH_SCHEMA)

    def summary(self) -> dict:
        """What was selected from what, with the parameters, for a JSON report.  (Names of entries are those of the format.)"""
        fit = self.info.get("parameters", {})
        return {
            "method": "geometry selection", "selection_used_y": False, "n_samples": self.geometry.source.rows, "n_features_in": len(self.features), "n_features_selected": len(self.selected),
            "selected_indices": self.selected, "selected_features": self.get_feature_names_out(), "parameters": fit,
        }

    def report(self, spark: SparkSession) -> DataFrame:
        """A row for each feature, selected first."""
        steps = {p["feature_index"]: p for p in self.path}
        rows = []
        for rank, j in enumerate(self.ranking(), 1):
            s = steps.get(j, {})
            rows.append((self.features[j], j in steps, rank, float(self.support.robust_z[j]), float(self.support.coverage[j]), float(self.support.effective[j]), float(self.adjusted_p[j]),
                         s.get("residual_novelty"), s.get("selection_score", 0.0), s.get("conservative_step_p")))
        return spark.createDataFrame(rows, REPORT_SCHEMA)


@dataclass
class GeometrySelector:
    """Greedy selection by effective support * residual ** residual_power.

    n_features: a number, or "auto" to stop below the null threshold.  support_mode: "calibrated",
    "calibrated_no_coverage", "raw_affinity" or "raw_affinity_coverage" (the raw ones have no
    threshold and need a number).  engine: "tiles" (blocks of draws, rows and features; "auto" is the same), "relational", or
    "arrow", which hands a task one feature and takes the tiles where what it collects doesn't fit."""

    n_features: int | str = "auto"
    n_permutations: int = 200
    alpha: float = 0.05
    max_pairs: int = 50_000
    pair_sampling: str = "balanced"
    scale: str = "robust"
    clip_z: float = 4.5
    coverage_power: float = 2.0
    residual_power: float = 0.5
    use_residual: bool = True
    allow_empty: bool = True
    support_mode: str = "calibrated"
    engine: str = "auto"
    residual_engine: str = "auto"
    seed: int = 0

    def validate(self, width: int) -> None:
        k, auto = self.n_features, self.n_features == "auto"
        rules = [
            (auto or isinstance(k, int) and not isinstance(k, bool) and 1 <= k <= width, f"n_features must be 'auto' or 1..{width}"),
            (self.n_permutations >= (20 if auto else 5), "n_permutations must be at least 5, or 20 for 'auto'"),
            (0 < self.alpha < 1, "alpha must lie between 0 and 1"),
            (self.max_pairs >= 10, "max_pairs must be at least 10"),
            (self.pair_sampling in ("balanced", "random"), "pair_sampling: balanced or random"),
            (self.scale in ("robust", "mean_sd"), "scale: robust or mean_sd"),
            (self.clip_z > 0, "clip_z must be positive"),
            (self.coverage_power >= 0 and self.residual_power >= 0, "powers must not be negative"),
            (self.support_mode in ("calibrated", "calibrated_no_coverage", "raw_affinity", "raw_affinity_coverage"), "no such support_mode"),
            (not (auto and self.support_mode.startswith("raw")), "raw support modes need a fixed n_features"),
            (self.engine in ("auto", "tiles", "relational", "arrow"), "engine: auto, tiles, relational or arrow"),
            (self.residual_engine in ("auto", "nnls", "batched_cd"), "residual_engine: auto, nnls or batched_cd"),
        ]
        for good, message in rules:
            if not good:
                raise ParameterError(message)

    def parameters(self) -> dict:
        """Those of a report, by the names of its format."""
        named = {"n_features": "n_features", "n_permutations": "n_permutations", "alpha": "alpha", "max_pairs": "max_pairs", "pair_sampler": "pair_sampling", "residual_power": "residual_power", "random_state": "seed"}
        return {name: getattr(self, own) for name, own in named.items()}

    def geometry(self, source: Matrix) -> Geometry:
        fitted = scaling.robust_vectors(source.table, source.features, self.clip_z) if self.scale == "robust" else scaling.mean_sd_vectors(source.table, source.features)
        z = fitted.apply_vectors(source.table).persist()  # read for pairs and for every permutation
        drawn = pairing.sample_pairs(source.table.select(source.key, "pos"), source.rows, self.max_pairs, self.seed, self.pair_sampling)
        return Geometry(source, z, tiles.profiles(drawn, z).persist(), min(self.max_pairs, source.rows * (source.rows - 1) // 2))

    def supports(self, g: Geometry) -> supports.Support:
        bank = pairing.permutation_bank(g.source.table.select(g.source.key, "pos"), self.n_permutations, self.seed)
        power = 0.0 if self.support_mode == "calibrated_no_coverage" else self.coverage_power
        features, n = g.source.features, g.source.rows
        if self.engine == "relational":
            found = supports.support_relational(g.profiles, g.pairs, g.scaled, bank, features, n, power)
        elif self.engine == "arrow" and supports.fits_arrow(n, g.n_pairs, self.n_permutations):
            found = supports.support_arrow(g.profiles, g.scaled, bank, features, n, power)
        else:
            found = tiles.support_tiles(g.table, g.z, bank, len(features), n, self.n_permutations, power)
        if self.support_mode.startswith("raw"):
            found.effective = found.affinity * (found.coverage**self.coverage_power if self.support_mode.endswith("coverage") else 1.0)
        return found

    def fit(self, df: DataFrame, key: str, features: Sequence[str] | None = None) -> Model:
        return self.fit_matrix(matrix(df, key, features))

    def fit_matrix(self, source: Matrix) -> Model:
        """Of a matrix that has been read, as by ``vector_matrix`` from an array column."""
        self.validate(source.width)
        g = self.geometry(source)
        found = self.supports(g)
        max_null = found.null_effective.max(axis=0)
        raw = self.support_mode.startswith("raw")
        limit = float("-inf") if raw else supports.threshold(max_null.tolist(), self.alpha)
        tail = lambda s: float((1 + (max_null >= s).sum()) / (len(max_null) + 1))
        adjusted = np.array([tail(s) for s in found.effective])
        label = residual.engine_label(self.residual_engine, source.width, g.n_pairs)
        novelty = (lambda chosen, rest: residual.residuals(g.gram, chosen, rest, label)) if self.use_residual else None
        path = greedy(found.effective, novelty, self.residual_power, None if self.n_features == "auto" else int(self.n_features), limit)
        forced = not path and self.n_features == "auto" and not self.allow_empty
        if forced:
            j = int(found.effective.argmax())
            path = [(j, 1.0, float(found.effective[j]))]
        steps = [
            {
                "step": k, "feature_index": j, "feature_name": source.features[j], "support_z": float(found.robust_z[j]), "sample_coverage": float(found.coverage[j]),
                "effective_support": float(found.effective[j]), "max_null_adjusted_p": float(adjusted[j]), "residual_novelty": float(r), "selection_score": float(s),
                "conservative_step_p": float(adjusted[j]) if forced else tail(s), "auto_threshold": limit if self.n_features == "auto" else None, "forced_selection": forced,
            }
            for k, (j, r, s) in enumerate(path, 1)
        ]
        return Model(source.features, [j for j, _, _ in path], steps, found, adjusted, limit, g, {"residual_engine": label, "n_pairs": g.n_pairs, "parameters": self.parameters()})

    def fit_transform(self, df: DataFrame, key: str, features: Sequence[str] | None = None) -> DataFrame:
        return self.fit(df, key, features).transform(df, key)


def greedy(score: np.ndarray, novelty: Callable | None, power: float, most: int | None, limit: float) -> list[tuple[int, float, float]]:
    """(feature, residual, score) of each step; ties go to the first feature.  Without ``most`` it ends below ``limit``."""
    path: list[tuple[int, float, float]] = []
    for _ in range(most if most is not None else len(score)):
        chosen = [j for j, _, _ in path]
        rest = [j for j in range(len(score)) if j not in chosen]
        left = novelty(chosen, rest) if novelty else np.ones(len(rest))
        total = score[rest] * left**power
        best = int(total.argmax())
        if most is None and total[best] < limit:
            break
        path.append((rest[best], float(left[best]), float(total[best])))
    return path
