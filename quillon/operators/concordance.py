"""Selectors that rank by more than effective support: fused with balanced-gap evidence, or with how well a feature's geometry
holds when blocks of rows are left out.  Both keep the residual step of the geometry selector."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import positions, shuffled
from . import evidence, residual
from . import support as supports
from .selector import Geometry, GeometrySelector, Model, ParameterError, greedy

FUSED_PATH = "step int, feature_index int, feature_name string, structural_rank double, other_rank double, fused_relevance double, residual_novelty double, selection_score double"


def block_of(position: Column, n: int, blocks: int) -> Column:
    """Consecutive blocks of positions 0..n-1; the first n % blocks have one more."""
    size, more = n // blocks, n % blocks
    wide = more * (size + 1)
    return F.when(position < wide, F.floor(position / (size + 1))).otherwise(more + F.floor((position - wide) / max(size, 1))).cast("int")


def row_blocks(rows: DataFrame, n: int, blocks: int, seed: int) -> DataFrame:
    """key, pos, block: rows (key, pos) in a random order of the keys, cut into blocks."""
    key = next(c for c in rows.columns if c != "pos")
    order = positions(rows.select(key, "pos").withColumn("_h", shuffled("block", seed, key)), "_h", key, name="_place")
    return order.select(key, "pos", block_of(F.col("_place"), n, blocks).alias("block"))


@dataclass(frozen=True)
class Concordance:
    """One entry for each feature; folds: fold, feature."""

    lower: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    folds: np.ndarray


def fold_scores(g: Geometry, blocks: DataFrame, n_blocks: int, power: float) -> DataFrame:
    """fold, feature, affinity, coverage, raw: from the pairs that touch no row of the block left out."""
    features, n = g.source.features, g.source.rows
    sizes = {r.block: r.n for r in blocks.groupBy("block").agg(F.count("*").alias("n")).collect()}  # a row for each block
    side = lambda c: blocks.select(F.col("pos").alias(c), F.col("block").alias(f"b{c}"))
    placed = g.profiles.join(side("i"), "i").join(side("j"), "j")
    every = placed.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).where("fold <> bi and fold <> bj").select("fold", "pair_id", "i", "j", *features)
    counts = {r.fold: r.n for r in every.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    if min(counts.get(b, 0) for b in range(n_blocks)) < max(10, len(features)):
        raise ParameterError("too few pairs are left in a fold")
    mass = every.groupBy("fold").agg(*(F.sum(c).alias(f"_m{k}") for k, c in enumerate(features)))
    own = every.join(F.broadcast(mass), "fold")  # a row for each fold
    p = own.select("fold", *((F.col(c) / (F.col(f"_m{k}") + EPS)).alias(f"_p{k}") for k, c in enumerate(features)))
    total = p.withColumn("_total", sum((F.col(f"_p{k}") for k in range(1, len(features))), F.col("_p0")))
    share = float(max(len(features) - 1, 1))
    # sqrt(p * rest / (sum(rest) + eps)): the sum of a fold can be divided out at the end.
    rest = lambda k: F.greatest((F.col("_total") - F.col(f"_p{k}")) / share, F.lit(0.0))
    sums = total.groupBy("fold").agg(*(F.sum(F.sqrt(F.col(f"_p{k}") * rest(k))).alias(f"_a{k}") for k in range(len(features))), *(F.sum(rest(k)).alias(f"_r{k}") for k in range(len(features))))
    affinity = sums.select("fold", *((F.col(f"_a{k}") / F.sqrt(F.col(f"_r{k}") + EPS)).alias(c) for k, c in enumerate(features)))
    whole = supports.coverages(every, features, 1, ["fold"])
    rows = F.coalesce(*(F.when(F.col("fold") == b, F.lit(float(n - size))) for b, size in sizes.items()))
    coverage = whole.select("fold", *((F.col(c) / rows).alias(c) for c in features))
    both = supports.unpivoted(affinity, features, "affinity", ["fold"]).join(supports.unpivoted(coverage, features, "coverage", ["fold"]), ["fold", "feature"])
    return both.withColumn("raw", F.col("affinity") * F.pow("coverage", F.lit(power)))


EPS = 1e-12


def jackknife(g: Geometry, n_blocks: int = 5, power: float = 2.0, seed: int = 0) -> Concordance:
    """Ranks of all features in every fold; their median less 1.4826 times their deviation, within 0..1."""
    if not 3 <= n_blocks < g.source.rows:
        raise ParameterError("n_blocks must be 3 or more and fewer than the rows")
    blocks = row_blocks(g.source.data.select(g.source.key, "pos"), g.source.rows, n_blocks, seed)
    place = {c: k for k, c in enumerate(g.source.features)}
    raw = np.zeros((n_blocks, len(place)))
    for r in fold_scores(g, blocks, n_blocks, power).collect():  # blocks * features
        raw[r.fold, place[r.feature]] = r.raw
    folds = np.array([evidence.rank01(x) for x in raw])
    centre = np.median(folds, axis=0)
    spread = np.median(np.abs(folds - centre), axis=0)
    return Concordance(np.clip(centre - 1.4826 * spread, 0, 1), centre, spread, folds)


def gap_evidence(g: Geometry, least_share: float = 0.1, windows: Sequence[int] = (2, 4, 8)) -> np.ndarray:
    """Balanced-gap evidence of each scaled column."""
    return evidence.balanced_gaps(g.z.select("pos", "v"), g.source.width, g.source.rows, least_share, windows)


@dataclass
class FusedModel(Model):
    structural: np.ndarray | None = None
    other: np.ndarray | None = None
    fused: np.ndarray | None = None

    def path_frame(self, spark: SparkSession) -> DataFrame:
        names = [x.split()[0] for x in FUSED_PATH.split(", ")]
        return spark.createDataFrame([tuple(p[c] for c in names) for p in self.path], FUSED_PATH)


@dataclass
class FusedSelector:
    """A fixed number of features by (1 - weight) * rank of effective support + weight * another rank, times
    residual ** residual_power.  ``kind``: "gaps" (balanced-gap evidence) or "concordance"; the latter with weight 0
    keeps the order of effective support and lets concordance decide between scores within ``tie_tolerance`` of the best."""

    base: GeometrySelector
    kind: str = "gaps"
    weight: float = 0.5
    tie_tolerance: float = 0.1
    n_blocks: int = 5
    least_share: float = 0.1
    windows: tuple[int, ...] = (2, 4, 8)

    def validate(self) -> None:
        rules = [
            (self.base.n_features != "auto", "fused selectors need a fixed n_features"),
            (self.kind in ("gaps", "concordance"), "kind: gaps or concordance"),
            (0 <= self.weight <= 1, "weight must lie between 0 and 1"),
            (0 <= self.tie_tolerance < 1, "tie_tolerance must lie in [0, 1)"),
            (0 < self.least_share < 0.5, "least_share must lie between 0 and 0.5"),
        ]
        for good, message in rules:
            if not good:
                raise ParameterError(message)

    def fit(self, df: DataFrame, key: str, features: Sequence[str] | None = None) -> FusedModel:
        self.validate()
        k = int(self.base.n_features)
        model = replace(self.base, n_features=k).fit(df, key, features)
        g, effective = model.geometry, model.support.effective
        if self.kind == "gaps":
            lower = gap_evidence(g, self.least_share, self.windows)
            other = evidence.rank01(lower)
        else:
            other = lower = jackknife(g, self.n_blocks, self.base.coverage_power, self.base.seed).lower
        structural = evidence.rank01(effective)
        fused = (1 - self.weight) * structural + self.weight * other
        novelty = (lambda chosen, rest: residual.residuals(g.gram, chosen, rest, model.info["residual_engine"])) if self.base.use_residual else None
        if self.kind == "concordance" and self.weight == 0:
            path = greedy_with_ties(effective, lower, novelty, self.base.residual_power, k, self.tie_tolerance)
        else:
            path = greedy(fused, novelty, self.base.residual_power, k, float("-inf"))
        steps = [
            {"step": s, "feature_index": j, "feature_name": model.features[j], "structural_rank": float(structural[j]), "other_rank": float(other[j]), "fused_relevance": float(fused[j]), "residual_novelty": r, "selection_score": score}
            for s, (j, r, score) in enumerate(path, 1)
        ]
        return FusedModel(model.features, [j for j, _, _ in path], steps, model.support, model.adjusted_p, model.threshold, g, model.info, structural, other, fused)


def greedy_with_ties(score: np.ndarray, second: np.ndarray, novelty: Callable | None, power: float, most: int, tolerance: float) -> list[tuple[int, float, float]]:
    """As ``greedy``, but of the scores within ``tolerance`` of the best that with the highest ``second`` is taken, then
    the highest score, then the first."""
    path: list[tuple[int, float, float]] = []
    for _ in range(most):
        chosen = [j for j, _, _ in path]
        rest = [j for j in range(len(score)) if j not in chosen]
        left = novelty(chosen, rest) if novelty else np.ones(len(rest))
        total = score[rest] * left**power
        best = total.max()
        near = np.flatnonzero(total >= best * (1 - tolerance)) if best > 0 and tolerance > 0 else np.array([total.argmax()])
        at = max(near.tolist(), key=lambda i: (second[rest[i]], total[i], -i))
        path.append((rest[at], float(left[at]), float(total[at])))
    return path
