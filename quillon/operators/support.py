"""Permutation-calibrated support of features.

The relational engine states the null as joins and grouped sums; its cost is draws * pairs rows.  The Arrow
engine hands one feature to a task, with pairs, bank and mean profile broadcast; it is taken where these
fit ``BROADCAST_BYTES``, which is checked.  Both give the same numbers.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-12
BROADCAST_BYTES = 64 << 20


@dataclass
class Support:
    """One entry for each feature; null_effective: feature, draw."""

    affinity: np.ndarray
    coverage: np.ndarray
    null_median: np.ndarray
    null_scale: np.ndarray
    robust_z: np.ndarray
    effective: np.ndarray
    null_effective: np.ndarray


def column_mass(geometry: DataFrame, features: Sequence[str]) -> list[float]:
    got = geometry.agg(*(F.sum(c).alias(f"m{k}") for k, c in enumerate(features))).first()
    return [got[f"m{k}"] for k in range(len(features))]


def profile(feature: str, mass: float) -> Column:
    return F.col(feature) / (F.lit(mass) + F.lit(EPS))


def total_profile(features: Sequence[str], mass: Sequence[float]) -> Column:
    return sum((profile(c, m) for c, m in zip(features, mass, strict=True)), F.lit(0.0))


def rest_profiles(geometry: DataFrame, features: Sequence[str]) -> DataFrame:
    """pair_id, i, j, and for each feature the normalised mean profile of all others."""
    mass = column_mass(geometry, features)
    total = geometry.withColumn("_total", total_profile(features, mass))
    raw = total.select("pair_id", "i", "j", *(((F.col("_total") - profile(c, m)) / F.lit(float(max(len(features) - 1, 1)))).alias(c) for c, m in zip(features, mass, strict=True)))
    sums = column_mass(raw, features)
    return raw.select("pair_id", "i", "j", *(profile(c, s).alias(c) for c, s in zip(features, sums, strict=True)))


def coverages(pairs: DataFrame, features: Sequence[str], n: int, by: Sequence[str] = ()) -> DataFrame:
    """For each group: exp of the entropy of endpoint mass over rows, divided by n."""
    ends = pairs.select(*by, *features, F.explode(F.array("i", "j")).alias("_row")).groupBy(*by, "_row").agg(*(F.sum(c).alias(c) for c in features))
    mass = ends.groupBy(*by).agg(*(F.sum(c).alias(f"_t{k}") for k, c in enumerate(features)))
    shared = ends.join(mass, list(by)) if by else ends.crossJoin(mass)  # without groups the other side is one row
    terms = [(F.sum(-(F.col(c) / (F.col(f"_t{k}") + EPS)) * F.log(F.col(c) / (F.col(f"_t{k}") + EPS) + EPS))).alias(c) for k, c in enumerate(features)]
    return shared.groupBy(*by).agg(*terms).select(*by, *((F.exp(c) / F.lit(float(n))).alias(c) for c in features))


def affinities(geometry: DataFrame, rest: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """For each group: sum of sqrt(profile * rest); ``geometry`` holds raw profiles."""
    other = rest.select("pair_id", *(F.col(c).alias(f"_r{k}") for k, c in enumerate(features)))
    joined = geometry.join(other, "pair_id")
    sums = [F.sum(F.sqrt(F.col(c) * F.col(f"_r{k}"))).alias(f"_s{k}") for k, c in enumerate(features)]
    mass = [F.sum(c).alias(f"_m{k}") for k, c in enumerate(features)]
    return joined.groupBy(*by).agg(*sums, *mass).select(*by, *((F.col(f"_s{k}") / F.sqrt(F.col(f"_m{k}") + EPS)).alias(c) for k, c in enumerate(features)))


def null_geometry(bank: DataFrame, pairs: DataFrame, scaled: DataFrame, features: Sequence[str]) -> DataFrame:
    """b, pair_id, i, j and the profile of each feature with its rows permuted."""
    z = bank.join(scaled.select(F.col("pos").alias("src"), *features), "src").drop("src")
    a = z.select("b", F.col("pos").alias("i"), *(F.col(c).alias(f"_a{k}") for k, c in enumerate(features)))
    b = z.select("b", F.col("pos").alias("j"), *(F.col(c).alias(f"_b{k}") for k, c in enumerate(features)))
    joined = a.join(pairs, "i").join(b, ["b", "j"])
    return joined.select("b", "pair_id", "i", "j", *(((F.col(f"_a{k}") - F.col(f"_b{k}")) * (F.col(f"_a{k}") - F.col(f"_b{k}"))).alias(c) for k, c in enumerate(features)))


def null_statistics(bank: DataFrame, pairs: DataFrame, scaled: DataFrame, rest: DataFrame, features: Sequence[str], n: int) -> DataFrame:
    """b, feature, affinity, coverage of the permuted features."""
    permuted = null_geometry(bank, pairs, scaled, features).persist()  # read for both sums
    aff = affinities(permuted, rest, features, ["b"])
    cov = coverages(permuted, features, n, ["b"])
    return unpivoted(aff, features, "affinity", ["b"]).join(unpivoted(cov, features, "coverage", ["b"]), ["b", "feature"])


def unpivoted(wide: DataFrame, features: Sequence[str], name: str, by: Sequence[str] = ()) -> DataFrame:
    return wide.unpivot(list(by), list(features), "feature", name)


def calibrate(affinity: np.ndarray, coverage: np.ndarray, null_affinity: np.ndarray, null_coverage: np.ndarray, power: float) -> Support:
    """Null median and 1.4826 MAD (else sample deviation, else eps) of the affinity; z clipped at 0 for both."""
    median = np.median(null_affinity, axis=1)
    scale = 1.4826 * np.median(np.abs(null_affinity - median[:, None]), axis=1)
    spread = null_affinity.std(axis=1, ddof=1) if null_affinity.shape[1] > 1 else np.zeros(len(median))
    scale = np.maximum(np.where(scale <= EPS, spread, scale), EPS)
    z = np.maximum((affinity - median) / scale, 0)
    null_z = np.maximum((null_affinity - median[:, None]) / scale[:, None], 0)
    return Support(affinity, coverage, median, scale, z, z * coverage**power, null_z * null_coverage**power)


def support_relational(geometry: DataFrame, pairs: DataFrame, scaled: DataFrame, bank: DataFrame, features: Sequence[str], n: int, power: float) -> Support:
    rest = rest_profiles(geometry, features).persist()
    aff, cov = affinities(geometry, rest, features).first(), coverages(geometry, features, n).first()
    rows = null_statistics(bank, pairs, scaled, rest, features, n).orderBy("b").collect()  # draws * features
    index = {c: k for k, c in enumerate(features)}
    draws = 1 + max(r.b for r in rows)
    null = np.zeros((2, len(features), draws))
    for r in rows:
        null[:, index[r.feature], r.b] = r.affinity, r.coverage
    rest.unpersist()
    return calibrate(np.array([aff[c] for c in features]), np.array([cov[c] for c in features]), *null, power)


def fits_arrow(n: int, pairs: int, draws: int) -> bool:
    """Do bank (20 bytes a row on the driver, 4 when sent) and pairs fit?"""
    return 20 * n * draws + 24 * pairs <= BROADCAST_BYTES


def support_arrow(geometry: DataFrame, scaled: DataFrame, bank: DataFrame, features: Sequence[str], n: int, power: float) -> Support:
    """Collects pairs, mean profile and bank (their sizes are checked by ``fits_arrow``) and broadcasts them;
    features are dealt to tasks as arrays."""
    context = geometry.sparkSession.sparkContext
    mass = column_mass(geometry, features)
    t = geometry.select("i", "j", total_profile(features, mass).alias("total")).toArrow()
    drawn = bank.toArrow()
    orders = np.empty((int(np.max(drawn.column("b").to_numpy())) + 1, n), np.int32)
    orders[drawn.column("b").to_numpy(), drawn.column("pos").to_numpy()] = drawn.column("src").to_numpy()
    shared = context.broadcast((t.column("i").to_numpy(), t.column("j").to_numpy(), t.column("total").to_numpy(), orders))
    width = len(features)
    long = scaled.select("pos", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(c).alias("z")) for k, c in enumerate(features)))).alias("x")).select("x.k", "pos", "x.z")

    def run(table):
        i, j, total, orders = shared.value
        z = np.empty(n)
        z[table.column("pos").to_numpy()] = table.column("z").to_numpy()
        own = profile_of(z, i, j)
        rest = (total - own / (own.sum() + EPS)) / max(width - 1, 1)
        rest /= rest.sum() + EPS
        stats = [statistic(own, rest, i, j, n)] + [statistic(profile_of(z[o], i, j), rest, i, j, n) for o in orders]
        return pa.table({"k": table.column("k")[:1], "affinity": [[s[0] for s in stats]], "coverage": [[s[1] for s in stats]]})

    got = long.repartition(width, "k").groupBy("k").applyInArrow(run, "k int, affinity array<double>, coverage array<double>").orderBy("k").collect()
    aff, cov = np.array([r.affinity for r in got]), np.array([r.coverage for r in got])
    return calibrate(aff[:, 0], cov[:, 0], aff[:, 1:], cov[:, 1:], power)


def profile_of(z: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return (z[i] - z[j]) ** 2


def statistic(g: np.ndarray, rest: np.ndarray, i: np.ndarray, j: np.ndarray, n: int) -> tuple[float, float]:
    """Affinity and coverage of one profile."""
    affinity = np.sqrt(g / (g.sum() + EPS) * rest).sum()
    mass = np.bincount(i, g, n) + np.bincount(j, g, n)
    mass /= mass.sum() + EPS
    return float(affinity), float(np.exp(-(mass * np.log(mass + EPS)).sum()) / n)


def threshold(max_null: Sequence[float], alpha: float) -> float:
    """The order statistic at 0-based place ceil((B - 1)(1 - alpha)) of the largest null value of each draw."""
    ordered = sorted(max_null)
    return ordered[min(len(ordered) - 1, math.ceil((len(ordered) - 1) * (1 - alpha) - 1e-9))]
