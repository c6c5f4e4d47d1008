"""Rankers of features that need no fit of the geometry: variance, graph scores, spectra and rankings from outside.

Each returns a ``Ranking``.  Sums over rows, edges and pairs of rows are Spark jobs; what reaches the
driver has an entry for each feature.  Eigenvectors of a row graph or kernel come from ``spectra``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, tables
from ..functions.tables import kept
from . import blocks, neighbours, scaling, spectra
from .selector import ParameterError

EPS = 1e-12


@dataclass(frozen=True)
class Ranking:
    """Scores of all features, and the first ``k`` of them in order; ties go to the earlier column."""

    features: tuple[str, ...]
    scores: tuple[float, ...]
    selected: tuple[int, ...]
    source: str = "native_or_local"

    @property
    def support_mask(self) -> list[bool]:
        return [j in set(self.selected) for j in range(len(self.features))]

    def get_support(self, indices: bool = False) -> list:
        return list(self.selected) if indices else self.support_mask

    def transform(self, df: DataFrame, *keep: str) -> DataFrame:
        """The selected columns in column order."""
        return df.select(*keep, *(self.features[j] for j in sorted(self.selected)))

    def frame(self, spark: SparkSession) -> DataFrame:
        """feature, score, rank (null: not selected)."""
        place = {j: r for r, j in enumerate(self.selected, 1)}
        return spark.createDataFrame([(c, float(self.scores[j]), place.get(j)) for j, c in enumerate(self.features)], "feature string, score double, rank int")


def top_k(features: Sequence[str], scores: Sequence[float], k: int, higher_is_better: bool = True, source: str = "native_or_local") -> Ranking:
    if not 1 <= k <= len(features):
        raise ParameterError(f"k must lie in 1..{len(features)}")
    order = sorted(range(len(features)), key=lambda j: (-scores[j] if higher_is_better else scores[j], j))
    return Ranking(tuple(features), tuple(map(float, scores)), tuple(order[:k]), source)


def external_ranking(features: Sequence[str], ranking: Sequence[int], k: int, source: str = "external") -> Ranking:
    """A ranking made elsewhere: indices of all features, the best first."""
    if sorted(ranking) != list(range(len(features))):
        raise ParameterError(f"the ranking must be a permutation of 0..{len(features) - 1}")
    scores = np.empty(len(features))
    scores[list(ranking)] = np.arange(len(features), 0, -1)
    return top_k(features, scores.tolist(), k, source=source)


def constants_last(features: Sequence[str], live: Sequence[str], order: Sequence[int]) -> list[int]:
    """A ranking of the columns that vary (indices into ``live``), over all columns: constant ones last, in column order."""
    place = {c: j for j, c in enumerate(features)}
    found = [place[live[i]] for i in order]
    return found + [j for j in range(len(features)) if j not in set(found)]


def max_variance(df: DataFrame, features: Sequence[str], k: int) -> Ranking:
    got = df.agg(*(F.var_pop(c).alias(f"v{i}") for i, c in enumerate(features))).first()
    return top_k(features, list(got), k)


def laplacian(df: DataFrame, key: str, features: Sequence[str], k: int, n_neighbors: int = 5, t: float | None = None) -> Ranking:
    """Small scores first: columns that are smooth over the graph of nearest rows."""
    z = scaling.mean_sd(df, features).apply(df)
    graph = neighbours.heat_graph(neighbours.nearest(z, key, features, n_neighbors), t)
    score = {r.feature: r.score for r in neighbours.laplacian_scores(graph, z, key, features).collect()}
    return top_k(features, [score[c] for c in features], k, higher_is_better=False)


class KernelProduct(blocks.Meeting):
    """The kernel exp(-gamma * d2) of rows (the first ``features`` columns) times their other columns."""

    schema = "a long, s array<double>"

    def __init__(self, gamma: float, features: int) -> None:
        self.gamma, self.features = gamma, features

    def prepare(self, block, ids, v):
        x, y = v[:, : self.features], np.ascontiguousarray(v[:, self.features :])
        square = (x * x).sum(1)
        # asks @ other.T is -gamma * d2
        asks = np.column_stack([2 * self.gamma * x, -self.gamma * square, np.full(len(x), -self.gamma)])
        return SimpleNamespace(ids=ids, asks=asks, other=np.column_stack([x, np.ones(len(x)), square]), y=y)

    def begin(self, own):
        return SimpleNamespace(ids=own.ids, asks=own.asks, sums=np.zeros(own.y.shape))

    def meet(self, state, other, same):
        for first in range(0, len(state.ids), blocks.ASKED):
            some = slice(first, first + blocks.ASKED)
            k = state.asks[some] @ other.other.T
            np.exp(np.minimum(k, 0, out=k), out=k)
            state.sums[some] += k @ other.y

    def finish(self, state):
        return pa.RecordBatch.from_arrays([pa.array(state.ids), arrays.listed(state.sums)], ["a", "s"])


def kernel_product(rows: DataFrame, gamma: float, features: int) -> DataFrame:
    """a, s: the kernel exp(-gamma * d2) of all rows (a, v, y) times the array y, found now and written."""
    table = blocks.packed(rows.select(F.col("a").cast("long").alias("a"), F.concat("v", "y").alias("v")))
    sums = tables.written(blocks.met(table, KernelProduct(gamma, features)))
    tables.discard(table)
    return sums


def kernel_sums(df: DataFrame, key: str, features: Sequence[str], gamma: float, columns: bool = True) -> DataFrame:
    """key, d (row sum of the kernel exp(-gamma * d2), itself included) and, if ``columns``, kx (kernel times columns, an array)."""
    v = F.array(*(F.col(c).cast("double") for c in features))
    one = F.array(F.lit(1.0))
    rows = df.select(F.col(key).alias("a"), v.alias("v"), (F.concat(one, v) if columns else one).alias("y"))
    found = kernel_product(rows, gamma, len(features))
    return found.select(F.col("a").alias(key), F.col("s")[0].alias("d"), *([F.slice("s", 2, len(features)).alias("kx")] if columns else []))


def spec(df: DataFrame, key: str, features: Sequence[str], k: int, gamma: float = 1.0, style: int = 0, standardize: bool = False) -> Ranking:
    """Spectral ranking over the kernel of all rows, larger scores first.

    style -1 is q = z'Lz / z'Dz and style 0 divides it by what is left of z beside the constant direction: both come from sums,
    without eigenvectors (all pairs of rows are met, in blocks).  style m of 2 or more weighs the share of z along each of the m - 1
    smoothest directions beside the constant one by 2 less its eigenvalue, and turns the sign, since less is better there.  Columns
    without mass score -inf."""
    if style < -1 or style == 1:
        raise ParameterError("style: -1, 0, or 2 and more")
    z = scaling.mean_sd(df, features).apply(df) if standardize else df.select(key, *(F.col(c).cast("double").alias(c) for c in features))
    if style >= 2:
        return top_k(features, smoothness(z, key, features, gamma, style), k)
    met = z.join(kernel_sums(z, key, features, gamma), key)
    aggs = [F.sum("d").alias("total")]
    for i, c in enumerate(features):
        x = F.col(c)
        aggs += [F.sum(F.col("d") * x * x).alias(f"m{i}"), F.sum(F.col("d") * x).alias(f"s{i}"), F.sum(x * F.col("kx")[i]).alias(f"w{i}")]
    got = met.agg(*aggs).first()
    scores = []
    for i in range(len(features)):
        mass = got[f"m{i}"]
        if mass <= 1e-28:
            scores.append(float("-inf"))
            continue
        q = (mass - got[f"w{i}"]) / mass
        scores.append(q if style == -1 else q / (1 - got[f"s{i}"] ** 2 / (mass * got.total) + EPS))
    return top_k(features, scores, k)


#: Columns that the search for a kernel's directions starts from, at most: a pass multiplies them all.
KERNEL_START = 128


def smoothness(z: DataFrame, key: str, features: Sequence[str], gamma: float, most: int) -> list[float]:
    """Scores of spectral style ``most``: eigenpairs of the scaled kernel, which is multiplied in blocks and never stored."""
    v = F.array(*(F.col(c) for c in features))
    rows = z.select(F.col(key).alias("a"), v.alias("v")).persist()
    n = rows.count()
    degree = kernel_product(rows.select("a", "v", F.array(F.lit(1.0)).alias("y")), gamma, len(features)).select("a", F.col("s")[0].alias("d"))
    placed = kept(rows.join(degree, "a").withColumn("root", F.sqrt(F.greatest("d", F.lit(EPS)))))
    rows.unpersist()
    roots = placed.select("a", "root")

    sums: list[DataFrame] = []

    def apply(y: DataFrame) -> DataFrame:
        while sums:  # the step before is written, so nothing reads them any more
            tables.discard(sums.pop())
        scaled = F.transform("y", lambda x: x / F.col("root"))
        sums.append(kernel_product(placed.join(y, "a").select("a", "v", scaled.alias("y")), gamma, len(features)))
        return sums[0].join(roots, "a").select("a", F.transform("s", lambda x: x / F.col("root")).alias("z"))

    # The smoothest directions of a kernel are close to the columns themselves, beside the constant one.
    nodes, count = placed.select("a"), min(max(most, 2), n)
    if len(features) <= KERNEL_START:
        spread = scaling.mean_sd(z, features)
        start = F.array(F.col("root"), *((F.col("v")[k] - at) / by * F.col("root") for k, (at, by) in enumerate(zip(spread.location, spread.scale, strict=True))))
        nodes = placed.select("a", start.alias("start"))
    values, y = spectra.leading(apply, nodes, count)
    weighted = placed.join(y, "a").select("y", F.transform("v", lambda x: x * F.col("root")).alias("f"))
    along = spectra.products(weighted, "y", "f", len(values), len(features))
    mass = arrays.column_sums(weighted, "f", len(features), lambda f: f * f)
    scores = -(along[1:] ** 2 * (1 + values[1:])[:, None]).sum(0)  # 2 - (1 - value)
    return [float(s / m) if m > 1e-28 else float("-inf") for s, m in zip(scores, mass, strict=True)]


#: Rounds of four applications of a graph's operator.
ROUNDS = spectra.STEPS // 4


def smallest_eigenpairs(graph: DataFrame, count: int, rounds: int = ROUNDS, seed: int = 0, tolerance: float = spectra.TOLERANCE) -> tuple[np.ndarray, DataFrame]:
    """Values, rising, and vectors (a, y: an array) of the ``count`` smallest eigenvalues of I - D^-1/2 W D^-1/2 of a graph (a, b, w): a step
    is one join of the edges with the current block of vectors."""
    degree = graph.groupBy("a").agg(F.sum("w").alias("d"))
    scaled = graph.join(degree.withColumnRenamed("d", "da"), "a").join(degree.select(F.col("a").alias("b"), F.col("d").alias("db")), "b")
    edges = kept(scaled.select("a", "b", (F.col("w") / F.sqrt(F.greatest(F.col("da") * F.col("db"), F.lit(EPS * EPS)))).alias("w")))

    def apply(y: DataFrame) -> DataFrame:
        sums = edges.join(y.select(F.col("a").alias("b"), "y"), "b").groupBy("a").agg(*(F.sum(F.col("w") * F.get("y", F.lit(k))).alias(f"s{k}") for k in range(count + 2)))
        return sums.select("a", F.filter(F.array(*(f"s{k}" for k in range(count + 2))), lambda x: x.isNotNull()).alias("z"))

    values, y = spectra.leading(apply, degree.select("a"), count, 4 * rounds, tolerance, seed)
    return 1 - values, y


def eigengap(values: Sequence[float], least: int, most: int) -> int:
    """The number of clusters before the widest gap of sorted eigenvalues."""
    places = range(least, min(most, len(values) - 1) + 1)
    return max(places, key=lambda k: (values[k] - values[k - 1], -k)) if len(places) else 2


#: Residuals at which eigenvalues (whose error is the square of it) and vectors are good enough for a count and for weights.
FOR_VALUES, FOR_VECTORS = 1e-3, 1e-6


def spectral_clusters(df: DataFrame, key: str, features: Sequence[str], n_neighbors: int = 7, least: int = 2, most: int = 10, rounds: int = ROUNDS) -> int:
    """Estimated from the columns alone, so that no label count is needed."""
    n = df.count()
    upper = min(most, n - 2)
    if n < 4 or upper < 2:
        return 2
    z = scaling.mean_sd(df, features).apply(df)
    values, _ = smallest_eigenpairs(neighbours.heat_graph(neighbours.nearest(z, key, features, n_neighbors)), min(upper + 1, n - 1), rounds, tolerance=FOR_VALUES)
    return eigengap(values.tolist(), min(max(least, 2), upper), upper)


def lasso(gram: np.ndarray, cross: np.ndarray, alpha: float, sweeps: int = 5000, tol: float = 1e-10) -> np.ndarray:
    """Minimiser of |y - Xb|^2 / 2 + alpha * |b|_1 from X'X and X'y (both divided by the rows), by coordinate descent."""
    b = np.zeros(len(cross))
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(b)):
            if gram[j, j] <= EPS:
                continue
            rest = cross[j] - gram[j] @ b + gram[j, j] * b[j]
            new = np.sign(rest) * max(abs(rest) - alpha, 0) / gram[j, j]
            moved, b[j] = max(moved, abs(new - b[j])), new
        if moved <= tol:
            break
    return b


def mcfs(df: DataFrame, key: str, features: Sequence[str], k: int, clusters: int | None = None, n_neighbors: int = 5, alpha: float = 0.01, most: int = 10, rounds: int = ROUNDS) -> Ranking:
    """Columns that explain the leading spectral coordinates sparsely: the largest absolute lasso weight over the
    coordinates.  ``clusters``: their number, or None for the eigengap's."""
    if clusters is not None and clusters < 2:
        raise ParameterError("clusters must be 2 or more")
    n, z = df.count(), scaling.mean_sd(df, features).apply(df).persist()
    graph = kept(neighbours.heat_graph(neighbours.nearest(z, key, features, n_neighbors)))
    upper = min(most, n - 2)
    found = clusters or 2
    if clusters is None and n >= 4 and upper >= 2:
        values, _ = smallest_eigenpairs(graph, min(upper + 1, n - 1), rounds, tolerance=FOR_VALUES)
        found = eigengap(values.tolist(), 2, upper)
    width = min(max(found + 1, 2), n - 1)
    _, y = smallest_eigenpairs(graph, width, rounds, tolerance=FOR_VECTORS)
    used = list(range(1, min(width, found + 1)))
    joined = z.join(y.withColumnRenamed("a", key), key).select(F.array(*features).alias("y"), F.concat(F.array(*features), F.array(*(F.col("y")[c] for c in used))).alias("z"))
    p = len(features)
    wide = p + len(used)
    sums = joined.select(F.concat("z").alias("y"), F.col("z"))
    products = spectra.products(sums, "y", "z", wide, wide) / n
    means = np.array(joined.agg(*(F.avg(F.col("z")[i]) for i in range(wide))).first())
    centred = products - np.outer(means, means)
    weights = [np.abs(lasso(centred[:p, :p], centred[:p, p + c], alpha)) for c in range(len(used))]
    return top_k(features, np.max(weights, axis=0).tolist() if weights else np.diag(centred)[:p].tolist(), k)
