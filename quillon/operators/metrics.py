"""Metrics of a selection or a clustering: agreement with labels, silhouette, redundancy of geometry, effective rank.

Contingency tables, sums and moments are aggregates; only the silhouette meets all pairs of rows, in blocks."""

from __future__ import annotations

from collections.abc import Sequence
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, tables
from . import blocks, scaling

EPS = 1e-12
AGREEMENT = "ari double, nmi double"


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """ari (adjusted Rand index) and nmi (over the mean entropy) of two labellings, from their contingency table."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    rows, columns = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    total = F.sum("n")
    by_cell = cells.agg(total.alias("t"), pairs("n").alias("both"))
    by_row, by_column = rows.agg(pairs("na").alias("pa")), columns.agg(pairs("nb").alias("pb"))
    one = by_cell.join(by_row).join(by_column)  # one row each
    entropy = lambda c: -F.sum(F.col(c) / F.col("t") * F.log(F.col(c) / F.col("t")))
    wide = lambda d: d.join(F.broadcast(by_cell.select("t")))  # noqa: E731  one row
    ha, hb = wide(rows).agg(entropy("na").alias("ha")), wide(columns).agg(entropy("nb").alias("hb"))
    met = wide(cells.join(rows, cells["a"].eqNullSafe(rows["a"])).drop(rows["a"]).join(columns, cells["b"].eqNullSafe(columns["b"])))
    mutual = met.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"))
    every = one.join(ha).join(hb).join(mutual)
    expected = F.col("pa") * F.col("pb") / (F.col("t") * (F.col("t") - 1) / 2)
    mean = (F.col("pa") + F.col("pb")) / 2
    ari = F.when(mean == expected, 1.0).otherwise((F.col("both") - expected) / (mean - expected))
    half = (F.col("ha") + F.col("hb")) / 2
    return every.select(ari.alias("ari"), F.when(half <= EPS, 1.0).otherwise(F.greatest(F.lit(0.0), F.col("mi")) / half).alias("nmi"))


class ClusterDistances(blocks.Meeting):
    """Sums of distances to the rows of each cluster.  Rows end with the code of their cluster."""

    schema = "a long, c int, s array<double>"

    def __init__(self, clusters: int) -> None:
        self.clusters = clusters

    def prepare(self, block, ids, v):
        x, c = v[:, :-1], v[:, -1].astype(np.int32)
        square = (x * x).sum(1)
        asks = np.column_stack([-2 * x, square, np.ones(len(x))])  # asks @ other.T are squared distances
        return SimpleNamespace(ids=ids, c=c, asks=asks, other=np.column_stack([x, np.ones(len(x)), square]), member=(c[:, None] == np.arange(self.clusters)).astype(float))

    def begin(self, own):
        return SimpleNamespace(own=own, sums=np.zeros((len(own.ids), self.clusters)))

    def meet(self, state, other, same):
        for first in range(0, len(state.sums), blocks.ASKED):
            some = slice(first, first + blocks.ASKED)
            d = state.own.asks[some] @ other.other.T
            np.sqrt(np.maximum(d, 0, out=d), out=d)
            if same:
                d[state.own.ids[some, None] == other.ids] = 0
            state.sums[some] += d @ other.member

    def finish(self, state):
        return pa.RecordBatch.from_arrays([pa.array(state.own.ids), pa.array(state.own.c), arrays.listed(state.sums)], ["a", "c", "s"])


def silhouette(df: DataFrame, key: str, features: Sequence[str], cluster: str) -> float | None:
    """Mean over rows of (b - a) / max(a, b), Euclidean: a to the own cluster, b to the nearest other; 0 in a cluster of one; None
    with a single cluster.  A task keeps the sums of its blocks' rows by cluster."""
    sizes = {r[0]: r[1] for r in df.groupBy(cluster).count().collect()}  # a row for each cluster
    if len(sizes) < 2:
        return None
    names = sorted(sizes)
    code = F.array_position(F.array(*map(F.lit, names)), F.col(cluster)) - 1
    table = blocks.packed(df.select(F.col(key).cast("long").alias("a"), F.array(*(F.col(f).cast("double") for f in features), code.cast("double")).alias("v")))
    sums = blocks.met(table, ClusterDistances(len(names))).select("c", *(F.col("s")[k].alias(f"s{k}") for k in range(len(names))))
    own = F.coalesce(*(F.when(F.col("c") == k, F.col(f"s{k}") / F.lit(max(sizes[n] - 1, 1))) for k, n in enumerate(names)))
    nearest = F.least(*(F.when(F.col("c") != k, F.col(f"s{k}") / F.lit(sizes[n])) for k, n in enumerate(names)))
    lone = F.coalesce(*(F.when(F.col("c") == k, F.lit(sizes[n] == 1)) for k, n in enumerate(names)))
    both = sums.select(own.alias("own"), nearest.alias("near"), lone.alias("lone"))
    found = both.agg(F.avg(F.when(F.col("lone") | (F.greatest("own", "near") <= 0), 0.0).otherwise((F.col("near") - F.col("own")) / F.greatest("own", "near")))).first()[0]
    tables.discard(table)
    return found


def clusters(df: DataFrame, features: Sequence[str], k: int, seed: int = 0, restarts: int = 20) -> DataFrame:
    """With ``cluster``: k-means of the standardised columns, the best of the restarts."""
    z = scaling.mean_sd(df, features).apply(df)
    ready = VectorAssembler(inputCols=list(features), outputCol="_v").transform(z).persist()
    fits = [KMeans(k=k, seed=seed + r, featuresCol="_v", predictionCol="cluster").fit(ready) for r in range(restarts)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    return best.transform(ready).drop("_v")


def clustering_utility(df: DataFrame, key: str, label: str, selected: Sequence[str], k: int, seed: int = 0, restarts: int = 20) -> dict:
    """ari, nmi, silhouette of clusters in the selected columns; None without any."""
    if not selected:
        return {"ari": None, "nmi": None, "silhouette": None}
    found = clusters(df.select(key, label, *selected), selected, k, seed, restarts).persist()
    got = agreement(found, label, "cluster").first()
    return {"ari": got.ari, "nmi": got.nmi, "silhouette": silhouette(found, key, selected, "cluster")}


def geometry_redundancy(df: DataFrame, selected: Sequence[str]) -> float:
    """Mean cosine of the geometry profiles of the selected columns over all pairs of rows; 0 for fewer than two columns.

    Over all pairs, sums of products of squared differences are moments of the standardised columns, so one aggregate over
    the rows takes the place of the pairs: sum over i < j of (a_i - a_j)^2 (b_i - b_j)^2 is
    n * sum(a^2 b^2) + sum(a^2) * sum(b^2) + 2 * sum(ab)^2."""
    if len(selected) < 2:
        return 0.0
    z = scaling.mean_sd(df, selected).apply(df.select(*selected))
    k = len(selected)
    at = [(i, j) for i in range(k) for j in range(i, k)]
    x = [F.col(c) for c in selected]
    got = z.agg(F.count("*").alias("n"), *(f for i, j in at for f in (F.sum(x[i] * x[i] * x[j] * x[j]).alias(f"q{i}_{j}"), F.sum(x[i] * x[j]).alias(f"c{i}_{j}")))).first()
    s = {(i, j): got.n * got[f"q{i}_{j}"] + got[f"c{i}_{i}"] * got[f"c{j}_{j}"] + 2 * got[f"c{i}_{j}"] ** 2 for i, j in at}
    norm = lambda i: np.sqrt(max(s[i, i], 0.0)) + EPS
    return float(np.mean([s[i, j] / norm(i) / norm(j) for i, j in at if i < j]))


def effective_rank(df: DataFrame, selected: Sequence[str]) -> float | None:
    """exp of the entropy of the squared singular values of the standardised columns, over their number: their eigenvalues are
    those of the correlation matrix, which one aggregate gives.  None without columns, 1 for one."""
    k = len(selected)
    if k < 2:
        return 1.0 if k else None
    z = scaling.mean_sd(df, selected).apply(df.select(*selected))
    x = [F.col(c) for c in selected]
    got = z.agg(*(F.avg(x[i] * x[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k))).first()
    values = np.maximum(np.linalg.eigvalsh(np.array([[got[f"c{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])), 0)
    if values.sum() <= EPS:
        return 0.0
    q = values / values.sum()
    return float(np.exp(-(q * np.log(q + EPS)).sum()) / k)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """rho: the correlation of average ranks.  Ranks come from counts of values below, by range sorts, not from one task."""
    from ..functions.order import average_ranks

    x = df.select(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")).where("x is not null and y is not null")
    return average_ranks(average_ranks(x, "x", "rx"), "y", "ry").agg(F.corr("rx", "ry").alias("rho"))
