"""Rankers and evidence beside the geometry: variance, balanced gaps, rank fusion, substitution groups."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import order
from ..functions.order import positions
from ..functions.tables import kept

EPS = 1e-12


def variances(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature, variance (population), rank (1: largest, ties by place): one aggregate over the table."""
    wide = df.agg(*(F.var_pop(c).alias(c) for c in features))
    long = wide.unpivot([], list(features), "feature", "variance")
    place = F.array_position(F.array(*map(F.lit, features)), F.col("feature"))
    return long.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("variance"), place)).cast("int"))  # a row for each feature


def balanced_gap(df: DataFrame, column: str, key: str, least_share: float = 0.1, windows: Sequence[int] = (2, 4, 8)) -> DataFrame:
    """evidence: how far the widest balanced gap of the sorted values stands out from its neighbours.

    Sorted positions come from a range sort; gaps and their neighbours from shifted joins on the position, so no
    task holds all rows.  A gap's ratio is its width over the median of the positive gaps within w places on
    either side (floored at a quarter of the median positive gap); the least ratio over the windows
    counts, weighted by 4q(1 - q) for the share q below the gap.  Fewer than 12 rows, or a null, NaN or infinite value
    anywhere, give 0."""
    zero = df.sparkSession.createDataFrame([(0.0,)], "evidence double")
    x = df.select(key, F.col(column).cast("double").alias("x"))
    got = x.agg(F.count("*").alias("n"), F.count_if(F.col("x").isNull() | F.isnan("x") | (F.abs("x") == float("inf"))).alias("bad")).first()
    n = got.n
    if n < 12 or got.bad:
        return zero
    rows = positions(x, "x", key)
    after = rows.select((F.col("pos") - 1).alias("pos"), F.col("x").alias("next"))
    gaps = rows.join(after, "pos").select("pos", (F.col("next") - F.col("x")).alias("gap")).persist()
    positive = order.median(gaps.where(F.col("gap") > EPS), "gap")
    if positive is None:
        gaps.unpersist()
        return zero
    floor = max(0.25 * positive, EPS)
    widest = max(windows)
    low, high = max(1, int(np.ceil(least_share * n))), min(n - 1, int(np.floor((1 - least_share) * n)))
    cuts = gaps.where((F.col("pos") + 1 >= low) & (F.col("pos") + 1 <= high) & (F.col("gap") > EPS))
    near = gaps.where(F.col("gap") > EPS).select(F.col("pos").alias("at"), F.col("gap").alias("other"))
    shifts = cuts.select("pos", "gap", F.explode(F.sequence(F.lit(-widest), F.lit(widest))).alias("s")).where("s <> 0")
    met = shifts.withColumn("at", F.col("pos") + F.col("s")).join(near, "at")
    aggs = []
    for w in windows:
        inside = F.when(F.abs("s") <= w, F.col("other"))
        aggs += [F.median(inside).alias(f"m{w}"), F.count(inside).alias(f"c{w}")]
    each = met.groupBy("pos", "gap").agg(*aggs)
    ratios = F.least(*(F.when(F.col(f"c{w}") >= 2, F.col("gap") / F.greatest(F.col(f"m{w}"), F.lit(floor))) for w in windows))
    q = (F.col("pos") + 1) / F.lit(float(n))
    score = 4 * q * (1 - q) * F.log1p(F.greatest(F.lit(0.0), ratios - 1))
    return each.agg(F.coalesce(F.max(score), F.lit(0.0)).alias("evidence"))


#: Sorted values of a column that a task takes at a time; more than the neighbours that a gap looks at.
GAP_ROWS = 50_000


def gap_scores(place: np.ndarray, value: np.ndarray, own: np.ndarray, n: int, floor: float, cuts: tuple[int, int], windows: Sequence[int]) -> float:
    """The best score of the cuts behind the sorted values that are ``own``; the others are their neighbours."""
    gap, at = np.diff(value), place[:-1]
    usable = np.where((gap > EPS) & (np.diff(place) == 1), gap, np.nan)
    here = np.flatnonzero(own[:-1] & ~np.isnan(usable) & (at + 1 >= cuts[0]) & (at + 1 <= cuts[1]))
    if not len(here):
        return 0.0
    widest = max(windows)
    padded = np.concatenate([np.full(widest, np.nan), usable, np.full(widest, np.nan)])
    ratio = np.full(len(here), np.inf)
    for w in windows:
        near = np.sort(np.stack([padded[here + widest + s] for s in range(-w, w + 1) if s]), axis=0)  # NaN sorts last
        count = (~np.isnan(near)).sum(0)
        column = np.arange(len(here))
        middle = (near[np.maximum(count - 1, 0) // 2, column] + near[np.minimum(count // 2, len(near) - 1), column]) / 2
        ratio = np.where(count >= 2, np.minimum(ratio, usable[here] / np.maximum(middle, floor)), ratio)
    q = (at[here] + 1) / n
    return float(np.where(np.isinf(ratio), 0.0, 4 * q * (1 - q) * np.log1p(np.maximum(0.0, ratio - 1))).max())


def balanced_gaps(rows: DataFrame, width: int, n: int, least_share: float = 0.1, windows: Sequence[int] = (2, 4, 8)) -> np.ndarray:
    """``balanced_gap`` of all components of v at once (rows: pos, v; n of them, all finite).

    One range sort of (component, value) numbers all values; a task then has a run of one component's values and the few
    before and after it, so borders between tasks change nothing."""
    if n < 12:
        return np.zeros(width)
    widest = max(windows) + 1
    long = rows.select("pos", F.posexplode("v").alias("k", "x")).withColumnRenamed("pos", "row")
    placed = positions(long, "k", "x", "row").select("k", "x", (F.col("pos") - F.col("k") * F.lit(n)).alias("pos"))
    blocks = F.array_distinct(F.transform(F.array(F.greatest(F.col("pos") - widest, F.lit(0)), "pos", F.least(F.col("pos") + widest, F.lit(n - 1))), lambda p: F.floor(p / GAP_ROWS)))
    dealt = kept(placed.withColumn("block", F.explode(blocks)))

    def gaps(key, table):
        ordered = table.sort_by("pos")
        pos, x = ordered.column("pos").to_numpy(), ordered.column("x").to_numpy()
        d, own = np.diff(x), (pos // GAP_ROWS == key[1].as_py())[:-1]
        return pa.table({"k": pa.array(np.full(int((own & (d > EPS)).sum()), key[0].as_py(), np.int32)), "x": d[own & (d > EPS)]})

    middle = order.quantiles(order.Indexed(dealt.groupBy("k", "block").applyInArrow(gaps, "k int, x double"), width), (0.5,))[:, 0]
    floors = np.maximum(0.25 * np.nan_to_num(middle), EPS)
    cuts = max(1, int(np.ceil(least_share * n))), min(n - 1, int(np.floor((1 - least_share) * n)))

    def score(key, table):
        ordered = table.sort_by("pos")
        pos, x = ordered.column("pos").to_numpy(), ordered.column("x").to_numpy()
        k, block = (v.as_py() for v in key)
        return pa.table({"k": pa.array([k], pa.int32()), "best": [gap_scores(pos, x, pos // GAP_ROWS == block, n, floors[k], cuts, windows)]})

    out = np.zeros(width)
    for r in dealt.groupBy("k", "block").applyInArrow(score, "k int, best double").groupBy("k").agg(F.max("best").alias("best")).collect():  # a row for each component
        out[r.k] = r.best
    return out


def rank01(values: Sequence[float]) -> np.ndarray:
    """Average ranks scaled to 0..1; a single value has 0.  One entry for each feature."""
    x = np.asarray(values, float)
    _, inverse, times = np.unique(x, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(times) - times)[inverse] + (times[inverse] - 1) / 2
    return ranks / max(len(x) - 1, 1)


def fused(effective: Sequence[float], evidence: Sequence[float], weight: float) -> np.ndarray:
    return (1 - weight) * rank01(effective) + weight * rank01(evidence)


def substitution_labels(selected: Sequence[int], groups: dict[int, Sequence[int]]) -> set[int]:
    """Group numbers of the selected features; features without a group are labelled by themselves."""
    of = {j: g for g, r in enumerate(sorted(groups)) for j in (r, *groups[r])}
    return {of.get(j, 10_000_000 + j) for j in selected}


def substitution_jaccard(a: Sequence[int], b: Sequence[int], groups: dict[int, Sequence[int]]) -> float:
    return jaccard(substitution_labels(a, groups), substitution_labels(b, groups))


def jaccard(a, b) -> float:
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a or b else 1.0


def group_coverage(selected: Sequence[int], groups: Sequence[Sequence[int]]) -> float | None:
    """Share of the groups that are hit; none without groups."""
    return sum(bool(set(selected) & set(g)) for g in groups) / len(groups) if groups else None


def redundancy_rate(selected: Sequence[int], groups: Sequence[Sequence[int]], over: str = "hits") -> float | None:
    """Hits beyond the first of each group, over all hits or (over="selected") over the selected features."""
    if not groups:
        return None
    hits = [len(set(selected) & set(g)) for g in groups]
    return sum(max(0, h - 1) for h in hits) / max(sum(hits) if over == "hits" else len(set(selected)), 1)


def relevant_precision(selected: Sequence[int], groups: Sequence[Sequence[int]]) -> float | None:
    """0 for an empty selection."""
    if not groups:
        return None
    truth = {j for g in groups for j in g}
    return len(set(selected) & truth) / len(set(selected)) if selected else 0.0
