"""Scaling: robust, mean and standard deviation, z-score and min-max, fitted in aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.order import Components, quantiles

EPS = 1e-12


@dataclass(frozen=True)
class Scaling:
    """z = (x - location) / scale, clipped to +-clip where that is given."""

    features: tuple[str, ...]
    location: tuple[float, ...]
    scale: tuple[float, ...]
    clip: float | None = None

    def columns(self) -> list[Column]:
        out = []
        for name, at, by in zip(self.features, self.location, self.scale, strict=True):
            z = (F.col(name) - F.lit(at)) / F.lit(by)
            out.append((F.greatest(F.lit(-self.clip), F.least(F.lit(self.clip), z)) if self.clip is not None else z).alias(name))
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        """Other columns are kept."""
        own = set(self.features)
        return df.select(*(c for c in df.columns if c not in own), *self.columns())


    def apply_vectors(self, df: DataFrame, column: str = "v") -> DataFrame:
        """To an array column of all features; other columns are kept."""
        at, by, clip = np.array(self.location), np.array(self.scale), self.clip

        def run(batches):
            for batch in batches:
                x = (arrays.stacked(batch.column(column)) - at) / by
                if clip is not None:
                    x = np.clip(x, -clip, clip)
                place = batch.schema.get_field_index(column)
                yield batch.set_column(place, column, arrays.listed(x))

        return df.mapInArrow(run, df.schema)


def robust(df: DataFrame, features: Sequence[str], clip: float = 4.5, eps: float = EPS) -> Scaling:
    """Median, and 1.4826 MAD, else IQR / 1.349, else population deviation, else 1: each if above eps."""
    return robust_vectors(df.select(F.array(*(F.col(c).cast("double") for c in features)).alias("v")), features, clip, eps)


def robust_vectors(df: DataFrame, features: Sequence[str], clip: float = 4.5, eps: float = EPS) -> Scaling:
    """Of the components of v.  Order statistics of all features come from the same few passes; no task holds a column."""
    width = len(features)
    low, median, high = quantiles(Components(df, "v", width), (0.25, 0.5, 0.75)).T
    mad = quantiles(Components(df, "v", width, median), (0.5,))[:, 0]
    scale = np.where(1.4826 * mad > eps, 1.4826 * mad, (high - low) / 1.349)
    if (flat := np.flatnonzero(~(scale > eps))).size:
        got = df.agg(*(F.stddev_pop(F.col("v")[int(k)]).alias(f"s{k}") for k in flat)).first()
        for k in flat:
            scale[k] = got[f"s{k}"] if got[f"s{k}"] > eps else 1.0
    return Scaling(tuple(features), tuple(median.tolist()), tuple(scale.tolist()), clip)


def mean_sd_vectors(df: DataFrame, features: Sequence[str], eps: float = EPS) -> Scaling:
    """As ``mean_sd``, of the components of v."""
    mean = arrays.column_sums(df, "v", len(features), lambda x: x) / max(1, df.count())
    spread = np.sqrt(arrays.column_sums(df, "v", len(features), lambda x: (x - mean) ** 2) / max(1, df.count()))
    return Scaling(tuple(features), tuple(mean.tolist()), tuple(np.where(spread > eps, spread, 1.0).tolist()))


def mean_sd(df: DataFrame, features: Sequence[str], eps: float = EPS) -> Scaling:
    """Mean and population deviation, 1 for a constant; no clipping."""
    got = df.agg(*(F.avg(c).alias(f"a{i}") for i, c in enumerate(features)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(features))).first()
    n = range(len(features))
    return Scaling(tuple(features), tuple(got[f"a{i}"] for i in n), tuple(got[f"s{i}"] if got[f"s{i}"] > eps else 1.0 for i in n))


def min_max(df: DataFrame, features: Sequence[str]) -> tuple[Scaling, tuple[str, ...]]:
    """To [0, 1]; constant features are left out and named."""
    got = df.agg(*(F.min(c).alias(f"a{i}") for i, c in enumerate(features)), *(F.max(c).alias(f"b{i}") for i, c in enumerate(features))).first()
    live = [i for i in range(len(features)) if got[f"b{i}"] > got[f"a{i}"]]
    constant = tuple(c for i, c in enumerate(features) if i not in live)
    return Scaling(tuple(features[i] for i in live), tuple(got[f"a{i}"] for i in live), tuple(got[f"b{i}"] - got[f"a{i}"] for i in live)), constant
