"""Does a selection hold?  On subsamples, up to substitutes, and when the labels are shuffled.

A repeat is a fit of its own on rows chosen by a hash of their keys; what comes back is a short list of columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import positions, shuffled
from . import evidence

Fit = Callable[[DataFrame, int], Sequence[int]]


def subsample(df: DataFrame, key: str, share: float, seed: int, n: int | None = None) -> DataFrame:
    """max(3, round(share * rows)) rows, by a random order of the keys."""
    n = df.count() if n is None else n
    placed = positions(df.withColumn("_h", shuffled("subsample", seed, key)), "_h", key, name="_place")
    return placed.where(F.col("_place") < max(3, round(share * n))).drop("_place", "_h")


def fit_with(selector, key: str, features: Sequence[str] | None = None) -> Fit:
    """A fit for the functions below from an estimator with a ``seed``: indices in order of selection."""
    return lambda df, seed: replace(selector, seed=seed).fit(df, key, features).get_support(indices=True)


def selections(fit: Fit, df: DataFrame, key: str, repeats: int = 10, share: float = 0.8, seed: int = 0) -> list[list[int]]:
    n = df.count()
    return [list(fit(subsample(df, key, share, seed + r, n), seed + r + 1)) for r in range(repeats)]


def subsample_stability(found: Sequence[Sequence[int]]) -> dict:
    """Mean and population deviation of the Jaccard index over all pairs of selections; 1 and 0 without a pair."""
    exact = [evidence.jaccard(a, b) for a, b in combinations(found, 2)]
    return {"mean_jaccard": float(np.mean(exact)) if exact else 1.0, "std_jaccard": float(np.std(exact)) if exact else 0.0, "selections": [list(x) for x in found]}


def substitution_stability(found: Sequence[Sequence[int]], groups: Mapping[int, Sequence[int]]) -> dict:
    """The same, exact and with features of one group taken as one."""
    exact = [evidence.jaccard(a, b) for a, b in combinations(found, 2)]
    aware = [evidence.substitution_jaccard(a, b, groups) for a, b in combinations(found, 2)]
    mean = lambda x: float(np.mean(x)) if x else 1.0
    return {"mean_exact_jaccard": mean(exact), "mean_substitution_aware_jaccard": mean(aware), "absolute_gain": mean(aware) - mean(exact), "selections": [list(x) for x in found]}


def pairwise_jaccard(picks: DataFrame) -> DataFrame:
    """rep_a, rep_b, jaccard of every pair of selections in a table (rep, feature): common features are counted by a join on
    the feature, sizes by an aggregate; pairs without a common feature have 0."""
    one = picks.select("rep", "feature").distinct()
    sizes = one.groupBy("rep").agg(F.count("*").alias("n"))
    both = one.select(F.col("rep").alias("rep_a"), "feature").join(one.select(F.col("rep").alias("rep_b"), "feature"), "feature").where("rep_a < rep_b").groupBy("rep_a", "rep_b").agg(F.count("*").alias("both"))
    a, b = (sizes.select(F.col("rep").alias(f"rep_{s}"), F.col("n").alias(f"n_{s}")) for s in "ab")
    pairs = a.join(b, F.col("rep_a") < F.col("rep_b"))  # a row for each pair of repeats
    met = pairs.join(both, ["rep_a", "rep_b"], "left")
    common = F.coalesce("both", F.lit(0))
    return met.select("rep_a", "rep_b", (common / (F.col("n_a") + F.col("n_b") - common)).alias("jaccard"))


TRIALS = "method string, trial int, same_selection boolean, reference_selection string, permuted_selection string"


def shuffled_labels(df: DataFrame, key: str, label: str, seed: int) -> DataFrame:
    """The label column in a random order of the rows, all else in place."""
    rows = positions(df, key, name="_to").drop(label)
    other = positions(df.select(key, label).withColumn("_h", shuffled("labels", seed, key)), "_h", key, name="_to").select("_to", label)
    return rows.join(other, "_to").drop("_to")


def label_audit(fits: Mapping[str, Fit], df: DataFrame, key: str, label: str, trials: int = 5, seed: int = 1729) -> DataFrame:
    """Each fit, given the table with its label column, on the labels as they are and shuffled: a row for each trial.  A fit that
    looks at the label gives itself away by another selection (or another order)."""
    rows = []
    for name, fit in fits.items():
        want = ",".join(map(str, fit(df, seed)))
        for t in range(trials):
            got = ",".join(map(str, fit(shuffled_labels(df, key, label, seed + t + 1), seed)))
            rows.append((name, t, got == want, want, got))
    return df.sparkSession.createDataFrame(rows, TRIALS)


def audit_summary(trials: DataFrame) -> DataFrame:
    """method, all_trials_identical, fraction_identical."""
    return trials.groupBy("method").agg(F.bool_and("same_selection").alias("all_trials_identical"), F.avg(F.col("same_selection").cast("double")).alias("fraction_identical"))
