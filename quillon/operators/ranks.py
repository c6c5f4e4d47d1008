"""Comparison of methods over data sets: ranks, Friedman, Wilcoxon, Holm.

Ranks and sums are windows and grouped sums; only a row for each method reaches the driver, where
tail probabilities are looked up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special


def dataset_scores(rows: DataFrame, dataset: str, method: str, metric: str) -> DataFrame:
    """dataset, method, score (mean), spread (sample deviation), n."""
    named = rows.select(F.col(dataset).alias("dataset"), F.col(method).alias("method"), F.col(metric).alias("x"))
    return named.where("x is not null").groupBy("dataset", "method").agg(F.avg("x").alias("score"), F.stddev_samp("x").alias("spread"), F.count("*").alias("n"))


def complete(scores: DataFrame) -> DataFrame:
    """Only data sets that every method has."""
    methods = scores.select("method").distinct().count()
    full = scores.groupBy("dataset").agg(F.count("*").alias("m")).where(F.col("m") == methods).select("dataset")
    return scores.join(full, "dataset", "left_semi")


def ranked(scores: DataFrame, higher_is_better: bool = True) -> DataFrame:
    """With ``rank`` within the data set: 1 is best, ties share their mean."""
    order = F.desc("score") if higher_is_better else F.asc("score")
    tied = F.count("*").over(Window.partitionBy("dataset", "score"))
    return scores.withColumn("rank", F.rank().over(Window.partitionBy("dataset").orderBy(order)) + (tied - 1) / 2)


def friedman(ranks: DataFrame) -> dict:
    """n, k, chi2 (corrected for ties) and p; null for fewer than three methods or two data sets."""
    sums = ranks.groupBy("method").agg(F.sum("rank").alias("r"), F.count("*").alias("n")).collect()  # a row for each method
    k, n = len(sums), max((r.n for r in sums), default=0)
    if k < 3 or n < 2:
        return {"n": n, "k": k, "chi2": None, "p": None}
    ties = ranks.groupBy("dataset", "rank").count().agg(F.sum(F.col("count") * (F.col("count") * F.col("count") - 1)).alias("t")).first().t
    chi2 = 12 / (n * k * (k + 1)) * sum(r.r**2 for r in sums) - 3 * n * (k + 1)
    correction = 1 - ties / (n * k * (k * k - 1))
    chi2 = chi2 / correction if correction > 0 else None
    return {"n": n, "k": k, "chi2": chi2, "p": None if chi2 is None else special.chi2_sf(chi2, k - 1)}


def signed_ranks(scores: DataFrame, reference: str, higher_is_better: bool = True) -> DataFrame:
    """method, n (differences that are not zero), zeros, plus, minus, statistic, rank_biserial, ties of the
    reference against each other method, with means and the median of the differences (positive: the reference is better)."""
    base = scores.where(F.col("method") == reference).select("dataset", F.col("score").alias("base"))
    better = F.col("base") - F.col("score") if higher_is_better else F.col("score") - F.col("base")
    diff = scores.where(F.col("method") != reference).join(base, "dataset").select("method", "base", "score", better.alias("d"))
    live = diff.where("d <> 0").withColumn("a", F.abs("d"))
    tied = F.count("*").over(Window.partitionBy("method", "a"))
    live = live.withColumn("t", tied).withColumn("r", F.rank().over(Window.partitionBy("method").orderBy("a")) + (tied - 1) / 2)
    zero = F.lit(0.0)
    sums = live.groupBy("method").agg(
        F.count("*").alias("n"),
        F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(zero)).alias("plus"),
        F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(zero)).alias("minus"),
        F.sum(F.col("t") * F.col("t") - 1).cast("double").alias("ties"),
    )
    every = diff.groupBy("method").agg(
        F.count_if(F.col("d") == 0).alias("zeros"), F.count("*").alias("n_datasets"), F.max(F.abs("d")).alias("largest"),
        F.avg("base").alias("mean_reference"), F.avg("score").alias("mean_competitor"), F.avg("d").alias("mean_difference"), F.percentile("d", F.lit(0.5)).alias("median_difference"),
    )
    rows = every.join(sums, "method", "left").na.fill(0, ["n", "plus", "minus", "ties"])
    return rows.withColumn("statistic", F.least("plus", "minus")).withColumn("rank_biserial", F.when(F.col("n") > 0, (F.col("plus") - F.col("minus")) / (F.col("plus") + F.col("minus"))).otherwise(zero))


def holm(p: Sequence[float]) -> list[float]:
    """Adjusted values, in the order given."""
    order, out, worst = sorted(range(len(p)), key=lambda i: p[i]), [0.0] * len(p), 0.0
    for place, i in enumerate(order):
        worst = max(worst, min(1.0, (len(p) - place) * p[i]))
        out[i] = worst
    return out


def holm_frame(rows: DataFrame, p: str = "p") -> DataFrame:
    """With ``p_holm``: the running maximum of (m - place) * p. The rows are one family of tests."""
    order = Window.partitionBy(F.lit(0)).orderBy(p)
    stepped = rows.withColumn("_s", F.least(F.lit(1.0), (F.count("*").over(Window.partitionBy(F.lit(0))) - F.row_number().over(order) + 1) * F.col(p)))
    return stepped.withColumn("p_holm", F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def compare_methods(rows: DataFrame, dataset: str, method: str, metric: str, reference: str, higher_is_better: bool = True, alpha: float = 0.05) -> dict:
    """omnibus, mean_ranks, posthoc (a row for each other method, Holm-adjusted, the smallest p first), dataset_scores,
    dataset_ranks.  Differences that are all within 1e-8 of zero have statistic 0 and p 1."""
    scores = complete(dataset_scores(rows, dataset, method, metric)).persist()
    ranks = ranked(scores, higher_is_better)
    posthoc = []
    for r in signed_ranks(scores, reference, higher_is_better).orderBy("method").collect():  # a row for each method
        same = r.largest <= 1e-8 or not r.n
        p = 1.0 if same else special.wilcoxon_p(r.statistic, r.n, r.ties, not r.zeros and not r.ties and r.n <= 50)
        names = ("n", "n_datasets", "mean_reference", "mean_competitor", "mean_difference", "median_difference", "rank_biserial")
        posthoc.append({"method": r.method, **{c: r[c] for c in names}, "statistic": 0.0 if same else r.statistic, "p": p})
    for row, p in zip(posthoc, holm([r["p"] for r in posthoc]), strict=True):
        row |= {"p_holm": p, "significant_holm": p < alpha}
    posthoc.sort(key=lambda r: (r["p_holm"], r["method"]))
    return {"omnibus": friedman(ranks), "mean_ranks": ranks.groupBy("method").agg(F.avg("rank").alias("mean_rank")), "posthoc": posthoc, "dataset_scores": scores, "dataset_ranks": ranks}
