"""Tables of benchmark results: which rows count, what is left to do, and summaries that weigh data sets alike.

A results table has dataset, method and metric columns, and may have error (blank: the run succeeded), seed, k,
panel_status and a column that says where an implementation comes from."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import order
from .governance import implementation_kind

SOURCE_COLUMNS = ("implementation_source", "external_source", "source_kind")


def results_of(source: DataFrame | str) -> DataFrame:
    """A results table, or that of a CSV file with a header (of a path that Spark reads)."""
    if isinstance(source, DataFrame):
        return source
    df = SparkSession.builder.getOrCreate().read.csv(source, header=True, inferSchema=True)
    return df.withColumn("error", F.col("error").cast("string")) if "error" in df.columns else df


def failed(df: DataFrame) -> Column:
    return F.trim(F.coalesce(F.col("error").cast("string"), F.lit(""))) != "" if "error" in df.columns else F.lit(False)


def successful(df: DataFrame) -> DataFrame:
    """Rows without an error and, where there is that column, with a finite nmi."""
    rows = df.where(~failed(df))
    if "nmi" not in df.columns:
        return rows
    nmi = F.expr("try_cast(nmi AS DOUBLE)")
    return rows.where(nmi.isNotNull() & ~F.isnan(nmi) & (F.abs(nmi) != float("inf")))


def with_kind(df: DataFrame) -> DataFrame:
    """With ``kind`` of the implementation; null if no column tells."""
    name = next((c for c in SOURCE_COLUMNS if c in df.columns), None)
    if name is None:
        return df.withColumn("kind", F.lit(None).cast("string"))
    return df.withColumn("kind", F.col(name).cast("string") if name == "source_kind" else implementation_kind(F.col(name).cast("string")))


def canonical_methods(df: DataFrame) -> DataFrame:
    """method, of which a row comes from canonical or the authors' code."""
    return with_kind(df).where(F.col("kind").isin("canonical", "author_code")).select(F.col("method").cast("string").alias("method")).distinct()


def failure_fractions(df: DataFrame) -> DataFrame:
    """method, fraction of its data sets with a failed row; k and seed do not count."""
    pairs = df.withColumn("_failed", failed(df).cast("int")).groupBy("dataset", "method").agg(F.max("_failed").alias("_failed"))
    return pairs.groupBy("method").agg(F.avg("_failed").alias("fraction"))


def eligible_rows(df: DataFrame, audits: DataFrame) -> DataFrame:
    """Rows whose data set passed the integrity audit (dataset, eligible)."""
    return df.join(audits.where("eligible").select("dataset").distinct(), "dataset", "left_semi")


def not_done(tasks: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Tasks without a row in ``done``: what a resumed run still has to do."""
    return tasks.join(done.select(*keys).distinct(), list(keys), "left_anti")


def resumed(done: DataFrame, fresh: DataFrame, key: str, *order: str) -> DataFrame:
    """Old and new rows together, the last of each key by ``order`` (later runs sort last)."""
    every = done.unionByName(fresh, allowMissingColumns=True)
    rest = [c for c in every.columns if c != key]
    return every.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def first_tasks(manifest: DataFrame, order: Sequence[str], most: int, accepted: str | None = None) -> DataFrame:
    """The first ``most`` accepted tasks in a frozen order."""
    return (manifest.where(accepted) if accepted else manifest).orderBy(*order).limit(most)


def balanced_summary(df: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("dataset",), where: str | None = None) -> DataFrame:
    """method, NAME_mean and NAME_std (sample deviation) of each metric: rows are averaged within a data set first, so
    data sets with more rows weigh no more.  ``keys``: () for plain means over rows."""
    rows = df.where(where) if where else df
    if keys:
        rows = rows.groupBy(*keys, "method").agg(*(F.avg(m).alias(m) for m in metrics))
    return rows.groupBy("method").agg(*(f(m).alias(f"{m}_{name}") for m in metrics for name, f in (("mean", F.avg), ("std", F.stddev_samp))))


def ordered_summary(summary: DataFrame, metric: str) -> DataFrame:
    """Best mean first, methods without one last."""
    return summary.orderBy(F.desc_nulls_last(f"{metric}_mean"), "method")


DOWNSTREAM = ("balanced_accuracy", "macro_f1", "accuracy", "selector_fit_seconds")


def downstream_summary(df: DataFrame, metrics: Sequence[str] = DOWNSTREAM) -> tuple[DataFrame, DataFrame]:
    """Over all data sets, and over those with panel_status offline_extension."""
    keys = ("dataset", "panel_status")
    return tuple(ordered_summary(balanced_summary(df, metrics, keys, where), metrics[0]) for where in (None, "panel_status = 'offline_extension'"))


def pivoted(df: DataFrame, index: str, column: str, value: str, columns: Sequence[str]) -> DataFrame:
    """A column of means for each of ``columns``; naming them saves a job."""
    return df.groupBy(index).pivot(column, list(columns)).agg(F.avg(value))


def null_summary(df: DataFrame, by: str, value: str) -> DataFrame:
    """by, n, mean, q95 (interpolated), positive_share and any_positive of counts from null runs."""
    x = F.col(value)
    plain = df.groupBy(by).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.avg((x > 0).cast("double")).alias("positive_share"), (F.count_if(x > 0) > 0).alias("any_positive"))
    series = order.Groups(df, by, value)
    tails = [None if np.isnan(q) else float(q) for q in order.quantiles(series, (0.95,))[:, 0]]
    q95 = df.sparkSession.createDataFrame(list(zip(series.names, tails, strict=True)), "_by string, q95 double")  # a row for each group
    return plain.join(F.broadcast(q95), F.col(by).cast("string").eqNullSafe(F.col("_by"))).select(by, "n", "mean", "q95", "positive_share", "any_positive")


def counts(df: DataFrame) -> DataFrame:
    """n_datasets, n_methods, n_rows."""
    return df.agg(F.count_distinct("dataset").alias("n_datasets"), F.count_distinct("method").alias("n_methods"), F.count("*").alias("n_rows"))
