"""Preparation of tables: targets, folds, caps, codes, imputation and encoders, the last row of each key."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import order
from ..functions.order import positions, shuffled


def with_target(df: DataFrame, target: str, drop: Sequence[str] = (), above: float | None = None) -> DataFrame:
    """Rows with a target, without the columns that give it away; ``above``: the target becomes 1 if it is larger, else 0."""
    rows = df.where(F.col(target).isNotNull()).drop(*drop)
    return rows.withColumn(target, (F.col(target) > F.lit(above)).cast("int")) if above is not None else rows


def complete_numeric(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Numeric columns (and those in ``keep``), rows without a null or NaN in them."""
    numeric = [f.name for f in df.schema.fields if f.name not in keep and isinstance(f.dataType, T.NumericType)]
    return df.select(*keep, *numeric).na.drop(subset=numeric)


def stratified_folds(df: DataFrame, key: str, label: str, folds: int, seed: int = 0) -> DataFrame:
    """With ``fold``: each label's rows are dealt in turn, in a random order of the keys.

    A label's rows are dealt within 64 slices of the keys, so that one label is not one task; in
    a slice folds differ by one row at most."""
    part = F.pmod(F.conv(F.substring(shuffled("slice", seed, key), 1, 8), 16, 10).cast("long"), F.lit(64))
    order = Window.partitionBy(label, "_part").orderBy(shuffled("fold", seed, key), key)
    return df.withColumn("_part", part).withColumn("fold", F.pmod(F.row_number().over(order) - 1 + F.col("_part"), F.lit(folds)).cast("int")).drop("_part")


def uniform_cap(df: DataFrame, key: str, group: str, most: int, seed: int = 0) -> DataFrame:
    """Up to ``most`` rows of each group, by a random order of the keys.  Within 64 slices of a group first, so that a group is
    ranked in one task by 64 * most rows at most."""
    hashed = df.withColumn("_h", shuffled("cap", seed, key))
    within = Window.partitionBy(group, F.substring("_h", 1, 2)).orderBy("_h", key)
    few = hashed.withColumn("_at", F.row_number().over(within)).where(F.col("_at") <= most)
    over = Window.partitionBy(group).orderBy("_h", key)
    return few.withColumn("_at", F.row_number().over(over)).where(F.col("_at") <= most).drop("_at", "_h")


def factorize(df: DataFrame, column: str, name: str) -> DataFrame:
    """With ``name``: the place of the value among the sorted distinct values; null stays null."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    return df.join(positions(values, column, name=name), column, "left")


def last_of_each(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key in an order, by an aggregate: no window, no sort of a key's rows."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls become the column's median (of two middle values their mean; null for a column without values)."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(order.median(df, c)).cast("double")) for c in columns})


def one_hot(df: DataFrame, column: str, most: int = 64) -> DataFrame:
    """A 0/1 column for each value (column=value), values sorted; an error above ``most`` values."""
    values = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{column} has more than {most} values")
    return df.select("*", *((F.col(column).eqNullSafe(F.lit(v))).cast("int").alias(f"{column}={v}") for v in values))


@dataclass
class Encoder:
    """Fitted on training rows: medians of numeric columns; for each other one its mode and its frequent values.

    Null becomes the mode.  Each frequent value has a 0/1 column; all others, and values that training rows never had, share one
    (``column=*``) if training rows had infrequent ones, else they have zeros everywhere."""

    medians: dict[str, float] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)
    frequent: dict[str, list[str]] = field(default_factory=dict)
    rare: set[str] = field(default_factory=set)

    def _columns(self) -> list:
        out = [F.coalesce(F.col(c).cast("double"), F.lit(m)).alias(c) for c, m in self.medians.items()]
        for c, values in self.frequent.items():
            x = F.coalesce(F.col(c).cast("string"), F.lit(self.modes[c]))
            out += [(x == v).cast("double").alias(f"{c}={v}") for v in values]
            if c in self.rare:
                out.append((~x.isin(values)).cast("double").alias(f"{c}=*"))
        return out

    def names(self) -> tuple[str, ...]:
        return (*self.medians, *(f"{c}={v}" for c, values in self.frequent.items() for v in [*values, *(["*"] if c in self.rare else [])]))

    def apply(self, df: DataFrame, *keep: str) -> DataFrame:
        return df.select(*keep, *self._columns())


def fit_encoder(df: DataFrame, columns: Sequence[str], min_frequency: float = 0.02) -> Encoder:
    """Modes tie to the smallest value; a value is frequent in at least ``min_frequency`` of the rows (so there are
    1 / min_frequency of them at most)."""
    kinds, found, n = {f.name: f.dataType for f in df.schema.fields}, Encoder(), df.count()
    for c in columns:
        if isinstance(kinds[c], (T.NumericType, T.BooleanType)):
            found.medians[c] = order.median(df.select(F.col(c).cast("double").alias(c)), c) or 0.0
            continue
        counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).agg(F.count("*").alias("n"))
        top = counts.orderBy(F.desc("n"), "v").first()
        if top is None:
            continue
        nulls = n - (counts.agg(F.sum("n")).first()[0] or 0)
        filled = counts.withColumn("n", F.col("n") + F.when(F.col("v") == top.v, nulls).otherwise(0))
        found.modes[c] = top.v
        found.frequent[c] = [r.v for r in filled.where(F.col("n") >= min_frequency * n).orderBy("v").collect()]
        if filled.where(F.col("n") < min_frequency * n).limit(1).count():
            found.rare.add(c)
    return found


MISSING = "__MISSING__"


def encode_suite(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), most: int = 1_000) -> DataFrame:
    """Columns of a suite's table as numbers: numeric ones with infinities and nulls as their median (0 without any value),
    others as 0/1 columns of their values, null a value of its own; columns with one value only are left out."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out = {}
    for c in columns:
        if isinstance(kinds[c], (T.NumericType, T.BooleanType)):
            x = F.col(c).cast("double")
            finite = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
            out[c] = F.coalesce(finite, F.lit(order.median(df.select(finite.alias(c)), c) or 0.0))
        else:
            x = F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
            values = [r[0] for r in df.select(x).distinct().orderBy(x).limit(most + 1).collect()]
            if len(values) > most:
                raise ValueError(f"{c} has more than {most} values")
            out |= {f"{c}={v}": (x == v).cast("double") for v in values}
    wide = df.select(*keep, *(x.alias(c) for c, x in out.items()))
    spread = wide.agg(*(F.min(f"`{c}`").alias(f"a{i}") for i, c in enumerate(out)), *(F.max(f"`{c}`").alias(f"b{i}") for i, c in enumerate(out))).first()
    return wide.select(*keep, *(f"`{c}`" for i, c in enumerate(out) if spread[f"a{i}"] != spread[f"b{i}"]))
