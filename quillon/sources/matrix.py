"""Feature matrices: keyed rows of numeric columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.order import positions


class MatrixError(ValueError):
    """The input is no matrix of finite numbers."""


@dataclass(frozen=True)
class Matrix:
    """``table``: key, pos (dense, in key order) and v, the features as an array of doubles: a plan has one column for them,
    however many they are."""

    table: DataFrame
    key: str
    features: tuple[str, ...]
    rows: int

    @property
    def width(self) -> int:
        return len(self.features)

    @property
    def data(self) -> DataFrame:
        """The same with a column for each feature."""
        return columns_of(self.table, "v", self.features)


def columns_of(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """An array column as named columns behind the others."""
    return df.select(*(c for c in df.columns if c != column), *(F.col(column)[k].alias(c) for k, c in enumerate(names)))


def numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.NumericType, T.BooleanType))


def matrix(df: DataFrame, key: str, features: Sequence[str] | None = None) -> Matrix:
    """Casts to double, checks shape, keys and finiteness in one aggregate, and numbers the rows by key."""
    kinds = {f.name: f for f in df.schema.fields}
    names = tuple(features) if features is not None else tuple(c for c in df.columns if c != key)
    if missing := [c for c in (key, *names) if c not in kinds]:
        raise MatrixError(f"no such columns: {missing}")
    if bad := [c for c in names if not numeric(kinds[c])]:
        raise MatrixError(f"not numeric: {bad}")
    if len(set(names)) < len(names) or len(names) < 2:
        raise MatrixError("at least two different features are needed")
    return _checked(df.select(F.col(key), F.array(*(F.col(c).cast("double") for c in names)).alias("v")), key, names)


def vector_matrix(df: DataFrame, key: str, column: str, names: Sequence[str] | None = None) -> Matrix:
    """Of an array column; every array must have the same length.  ``names``: else f0, f1, ..."""
    size = F.coalesce(F.size(column), F.lit(-1))
    got = df.agg(F.min(size).alias("least"), F.max(size).alias("most")).first()
    if got.least is None or got.least != got.most or got.most < 2:
        raise MatrixError(f"{column} must hold arrays of one length, of two numbers at least")
    names = tuple(names) if names is not None else tuple(f"f{k}" for k in range(got.most))
    if len(names) != got.most:
        raise MatrixError(f"{got.most} names are needed")
    return _checked(df.select(F.col(key), F.col(column).cast("array<double>").alias("v")), key, names)


_BAD = "exists(v, x -> x is null or isnan(x) or abs(x) = double('inf'))"


def _checked(data: DataFrame, key: str, names: tuple[str, ...]) -> Matrix:
    got = data.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys"), F.count_if(F.expr(_BAD)).alias("bad")).first()
    if got["rows"] < 3:
        raise MatrixError("at least three rows are needed")
    if got["keys"] < got["rows"]:
        raise MatrixError(f"{key} is not a unique key")
    if got["bad"]:
        places = data.where(_BAD).select(F.posexplode("v").alias("k", "x")).where("x is null or isnan(x) or abs(x) = double('inf')").select("k").distinct().collect()
        raise MatrixError(f"missing or infinite values in {[names[r.k] for r in sorted(places)]}")
    return Matrix(positions(data, key), key, names, got["rows"])


def read_csv(spark: SparkSession, path: str, exclude: Sequence[str] = ()) -> DataFrame:
    """A CSV file with a header; named columns are left out, others must be numeric."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    if missing := [c for c in exclude if c not in df.columns]:
        raise MatrixError(f"no such columns: {missing}")
    df = df.drop(*exclude)
    if bad := [f.name for f in df.schema.fields if not numeric(f)]:
        raise MatrixError(f"not numeric: {bad}; exclude them")
    return df


def array_columns(df: DataFrame, column: str, width: int, prefix: str = "f") -> DataFrame:
    """An array column as ``width`` columns beside the others."""
    return df.select(*(c for c in df.columns if c != column), *(F.col(column)[i].cast("double").alias(f"{prefix}{i}") for i in range(width)))


def write_selected(df: DataFrame, selected: Sequence[str], path: str, kind: str = "parquet") -> None:
    """The selected columns, in the order of the table."""
    df.select([c for c in df.columns if c in set(selected)]).write.mode("overwrite").option("header", True).format(kind).save(path)
