"""Matrices by kind of file: how each is read and written.  A kind is the end of a path; ``register`` adds one."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import read_npy, write_npy
from .matrix import MatrixError, read_csv, write_selected

Reader = Callable[[SparkSession, str, Sequence[str]], DataFrame]
Writer = Callable[[DataFrame, str, Sequence[str], str], None]
_KINDS: dict[str, tuple[Reader, Writer, str | None]] = {}


def register(kind: str, reader: Reader, writer: Writer, key: str | None = None) -> None:
    """key: the column by which the reader numbers rows, if it does."""
    _KINDS[kind] = reader, writer, key


def kind_of(path: str) -> str:
    """parquet where the end of a path says nothing else."""
    end = path.rstrip("/").rpartition(".")[2].lower()
    return end if end in _KINDS else "parquet"


def read_matrix(spark: SparkSession, path: str, exclude: Sequence[str] = (), key: str | None = None) -> tuple[DataFrame, str]:
    """The table without ``exclude``, and its key: the one named, the reader's own, or a number for each row."""
    reader, _, own = _KINDS[kind_of(path)]
    df = reader(spark, path, exclude)
    if key or own:
        return df, key or own
    return df.withColumn("_row", F.monotonically_increasing_id()), "_row"


def write_matrix(df: DataFrame, key: str, selected: Sequence[str], path: str, source: str = "") -> None:
    """The selected columns in the order of the table, by the kind of ``path`` or else of ``source``.  An .npy file has its rows in the
    order of ``key``."""
    by_path = path.rstrip("/").rpartition(".")[2].lower()
    kind = by_path if by_path in _KINDS else kind_of(source)
    if kind == "npy" and by_path != "npy":
        kind = "parquet"  # a folder
    _KINDS[kind][1](df, key, selected, path)


def _npy(spark: SparkSession, path: str, exclude: Sequence[str]) -> DataFrame:
    if exclude:
        raise MatrixError("columns can be left out of named columns only")
    return read_npy(spark, path)


register("csv", read_csv, lambda df, key, selected, path: write_selected(df, selected, path, "csv"))
register("parquet", lambda spark, path, exclude: spark.read.parquet(path).drop(*exclude), lambda df, key, selected, path: write_selected(df, selected, path))
register("npy", _npy, write_npy, "row_id")
