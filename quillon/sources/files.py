"""Small text files in any store that Spark reaches, and NPY matrices read and written by row ranges on the executors."""

from __future__ import annotations

import ast
import json
import os
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import positions
from .matrix import MatrixError


def _open(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str:
    """A small UTF-8 file."""
    return spark.read.text(path, wholetext=True).first()[0]


def write_text(spark: SparkSession, path: str, text: str) -> str:
    """Writes a small UTF-8 file (its folder is made) and returns the text."""
    at, files = _open(spark, path)
    if at.getParent() is not None:
        files.mkdirs(at.getParent())
    out = files.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return text


def write_report(spark: SparkSession, report: dict, path: str | None) -> str:
    """JSON with sorted keys."""
    text = json.dumps(report, indent=2, sort_keys=True, ensure_ascii=False)
    return write_text(spark, path, text) if path else text


def npy_header(start: bytes) -> tuple[tuple[int, ...], np.dtype, bool, int]:
    """Shape, type, column-major order and length of the header."""
    if start[:6] != b"\x93NUMPY":
        raise MatrixError("not an NPY file")
    wide = start[6] > 1
    size = int.from_bytes(start[8:12] if wide else start[8:10], "little")
    begin = 12 if wide else 10
    head = ast.literal_eval(start[begin : begin + size].decode("latin1"))
    return head["shape"], np.dtype(head["descr"]), head["fortran_order"], begin + size


def read_npy(spark: SparkSession, path: str, rows_per_task: int = 50_000) -> DataFrame:
    """row_id, x0, x1, ... of a two-dimensional NPY file in a folder that all executors share: the driver reads the header,
    each task its own rows.  Numbers in row order only."""
    with open(path, "rb") as f:
        shape, kind, by_column, begin = npy_header(f.read(4096))
    if len(shape) != 2 or by_column or kind.kind not in "fiub":
        raise MatrixError("a two-dimensional array of numbers in row order is needed")
    n, width = shape
    names = [f"x{j}" for j in range(width)]

    def run(batches):
        for batch in batches:
            for first in batch.column("id").to_pylist():
                count = min(rows_per_task, n - first)
                with open(path, "rb") as f:
                    f.seek(begin + first * width * kind.itemsize)
                    x = np.frombuffer(f.read(count * width * kind.itemsize), kind).reshape(count, width).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + count)), *(pa.array(x[:, j]) for j in range(width))], ["row_id", *names])

    tasks = max(1, -(-n // rows_per_task))
    starts = spark.range(0, n, rows_per_task, tasks)
    return starts.mapInArrow(run, "row_id long, " + ", ".join(f"{c} double" for c in names))


def write_npy(df: DataFrame, key: str, columns: Sequence[str], path: str, rows_per_task: int = 50_000) -> None:
    """The columns as one two-dimensional NPY file of doubles, rows in the order of ``key``, in a folder that all executors share.

    The driver writes the header and the file's full length; each task writes its rows at their own place, so a task that is run
    again writes the same bytes.  Until all are done the file has another name; an older file of the name is replaced."""
    rows = positions(df.select(key, *(F.col(c).cast("double").alias(c) for c in columns)), key)
    n, width = rows.count(), len(columns)
    head = repr({"descr": "<f8", "fortran_order": False, "shape": (n, width)}).encode("latin1")
    head = b"\x93NUMPY\x01\x00" + (118).to_bytes(2, "little") + head.ljust(117) + b"\n"
    if len(head) != 128:
        raise MatrixError("the header does not fit")
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(head)
        f.truncate(128 + 8 * n * width)

    def run(batches):
        with open(part, "r+b") as f:
            for batch in batches:
                at = batch.column("pos").to_numpy()
                x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns]).astype("<f8")
                cuts = np.flatnonzero(np.diff(at, prepend=-2) != 1)  # runs of neighbouring rows
                for a, b in zip(cuts, [*cuts[1:], len(at)], strict=True):
                    f.seek(128 + 8 * width * int(at[a]))
                    f.write(x[a:b].tobytes())
            f.flush()
            os.fsync(f.fileno())
        yield pa.RecordBatch.from_arrays([pa.array([0])], ["done"])

    dealt = rows.repartitionByRange(max(1, -(-n // rows_per_task)), "pos").sortWithinPartitions("pos")
    dealt.select("pos", *columns).mapInArrow(run, "done long").count()
    os.replace(part, path)
