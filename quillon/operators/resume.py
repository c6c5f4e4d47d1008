"""Results that outlive their run: batches of rows with a commit log.

A folder, in any store that Spark reaches, holds ``rows/<batch>`` (Parquet) and ``log/<batch>`` (Parquet: the keys of the batch's tasks).  A
batch is named by its tasks, so a run that repeats it writes the same place; its rows count once its log is there, and that
is written after them.  Rows of a batch whose run died before are neither seen nor doubled."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import results


@dataclass(frozen=True)
class Store:
    """``schema`` of the rows; ``keys``: the columns that name a task."""

    spark: SparkSession
    folder: str
    schema: str
    keys: tuple[str, ...]

    def _files(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> list[str]:
        """Names of the committed ones: those whose log was written to its end."""
        path, files = self._files()
        log = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "log")
        if not files.exists(log):
            return []
        of = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(s.getPath().getName() for s in files.listStatus(log) if files.exists(of(s.getPath(), "_SUCCESS")))

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def rows(self) -> DataFrame:
        """Of committed batches alone."""
        names = self.batches()
        return self.spark.read.schema(self._empty().schema).parquet(*(f"{self.folder}/rows/{b}" for b in names)) if names else self._empty()

    def done(self) -> DataFrame:
        """Keys of the tasks that are committed."""
        names, keys = self.batches(), self._empty().select(*self.keys)
        return self.spark.read.schema(keys.schema).parquet(*(f"{self.folder}/log/{b}" for b in names)).distinct() if names else keys

    def todo(self, tasks: DataFrame) -> DataFrame:
        """Tasks that no committed batch has."""
        return results.not_done(tasks, self.done(), *self.keys)

    def commit(self, tasks: Sequence[Sequence], rows: DataFrame) -> str:
        """The rows of a batch of tasks (tuples of their keys), which may be none; the batch's name."""
        name = hashlib.sha256(json.dumps(sorted(map(list, tasks), key=repr)).encode()).hexdigest()
        rows.select(*self._empty().columns).write.mode("overwrite").parquet(f"{self.folder}/rows/{name}")
        keys = self._empty().select(*self.keys).schema
        self.spark.createDataFrame([tuple(t) for t in tasks], keys).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/log/{name}")
        return name

    def run(self, tasks: DataFrame, work: Callable[[list[tuple]], DataFrame], size: int = 1, order: Iterable[str] = ()) -> DataFrame:
        """Works off what is left of a manifest of tasks, ``size`` at a time and each batch committed before the next; all rows."""
        left = [tuple(r) for r in self.todo(tasks).select(*self.keys).orderBy(*(order or self.keys)).collect()]  # a manifest names runs, not data
        for a in range(0, len(left), size):
            self.commit(left[a : a + size], work(left[a : a + size]))
        return self.rows()

    def last(self, order: str) -> DataFrame:
        """One row for each task, the last by ``order``: as where a task has been run again on purpose."""
        key = F.struct(*self.keys)
        every = self.rows()
        return every.withColumn("_k", key).groupBy("_k").agg(F.max_by(F.struct(*every.columns), F.col(order)).alias("_r")).select("_r.*")
