"""Tables between jobs, in the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> None:
    """Takes the folder that the cluster names; only a local session that names none (as in tests) gets one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
_inside: dict[int, list] = {}  # by session: how many threads are inside, and the setting before the first


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go when each ends, not whenever the driver collects garbage.  The last of several
    threads to leave restores the session's setting."""
    key = id(spark)
    with _lock:
        held = _inside.setdefault(key, [0, spark.conf.get(FREED, "false")])
        held[0] += 1
        spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        with _lock:
            held[0] -= 1
            if not held[0]:
                spark.conf.set(FREED, held[1])
                del _inside[key]


def kept(df: DataFrame) -> DataFrame:
    """The rows, computed now and written to the shared checkpoint folder; a lost executor takes none along."""
    checkpoint_folder(df.sparkSession)
    with freeing(df.sparkSession):
        return df.checkpoint()


def written(df: DataFrame, *by: str) -> DataFrame:
    """As ``kept``, but as a compressed table (in a folder for each value of ``by``) of which later reads take the
    columns and folders they need.  The folder goes when the application ends."""
    spark = df.sparkSession
    checkpoint_folder(spark)
    jvm, folder = spark.sparkContext._jvm, f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4()}"
    with freeing(spark):
        df.write.option("compression", "zstd").partitionBy(*by).parquet(folder)
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(folder)


def discard(df: DataFrame) -> None:
    """Deletes the files of a ``written`` table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
