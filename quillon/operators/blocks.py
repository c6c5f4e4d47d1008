"""All pairs of rows, in blocks of a written table.

Rows are packed into blocks, a row of one table for each.  A task asks for a few blocks: it streams all blocks of the table past
them and keeps what has come of each so far.  So nothing is sent for a pair of blocks, disk holds the rows once, a task holds
``ASKING`` blocks and one other, and its results need no merge.  The work is quadratic by definition."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, tables

#: Rows of a block, about; blocks that a task asks for, at most; rows multiplied at a time within a block.
BLOCK_ROWS, ASKING, ASKED = 2_000, 16, 500


class Meeting:
    """What becomes of pairs of blocks.  Blocks come as ``prepare`` gives them."""

    #: Of the batches that ``finish`` gives.
    schema = ""

    def prepare(self, block: int, ids: np.ndarray, v: np.ndarray):
        """ids rise; v: rows x columns."""
        return ids, v

    def begin(self, own):
        """What is kept for an asking block."""
        raise NotImplementedError

    def meet(self, state, other, same: bool) -> None:
        """Every block, the own one too, once, in any order."""
        raise NotImplementedError

    def finish(self, state) -> pa.RecordBatch:
        raise NotImplementedError


def packed(rows: DataFrame) -> DataFrame:
    """A written table of block, ids, v (bytes) for rows (a: long, v: array<double>, and block if they have one: it must count from 0,
    but blocks may be missing).  Else blocks of about BLOCK_ROWS are dealt by a hash of a."""
    if "block" not in rows.columns:
        blocks = max(1, -(-rows.count() // BLOCK_ROWS))
        rows = rows.withColumn("block", F.pmod(F.xxhash64("a"), F.lit(blocks)).cast("int"))

    def pack(key, table):
        ordered = table.sort_by("a")
        ids, v = ordered.column("a").to_numpy(), arrays.stacked(ordered.column("v").combine_chunks())
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([ids.astype(np.int64).tobytes()], pa.binary()), pa.array([np.ascontiguousarray(v, float).tobytes()], pa.binary())], names=["block", "ids", "v"])

    return tables.written(rows.select("a", "v", "block").groupBy("block").applyInArrow(pack, "block int, ids binary, v binary"))


def met(table: DataFrame, work: Meeting) -> DataFrame:
    """What ``work`` makes of all pairs of blocks of a ``packed`` table."""
    numbers = table.agg(F.count("*").alias("n"), F.max("block").alias("last")).first()
    blocks = numbers.n
    tasks = max(1, min(blocks, max(4 * table.sparkSession.sparkContext.defaultParallelism, -(-blocks // ASKING))))
    if numbers.last is not None and numbers.last >= blocks:  # missing numbers would leave tasks without work
        asking = table.withColumn("task", F.pmod(F.xxhash64("block"), F.lit(tasks)).cast("int"))
    else:
        asking = table.withColumn("task", (F.col("block") % tasks).cast("int"))
    asking = asking.select("task", F.col("block").alias("x"), F.col("ids").alias("own_ids"), F.col("v").alias("own")).repartitionById(tasks, F.col("task"))
    asking = asking.withColumn("first", F.monotonically_increasing_id() % (1 << 33) == 0)  # of its task
    others = table.select(F.col("block").alias("y"), "ids", "v").coalesce(1).withColumn("at", F.monotonically_increasing_id())
    # The left side of a Cartesian product is streamed, the right one is held: for each block y all x of the task in one order.  Bytes
    # go to Python once: those of x with the first y, those of y with the first x.
    own = lambda c: F.when(F.col("at") == 0, F.col(c)).alias(c)
    other = lambda c: F.when(F.col("first"), F.col(c)).alias(c)
    pairs = others.hint("shuffle_replicate_nl").crossJoin(asking).select("x", own("own_ids"), own("own"), "y", other("ids"), other("v"))

    def run(batches):
        def block(number, ids, v):
            ids = np.frombuffer(ids.as_buffer(), np.int64)
            return work.prepare(number, ids, np.frombuffer(v.as_buffer()).reshape(len(ids), -1))

        states, y, now = {}, None, None
        for batch in batches:
            columns = [batch.column(c) for c in ("x", "own_ids", "own", "y", "ids", "v")]
            for at in range(batch.num_rows):
                x, own_ids, own, number, ids, v = (c[at] for c in columns)
                x = x.as_py()
                if own.is_valid:
                    states[x] = work.begin(block(x, own_ids, own))
                if v.is_valid:
                    y = number.as_py()
                    now = block(y, ids, v)
                work.meet(states[x], now, x == y)
        for x in list(states):
            yield work.finish(states.pop(x))

    return pairs.mapInArrow(run, work.schema)
