"""Hard-negative mining: blocked dense products in double precision, in two passes.

A component x becomes floor(256 x); a row's score for an anchor is the inner product of two such vectors.  Products of
doubles are exact while every partial sum stays below 2**53; rows whose length and largest
component do not prove that are multiplied in Python's integers.

1. Anchors are cut into blocks of bounded size by a hash of the whole row.  A block is broadcast; tasks run all rows by
   it, a tile of rows at a time, and hold for each anchor its best ``positives`` rows of the same label so far:
   such lists merge, so each task sends one list for each anchor, and the lists of all tasks merge into one.
2. The block is broadcast anew with the positives it found.  For each anchor and positive tasks hold the best
   ``negatives`` rows of other labels whose scores lie in the positive's window, and merge in the same way.

Every row is compared with every anchor: the anchors are a stated query set.  At most ``TASKS`` tasks run a
block, so lists to merge do not grow with the rows, and memory holds a block, a tile and their product.

Rows with a null id, null label, null or empty vector, or a null or non-finite component take no part; nor do anchors and rows whose
vectors differ in length meet.  An anchor never meets rows of its own vec_id.  Rows that repeat are rows of their own, as candidates each
time, as anchors once if they are equal in all columns.  Scores are exact up to +-(2**63 - 1) / 100, which no real embedding
reaches; beyond, they count and are shown as that bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import discard, kept, written

#: Bytes of an anchor block's vectors at most, about; rows of a tile; tasks for a block.
BLOCK_BYTES, TILE_ROWS, TASKS = 16 << 20, 2_048, 64
#: Anchors multiplied at a time within a block.
_ANCHORS = 1_024
_LOWEST = np.iinfo(np.int64).min
_MOST = (2**63 - 1) // 100

USABLE = "vec_id is not null and label is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(double(x)) < double('inf'))"


def typed(vectors: DataFrame, label: Column | None = None) -> DataFrame:
    """vec_id, label, v of the rows that take part; ``label`` replaces the column."""
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"), F.col("embedding").cast(kind).alias("v")).where(USABLE)


def scaled(column: pa.Array) -> np.ndarray:
    """floor(256 x) of vectors of one length, within the range of doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    with np.errstate(over="ignore"):
        return np.floor(np.clip(256 * values, -1.7e308, 1.7e308)).reshape(len(column), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices, as int64, exact; beyond 2**53 cut to +-_MOST."""
    small = (2.0**53 / a.shape[1]) ** 0.5
    large = [np.flatnonzero(np.abs(m).max(1, initial=0) >= small) for m in (a, b)]
    if not (len(large[0]) or len(large[1])):
        return (a @ b.T).astype(np.int64)
    low = [np.where(np.abs(m).max(1, initial=0)[:, None] < small, m, 0) for m in (a, b)]
    out = (low[0] @ low[1].T).astype(np.int64)
    exact = [[[int(x) for x in row] for row in m] for m in (a, b)]
    every = {(i, j) for i in large[0] for j in range(len(b))} | {(i, j) for j in large[1] for i in range(len(a))}
    for i, j in every:
        out[i, j] = max(-_MOST, min(_MOST, sum(x * y for x, y in zip(exact[0][i], exact[1][j], strict=True))))
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best scores of each row, the first of equal ones first, and their ids.  _LOWEST: no score.  ``scores`` is changed."""
    rows = np.arange(len(scores))
    found = np.full((len(scores), k), _LOWEST), np.zeros((len(scores), k), np.int64)
    for i in range(min(k, scores.shape[1])):
        at = scores.argmax(1)
        top = scores[rows, at]
        if (top == _LOWEST).all():
            break
        found[0][:, i], found[1][:, i] = top, ids[at]
        scores[rows, at] = _LOWEST
    return found


def merged(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The best of two lists for each row, as many as the first has, ties by smaller id."""
    k = one[0].shape[1]
    scores, ids = np.concatenate([one[0], other[0]], 1), np.concatenate([one[1], other[1]], 1)
    by_id = ids.argsort(1, kind="stable")
    scores, ids = np.take_along_axis(scores, by_id, 1), np.take_along_axis(ids, by_id, 1)
    order = (~scores).argsort(1, kind="stable")[:, :k]  # ~x falls as x rises, without overflow
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _tiles(batches, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels, vectors of some rows, ids ascending."""
    for batch in batches:
        for a in range(0, batch.num_rows, TILE_ROWS):
            part = batch.slice(a, TILE_ROWS)
            ids, labels = (part.column(c).to_numpy() for c in ("vec_id", "label"))
            order = ids.argsort(kind="stable")
            yield ids[order], labels[order], scaled(part.column("v"))[order]


def _lists(slot: np.ndarray, held: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A row for each slot that holds something: slot, scores, ids."""
    scores, ids = held
    some = scores[:, 0] > _LOWEST
    slot, scores, ids = slot[some], scores[some], ids[some]
    real = scores > _LOWEST
    offsets = np.concatenate([[0], np.cumsum(real.sum(1))]).astype(np.int32)
    columns = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x[real], pa.int64())) for x in (scores, ids)]
    yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), *columns], ["slot", "scores", "ids"])


def _merge(parts: DataFrame, k: int) -> DataFrame:
    """slot, best: the k best (score, id) of its lists, at most TASKS of them."""
    pairs = F.arrays_zip(F.col("scores").alias("s"), F.col("ids").alias("i"))
    flat = F.flatten(F.collect_list(F.transform(pairs, lambda p: F.struct((-p["s"]).alias("s"), p["i"].alias("i")))))
    return parts.groupBy("slot").agg(F.slice(F.array_sort(flat), 1, k).alias("best"))


def _positives(rows: DataFrame, block, k: int) -> DataFrame:
    def run(batches):
        ids, labels, v = block.value
        held = np.full((len(ids), k), _LOWEST), np.zeros((len(ids), k), np.int64)
        for c_ids, c_labels, c in _tiles(batches, v.shape[1]):
            for a in range(0, len(ids), _ANCHORS):
                own = slice(a, a + _ANCHORS)
                fit = (labels[own, None] == c_labels) & (ids[own, None] != c_ids)
                new = merged((held[0][own], held[1][own]), best(np.where(fit, products(v[own], c), _LOWEST), c_ids, k))
                held[0][own], held[1][own] = new
        yield from _lists(np.arange(len(ids)), held)

    return rows.mapInArrow(run, "slot long, scores array<long>, ids array<long>")


def _negatives(rows: DataFrame, block, k: int, low: int, high: int) -> DataFrame:
    def run(batches):
        anchor, score, ids, labels, v = block.value  # anchor, score: of each positive
        held = np.full((len(anchor), k), _LOWEST), np.zeros((len(anchor), k), np.int64)
        first = np.searchsorted(anchor, np.arange(len(ids) + 1))
        for c_ids, c_labels, c in _tiles(batches, v.shape[1]):
            for a in range(0, len(ids), _ANCHORS):
                some = slice(a, a + _ANCHORS)
                got = np.where((labels[some, None] != c_labels) & (ids[some, None] != c_ids), products(v[some], c), _LOWEST)
                n = first[some.start : some.start + _ANCHORS + 1]
                for place in range(int(np.diff(n).max(initial=0))):  # the anchors' positives by their place
                    at = np.flatnonzero(np.diff(n) > place)
                    slot = n[:-1][at] + place
                    s, x = score[slot, None], got[at]
                    # what can still displace the worst that is held; 100 times it stays in range, by _MOST
                    fit = (x > _LOWEST) & (x >= held[0][slot, -1:])
                    fit[fit] = (low * np.broadcast_to(s, x.shape)[fit] <= 100 * x[fit]) & (100 * x[fit] <= high * np.broadcast_to(s, x.shape)[fit])
                    hit = fit.any(1)
                    if hit.any():
                        slot = slot[hit]
                        new = merged((held[0][slot], held[1][slot]), best(np.where(fit[hit], x[hit], _LOWEST), c_ids, k))
                        held[0][slot], held[1][slot] = new
        yield from _lists(np.arange(len(anchor)), held)

    return rows.mapInArrow(run, "slot long, scores array<long>, ids array<long>")


MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """MINED, for rows and anchors as ``typed`` gives them: for each anchor and each of its best ``positives`` rows of the same label, the
    best ``negatives`` rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score."""
    spark = rows.sparkSession
    own = anchors.dropDuplicates().withColumn("width", F.size("v"))
    widths = [tuple(r) for r in own.groupBy("width").count().collect()]  # one row for each vector length
    out = spark.createDataFrame([], MINED)
    for width, n in widths:
        blocks = -(-n * 8 * width // BLOCK_BYTES)
        placed = written(own.where(F.col("width") == width).withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(blocks))), "block")
        same = _few(rows.where(F.size("v") == width).select("vec_id", "label", "v"))
        for b in range(blocks):
            out = out.unionByName(_mine_block(same, placed.where(F.col("block") == b), positives, negatives, low, high))
        discard(placed)
    return out


def _few(rows: DataFrame) -> DataFrame:
    """At most TASKS partitions."""
    return rows.coalesce(TASKS)


def _mine_block(rows: DataFrame, placed: DataFrame, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    spark = rows.sparkSession
    table = placed.select("vec_id", "label", "v").toArrow().combine_chunks()  # a block: BLOCK_BYTES of vectors, about
    if not table.num_rows:
        return spark.createDataFrame([], MINED)
    ids, labels = (table.column(c).to_numpy() for c in ("vec_id", "label"))
    order = np.lexsort((labels, ids))
    v = scaled(table.column("v").combine_chunks())[order]
    ids, labels = ids[order], labels[order]
    block = spark.sparkContext.broadcast((ids, labels, v))
    found = _merge(_positives(rows, block, positives), positives).select("slot", F.posexplode("best").alias("place", "p"))
    pairs = found.select("slot", "place", (-F.col("p.s")).alias("score"), F.col("p.i").alias("id")).toArrow()  # ``positives`` for each anchor of the block
    block.unpersist()
    slot, place, score, positive = (pairs.column(c).to_numpy() for c in ("slot", "place", "score", "id"))
    order = np.lexsort((place, slot))
    slot, score, positive = slot[order], score[order], positive[order]
    block = spark.sparkContext.broadcast((slot, score, ids, labels, v))
    mined = _merge(_negatives(rows, block, negatives, low, high), negatives).select("slot", F.posexplode("best").alias("place", "n"))
    names = spark.createDataFrame(pa.table({"slot": np.arange(len(slot)), "anchor_id": ids[slot], "positive_id": positive, "positive_score": score}))
    named = mined.join(F.broadcast(names), "slot")  # as many rows as the block has positives
    done = kept(named.select("anchor_id", "positive_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("n.i").alias("negative_id"), "positive_score", (-F.col("n.s")).alias("negative_score")))
    block.unpersist()
    return done
