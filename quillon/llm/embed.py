"""Embedding near-dedup: spherical k-means cells and blocked cosine products.

1. Equal vectors become one, with a count.
2. Spherical k-means on a bounded sample gives the cells; their number grows with the rows.
   Every vector goes to its best cell, and to each other cell whose centre is nearly as close
   (``margin``): for a pair at the least cosine t the difference vector has length
   sqrt(2 - 2t), and its share along the line between two centres has a spread of
   length * sqrt(2) / sqrt(dimensions); the margin is SPREADS of these.  Of pairs at the limit itself
   about one in a thousand has no cell in common (measured in the tests), of closer ones fewer.
   k-means cuts a dense group into cells whose members all belong to each other's cells too; such cells are merged
   until a vector of the sample has COPIES cells at most, save one in a thousand.
3. A cell's rows are cut into blocks of bounded size and each pair of blocks is a unit of work:
   one matrix product in double precision.  A pair that meets in several cells counts in the
   first of them.  A unit returns, for each vector, the number of its links and the
   least vector of its group, never pairs.
4. The groups are joined into components; the smallest id of each is kept.

Vectors that are null, empty, zero or hold null or non-finite numbers link with nothing, as do
vectors of different lengths.  Repeated rows are vectors of their own, linked with each
other, also where they share a vec_id; each row has the links of its own vector.  Rows without vec_id link and
count, but name no component: one that is linked to such rows alone has no component_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, kept

SAMPLE_ROWS, CELL_ROWS, BLOCK_ROWS, MOST_CELLS, SPREADS, COPIES = 20_000, 500, 1_000, 2_048, 1.5, 16


def unit(vectors: np.ndarray) -> np.ndarray:
    """Of length one.  The largest component comes first, so that squares neither overflow nor vanish."""
    scaled = vectors / np.maximum(np.abs(vectors).max(1, keepdims=True, initial=0), 5e-324)
    return scaled / np.maximum(np.linalg.norm(scaled, axis=1, keepdims=True), 1e-300)


def spherical_kmeans(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centres of unit length, by Lloyd's rounds on the sphere."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        best = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, best, sample)
        alive = np.linalg.norm(sums, axis=1) > 1e-12
        centres = unit(np.where(alive[:, None], sums, centres))
    return centres


def shared_cells(near: np.ndarray, margin: float) -> np.ndarray:
    """rows x cells: is a vector with these cosines to the centres a member?"""
    return near >= near.max(1, keepdims=True) - margin


def merged(centres: np.ndarray, sample: np.ndarray, margin: float, copies: int) -> np.ndarray:
    """Without centres most of whose members are those of another one, by lower and lower shares, until members have few cells.
    Any set of centres finds the same pairs: a vector belongs to all that are within the margin of its best."""
    for share in (0.8, 0.6, 0.4, 0.2, 0.1):
        both, counts = np.zeros((len(centres), len(centres)), np.float32), []
        for a in range(0, len(sample), 2_000):
            member = shared_cells(sample[a : a + 2_000] @ centres.T, margin)
            counts.append(member.sum(1))
            both += member.astype(np.float32).T @ member.astype(np.float32)
        if not counts or np.quantile(np.concatenate(counts), 0.999) <= copies:
            break
        size = np.maximum(np.diag(both), 1)
        stay: list[int] = []
        for j in np.argsort(-size, kind="stable"):
            if not stay or (both[stay, j] / size[j]).max() < share:
                stay.append(int(j))
        centres = centres[sorted(stay)]
    return centres


def groups(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Least id that each row of a symmetric link matrix reaches."""
    least = ids.copy()
    while True:
        reach = np.where(linked, least[None, :], np.iinfo(np.int64).max).min(1)
        after = np.minimum(least, reach)
        if (after == least).all():
            return least
        least = after


USABLE = "coalesce(v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(double(x)) < double('inf')) and exists(v, x -> x <> 0), false)"


def typed(vectors: DataFrame) -> DataFrame:
    """vec_id, and v as array<float> if it is one, else as array<double>."""
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"))


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector can be compared."""
    return typed(vectors).where(USABLE)


def distinct_links(distinct: DataFrame, least_cosine: float) -> DataFrame:
    """For distinct vectors (rep, n, v): rows (rep, links, least), several for each."""
    spark = distinct.sparkSession
    width = distinct.groupBy(F.size("v").alias("d")).count().collect()  # one row for each vector length
    parts = [_links_of_width(distinct.where(F.size("v") == r.d), r.d, r["count"], least_cosine) for r in width]
    out = parts[0] if parts else spark.createDataFrame([], "rep long, links long, least long")
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _links_of_width(distinct: DataFrame, width: int, rows: int, least_cosine: float) -> DataFrame:
    spark = distinct.sparkSession
    share = min(1.0, SAMPLE_ROWS / max(1, rows))
    sample = distinct.where((F.xxhash64("rep") / 2.0**64 + 0.5) < share).select("v").limit(2 * SAMPLE_ROWS).toPandas()
    cells = int(np.clip(rows // CELL_ROWS, 1, MOST_CELLS))
    points = unit(np.array(sample.v.tolist(), float).reshape(len(sample), width)) if len(sample) else np.ones((1, width))
    margin = SPREADS * np.sqrt(2 - 2 * least_cosine) / np.sqrt(width) * np.sqrt(2)
    shared = spark.sparkContext.broadcast(merged(spherical_kmeans(points, cells), points, margin, COPIES))  # MOST_CELLS rows at most
    kind = dict(distinct.dtypes)["v"]

    def member(x: np.ndarray) -> np.ndarray:
        return shared_cells(x @ shared.value.T, margin)

    def assign(batches):
        for batch in batches:
            x = unit(np.stack(batch.column("v").to_numpy(zero_copy_only=False)).astype(float))
            row, cell = np.nonzero(member(x))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *(batch.column(c).take(pa.array(row)) for c in ("rep", "n", "v"))], ["cell", "rep", "n", "v"])

    # Assigned twice, for the sizes and for the rows: cheaper than to write every copy of a vector.
    placed = distinct.select("rep", "n", "v").mapInArrow(assign, f"cell int, rep long, n long, v {kind}")
    blocks = placed.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int").alias("blocks"))  # a row for each cell: MOST_CELLS at most
    rows_in = placed.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # A block meets itself and every block of its cell: unit of work (cell, lower, upper).
    met = rows_in.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cell", F.least("block", "other").alias("lower"), F.greatest("block", "other").alias("upper"), "block", "rep", "n", "v")
    names = ["rep", "links", "least"]

    def compare(key, table):
        cell, lower, upper = (k.as_py() for k in key)
        rep, n, block = (table.column(c).to_numpy() for c in ("rep", "n", "block"))
        x = unit(np.stack(table.column("v").to_numpy()).astype(float))
        linked = x @ x.T >= least_cosine
        np.fill_diagonal(linked, False)
        if lower != upper:
            linked &= block[:, None] != block[None, :]
        if linked.any():
            before = member(x)[:, :cell].astype(np.float32)
            linked &= before @ before.T == 0
        some = linked.any(1)
        if not some.any():
            return pa.table([pa.array([], pa.int64())] * 3, names=names)
        linked = linked[some][:, some]
        return pa.table([pa.array(rep[some]), pa.array(linked @ n[some]), pa.array(groups(linked, rep[some]))], names=names)

    return met.groupBy("cell", "lower", "upper").applyInArrow(compare, "rep long, links long, least long")


def near_duplicates(vectors: DataFrame, least_cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows = usable(vectors)
    # Distinct vectors are numbered: ids may be shared or missing.  Only real ids are shown.
    distinct = kept(rows.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")).withColumn("rep", F.monotonically_increasing_id()))
    found = kept(distinct_links(distinct.drop("id"), least_cosine))
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("least").alias("b"))).withColumnRenamed("node", "rep")
    by_rep = distinct.join(counted, "rep", "left").join(joined, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    real = by_rep.groupBy("component").agg(F.min("id").alias("component_id"))
    by_vector = by_rep.join(real, "component").select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    of_rows = rows.join(by_vector, "v").select("vec_id", "n_links", "component_id")
    every = of_rows.unionByName(typed(vectors).where(~F.expr(USABLE)).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return every.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id").withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
