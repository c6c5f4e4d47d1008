"""Geometry of pairs in arrays: profiles, sums, Gram columns and the permutation null, in plans that do not grow with the features.

Rows and profiles have one array column.  The null is cut into units of (some draws, a range of rows, a tile of features):
a unit has the pairs that touch its rows, and the scaled rows at their ends, as they are and as each draw permutes them, brought by
joins.  It gives partial sums for each draw and feature, so no task holds a column, a bank of permutations or all pairs, and
nothing is broadcast but vectors with a number for each feature.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from .support import EPS, Support, calibrate

#: Features of a tile; bytes of a unit's profiles and of its rows' masses, about; draws of a unit at most.
TILE, UNIT_BYTES, MASS_BYTES, UNIT_DRAWS = 256, 64 << 20, 64 << 20, 16
#: Numbers of a matrix that a unit computes at a time.
_CHUNK = 1 << 20


def profiles(pairs: DataFrame, z: DataFrame) -> DataFrame:
    """pair_id, i, j, g: squared differences of two rows of z (pos, v)."""
    side = lambda c, name: z.select(F.col("pos").alias(c), F.col("v").alias(name))
    joined = pairs.join(side("i", "a"), "i").join(side("j", "b"), "j").select("pair_id", "i", "j", "a", "b")

    def run(batches):
        for batch in batches:
            g = (arrays.stacked(batch.column("a")) - arrays.stacked(batch.column("b"))) ** 2 if batch.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], arrays.listed(g)], ["pair_id", "i", "j", "g"])

    return joined.mapInArrow(run, "pair_id long, i long, j long, g array<double>")


class Gram:
    """G'G of profiles, divided by the norms (plus eps): columns are computed when they are asked for, in one pass for all
    that are new, and kept.  ``Gram[np.ix_(a, b)]``-like blocks come from ``block``; no features x features matrix is made."""

    def __init__(self, table: DataFrame, width: int) -> None:
        self.table, self.width = table, width
        self.squares = arrays.column_sums(table, "g", width, lambda g: g * g)
        self.norms = np.sqrt(self.squares) + EPS
        self.diagonal = self.squares / self.norms**2
        self.columns: dict[int, np.ndarray] = {}

    def __len__(self) -> int:
        return self.width

    def ensure(self, wanted: Sequence[int]) -> None:
        new = sorted(set(wanted) - self.columns.keys())
        if not new:
            return
        width = self.width

        def run(batches):
            total = np.zeros((len(new), width))
            for batch in batches:
                if batch.num_rows:
                    g = arrays.stacked(batch.column("g"))
                    total += g[:, new].T @ g
            yield pa.RecordBatch.from_arrays([pa.array(new), arrays.listed(total)], ["c", "s"])

        got = self.table.select("g").mapInArrow(run, "c long, s array<double>").select("c", F.posexplode("s").alias("k", "s")).groupBy("c", "k").agg(F.sum("s").alias("s")).toArrow()  # as many numbers as are asked for
        c, k, s = (got.column(x).to_numpy() for x in ("c", "k", "s"))
        for x in new:
            own = np.zeros(width)
            own[k[c == x]] = s[c == x]
            self.columns[x] = own / self.norms[x] / self.norms
            self.columns[x][x] = self.diagonal[x]

    def block(self, a: Sequence[int], b: Sequence[int]) -> np.ndarray:
        a, b = list(a), list(b)
        known = [[x == y or x in self.columns or y in self.columns for y in b] for x in a] if len(a) * len(b) < 65_536 else [[x in self.columns] * len(b) for x in a]
        self.ensure([x for x, row in zip(a, known, strict=True) if not all(row)])
        out = np.zeros((len(a), len(b)))
        for i, x in enumerate(a):
            if x in self.columns:
                out[i] = self.columns[x][b]
            else:
                out[i] = [self.diagonal[x] if x == y else self.columns[y][x] for y in b]
        return out


def gram_table(table: DataFrame, width: int, tile: int = TILE) -> DataFrame:
    """a, b, x: G'G of profiles (g) as a table.  A pass for each tile of rows of the product; a task holds tile * width sums."""
    out = None
    for first in range(0, width, tile):
        rows = list(range(first, min(first + tile, width)))

        def run(batches, rows=rows):
            total = np.zeros((len(rows), width))
            for batch in batches:
                if batch.num_rows:
                    g = arrays.stacked(batch.column("g"))
                    total += g[:, rows].T @ g
            yield pa.RecordBatch.from_arrays([pa.array(rows), arrays.listed(total)], ["a", "s"])

        part = table.select("g").mapInArrow(run, "a long, s array<double>").select("a", F.posexplode("s").alias("b", "x")).groupBy("a", "b").agg(F.sum("x").alias("x"))
        out = part if out is None else out.unionByName(part)
    return out


def unit_gram_table(table: DataFrame, width: int) -> DataFrame:
    """a, b, c: of columns divided by their norms (plus eps)."""
    norms = F.array(*map(F.lit, (np.sqrt(arrays.column_sums(table, "g", width, lambda g: g * g)) + EPS).tolist()))
    return gram_table(table, width).select("a", "b", (F.col("x") / norms[F.col("a").cast("int")] / norms[F.col("b").cast("int")]).alias("c"))


def totals(table: DataFrame, mass: np.ndarray) -> DataFrame:
    """pair_id, i, j, total: the sum over features of the normalised profiles at a pair."""
    share = 1 / (mass + EPS)

    def run(batches):
        for batch in batches:
            total = arrays.stacked(batch.column("g")) @ share if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(total)], ["pair_id", "i", "j", "total"])

    return table.select("pair_id", "i", "j", "g").mapInArrow(run, "pair_id long, i long, j long, total double")


def rest_profiles(table: DataFrame, mass: np.ndarray) -> DataFrame:
    """pair_id, i, j, r: for each feature the normalised mean profile of all others."""
    width, weight = len(mass), mass / (mass + EPS)
    # Sums over pairs of (total - own) / (p - 1), without a pass: total sums to the sum of the weights.
    others = max(width - 1, 1)
    sums = (weight.sum() - weight) / others + EPS

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                p = arrays.stacked(batch.column("g")) / (mass + EPS)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], arrays.listed((p.sum(1, keepdims=True) - p) / others / sums)], ["pair_id", "i", "j", "r"])

    return table.select("pair_id", "i", "j", "g").mapInArrow(run, "pair_id long, i long, j long, r array<double>")


STATISTICS = "b int, k int, affinity double, coverage double"


def statistics(table: DataFrame, z: DataFrame, bank: DataFrame | None, width: int, n: int, draws: int) -> DataFrame:
    """STATISTICS of the profiles as they are (b = -1) and of ``draws`` permutations (bank: b, pos, src), each feature permuted
    against the others as they are."""
    n_pairs = table.count()
    mass = arrays.column_sums(table, "g", width, lambda g: g)
    tile = min(TILE, width)
    tiles = -(-width // tile)
    ranges = max(1, -(-2 * n_pairs * 8 * tile // UNIT_BYTES))
    rows = min(n, 2 * n_pairs, UNIT_BYTES // (8 * tile))
    per_unit = int(np.clip(MASS_BYTES // (8 * tile * rows), 1, min(UNIT_DRAWS, max(1, draws // 16))))
    units = max(1, -(-draws // per_unit))

    ends = totals(table, mass)
    half = ends.select(F.col("i").alias("r"), F.col("j").alias("o"), "total").unionByName(ends.select(F.col("j").alias("r"), F.col("i").alias("o"), "total"))
    half = half.withColumn("part", F.pmod(F.xxhash64("r"), F.lit(ranges)).cast("int"))
    needed = half.select("part", F.explode(F.array("r", "o")).alias("pos")).distinct()
    own = needed.select("part", F.lit(-1).alias("b"), "pos", F.col("pos").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(units - 1))).alias("unit"))
    placed = own
    if bank is not None and draws:
        drawn = bank.select(F.col("b").cast("int").alias("b"), "pos", "src").join(needed, "pos").withColumn("unit", F.floor(F.col("b") / per_unit).cast("int"))
        placed = own.unionByName(drawn.select(*own.columns))
    valued = placed.join(z.select(F.col("pos").alias("src"), "v"), "src").select("unit", "part", "b", "pos", "v")
    every_tile = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    left = valued.withColumn("tile", every_tile).select(*(F.col(c).alias(c) for c in ("unit", "part", "tile")), "b", "pos", F.slice("v", F.col("tile") * tile + 1, F.lit(tile)).alias("v"))
    right = half.withColumn("unit", F.explode(F.sequence(F.lit(0), F.lit(units - 1)))).withColumn("tile", every_tile)

    weight = mass / (mass + EPS)
    others = max(width - 1, 1)
    rest_sums = (weight.sum() - weight) / others + EPS

    def run(key, values: pa.Table, pairs: pa.Table) -> pa.Table:
        t = key[2].as_py()
        own, by = mass[t * tile : (t + 1) * tile] + EPS, others * rest_sums[t * tile : (t + 1) * tile]
        b, pos = values.column("b").to_numpy(), values.column("pos").to_numpy()
        order = np.lexsort((pos, b))
        b, pos, v = b[order], pos[order], arrays.stacked(values.column("v").combine_chunks())[order]
        seen = pos[b == -1]
        draws_here = [x for x in np.unique(b).tolist() if x >= 0]
        z_of = {x: v[np.searchsorted(b, x) : np.searchsorted(b, x, "right")] for x in (-1, *draws_here)}
        shown = ([-1] if key[0].as_py() == 0 else []) + draws_here
        r, o, total = (pairs.column(c).to_numpy() for c in ("r", "o", "total"))
        order = np.lexsort((o, r))
        r, o, total = np.searchsorted(seen, r[order]), np.searchsorted(seen, o[order]), total[order]
        masses = {x: np.zeros((len(seen), v.shape[1])) for x in shown}
        affinity = {x: np.zeros(v.shape[1]) for x in shown}
        step = max(1, _CHUNK // v.shape[1])
        for a in range(0, len(r), step):
            ri, oi = r[a : a + step], o[a : a + step]
            rest = np.sqrt(np.maximum(total[a : a + step, None] - (z_of[-1][ri] - z_of[-1][oi]) ** 2 / own, 0) / by)
            first = np.flatnonzero(np.diff(ri, prepend=-1))
            for x in shown:
                d = z_of[x][ri] - z_of[x][oi]
                affinity[x] += (np.abs(d) * rest).sum(0) / 2  # each pair is met from both ends
                masses[x][ri[first]] += np.add.reduceat(d * d, first)
        out = []
        for x in shown:
            m = masses[x]
            logs = np.log(m, where=m > 0, out=np.zeros_like(m))
            out.append((x, affinity[x], m.sum(0), (m * logs).sum(0), (m > 0).sum(0).astype(float)))
        count = len(out) * v.shape[1]
        k = np.tile(np.arange(v.shape[1]) + t * tile, len(out)).astype(np.int32)
        flat = [np.concatenate([f[c] for f in out]) if out else np.zeros(0) for c in range(1, 5)]
        return pa.table([pa.array(np.repeat([f[0] for f in out], v.shape[1]).astype(np.int32) if count else np.zeros(0, np.int32)), pa.array(k[:count]), *map(pa.array, flat)], names=["b", "k", "s", "m", "l", "n"])

    keys = ("unit", "part", "tile")
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "b int, k int, s double, m double, l double, n double")
    summed = parts.groupBy("b", "k").agg(*(F.sum(c).alias(c) for c in "smln"))
    # The entropy of masses m / T is log T - sum(m log m) / T; the eps inside the logarithm moves it by eps for each row with mass.
    size = F.col("m") + EPS
    entropy = (F.col("m") * F.log(size) - F.col("l")) / size - F.lit(EPS) * F.col("n")
    return summed.select("b", "k", (F.col("s") / F.sqrt(F.col("m") / 2 + EPS)).alias("affinity"), (F.exp(entropy) / F.lit(float(n))).alias("coverage"))


def support_tiles(table: DataFrame, z: DataFrame, bank: DataFrame, width: int, n: int, draws: int, power: float) -> Support:
    """Calibrated support from the null in units; what comes to the driver has a number for each draw and feature."""
    got = statistics(table, z, bank, width, n, draws).toArrow()
    b, k = got.column("b").to_numpy(), got.column("k").to_numpy()
    both = np.zeros((2, width, draws + 1))
    for c, name in enumerate(("affinity", "coverage")):
        both[c, k, b + 1] = got.column(name).to_numpy()
    return calibrate(both[0, :, 0], both[1, :, 0], both[0, :, 1:], both[1, :, 1:], power)
