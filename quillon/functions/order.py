"""Deterministic, partition-independent order and randomness."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled(salt: str, seed: int, *keys) -> Column:
    """Sort by this for a random order that depends on the keys alone."""
    return F.md5(F.concat_ws(":", F.lit(salt), F.lit(str(seed)), *(k.cast("string") if isinstance(k, Column) else F.col(k).cast("string") for k in keys)))


def positions(df: DataFrame, *order, name: str = "pos") -> DataFrame:
    """Dense positions 0.. in an order, without a window over all rows in one task: a range sort, then
    each partition's offset from the sizes of those before it.  A partition that is lost is sorted again out of the same
    ranges, so its numbers stay where ``order`` ends with a unique column."""
    ordered = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()).persist()  # what numbers the rows must not be computed twice
    part = F.shiftrightunsigned("_at", 33)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("_before", before).select("_part", "_before")
    numbered = ordered.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return numbered.withColumn(name, F.col("_at") - F.shiftleft("_part", 33) + F.col("_before")).drop("_at", "_part", "_before")


#: Up to so many values an exact aggregate is taken; beyond, the values are narrowed down first.
FEW_VALUES, BAND, BINS = 1_000_000, 10_000, 4_096


def value_at(df: DataFrame, column: str, place: int) -> float:
    """The value at a 0-based place of a column's finite, not null values in order: each pass counts them in BINS bins of the
    interval that must hold it, until the interval has BAND values or one."""
    x = df.select(F.col(column).cast("double").alias("x"))
    got = x.agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).first()
    n, low, high = got.n, got.low, got.high
    while n > BAND and high > low:
        width = (high - low) / BINS
        if not low + width > low:
            break
        inside = x.where((F.col("x") >= low) & (F.col("x") <= high))
        bins = inside.groupBy(F.least(F.floor((F.col("x") - low) / width), F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        for r in sorted(bins.collect(), key=lambda r: r.bin):  # BINS rows at most
            if place < r.n:
                n, low, high = r.n, r.low, r.high
                break
            place -= r.n
    values = x.where((F.col("x") >= low) & (F.col("x") <= high)).groupBy("x").agg(F.count("*").alias("n"))
    for r in values.orderBy("x").toLocalIterator():  # BAND values at most, or one
        if place < r.n:
            return r.x
        place -= r.n
    raise ValueError("the place is behind the last value")


def quantile(df: DataFrame, column: str, q: float) -> float | None:
    """Interpolated linearly between the two nearest values; None without values.  No task holds all of them."""
    n = df.agg(F.count(column)).first()[0]
    if not n:
        return None
    if n <= FEW_VALUES:
        return df.agg(F.percentile(F.col(column).cast("double"), F.lit(q))).first()[0]
    at = q * (n - 1)
    low = value_at(df, column, int(at))
    return low if at == int(at) else low + (value_at(df, column, int(at) + 1) - low) * (at - int(at))


def median(df: DataFrame, column: str) -> float | None:
    return quantile(df, column, 0.5)


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """With the 1-based rank of each value, ties sharing their mean: values are counted, and the counts before each one come
    from a range sort with the offsets of the partitions before."""
    counts = df.groupBy(column).agg(F.count("*").alias("_n"))
    ordered = counts.orderBy(column).withColumn("_at", F.monotonically_increasing_id()).persist()
    part = F.shiftrightunsigned("_at", 33)
    own = Window.partitionBy("_part").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    placed = ordered.withColumn("_part", part)
    sizes = placed.groupBy("_part").agg(F.sum("_n").alias("_t"))  # a row for each partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_t").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    ranks = placed.withColumn("_b", F.coalesce(F.sum("_n").over(own), F.lit(0))).join(F.broadcast(offsets), "_part")
    return df.join(ranks.select(column, (F.col("_b") + F.col("_o") + (F.col("_n") + 1) / 2).alias(name)), column)


#: Counts that a pass keeps for all series together, and values that are fetched in the end.
MANY_COUNTS, MANY_VALUES = 1 << 18, 100_000


class Series:
    """Many series of numbers in one table, each given to numpy a batch at a time: ``names`` and, for a batch, pairs (index of
    the series, its values).  Nulls, NaN and infinities do not count."""

    def __init__(self, df: DataFrame, names: Sequence) -> None:
        self.df, self.names = df, list(names)

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "df"}  # the table stays on the driver

    def of(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        raise NotImplementedError

    def finite(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for k, x in self.of(batch):
            yield k, x[np.isfinite(x)]


class Columns(Series):
    """Numeric columns of a table."""

    def __init__(self, df: DataFrame, names: Sequence[str]) -> None:
        super().__init__(df.select(*(F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(names))), names)

    def of(self, batch):
        for k in range(len(self.names)):
            yield k, batch.column(k).to_numpy(zero_copy_only=False).astype(float)


class Components(Series):
    """Components of an array column of one length, less a centre and without sign if that is given."""

    def __init__(self, df: DataFrame, column: str, width: int, centre: np.ndarray | None = None) -> None:
        super().__init__(df.select(F.col(column).cast("array<double>").alias("v")), range(width))
        self.centre = centre

    def of(self, batch):
        x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        if self.centre is not None:
            x = np.abs(x - self.centre)
        yield from enumerate(np.ascontiguousarray(x.T))


class Indexed(Series):
    """Values x by an index k of 0 to ``width`` - 1."""

    def __init__(self, df: DataFrame, width: int) -> None:
        super().__init__(df.select(F.col("k").cast("int").alias("k"), F.col("x").cast("double").alias("x")), range(width))

    def of(self, batch):
        k, x = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "x"))
        by = np.argsort(k, kind="stable")
        first = np.flatnonzero(np.diff(k[by], prepend=-1))
        for a, b in zip(first, [*first[1:], len(k)], strict=True):
            yield int(k[by[a]]), x[by[a:b]]


class Groups(Series):
    """A value column by the values of another: ``names`` are those (a few, as methods or data sets are)."""

    def __init__(self, df: DataFrame, by: str, value: str) -> None:
        super().__init__(df.select(F.col(by).cast("string").alias("k"), F.col(value).cast("double").alias("x")), [r[0] for r in df.select(F.col(by).cast("string")).distinct().collect()])

    def of(self, batch):
        place = {name: k for k, name in enumerate(self.names)}
        keys = batch.column("k").dictionary_encode()
        codes = keys.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        x = batch.column("x").to_numpy(zero_copy_only=False).astype(float)
        for code, name in [(-1, None), *enumerate(keys.dictionary.to_pylist())]:
            if (inside := codes == code).any():
                yield place[name], x[inside]


def _place(x: np.ndarray) -> np.ndarray:
    """Doubles as integers of the same order: their bits, those of negative ones turned over."""
    bits = np.ascontiguousarray(x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def _value(place: int) -> float:
    return float(np.int64(place if place >= 0 else place ^ 0x7FFFFFFFFFFFFFFF).view(np.float64))


def quantiles(series: Series, shares: Iterable[float]) -> np.ndarray:
    """series x shares: quantiles of all series at once, interpolated linearly between the two nearest values; NaN for a series
    without values.

    A pass counts the values of every interval that may hold a wanted place in bins, in one array for each
    task; the interval shrinks to the bin, until the values that are left are few enough to be fetched with their counts.
    So a task holds MANY_COUNTS counts and a batch, whatever the rows.  Bins divide the order of doubles, not their range:
    outliers cost no passes, and with 4,096 bins there are six at most."""
    shares, width = list(shares), len(series.names)
    if not width:
        return np.zeros((0, len(shares)))

    def limits(batches):
        n, low, high = np.zeros(width, np.int64), np.full(width, np.inf), np.full(width, -np.inf)
        for batch in batches:
            for k, x in series.finite(batch):
                if len(x):
                    n[k], low[k], high[k] = n[k] + len(x), min(low[k], x.min()), max(high[k], x.max())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(n), pa.array(low), pa.array(high)], ["k", "n", "low", "high"])

    got = series.df.mapInArrow(limits, "k long, n long, low double, high double").groupBy("k").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()  # a row for each series
    n, low, high = np.zeros(width, np.int64), np.zeros(width), np.zeros(width)
    for r in got:
        n[r.k], low[r.k], high[r.k] = r.n, r.low, r.high
    found: dict[tuple[int, int], float] = {}
    tasks = []  # open intervals: (series, lowest and highest place, values inside, {wanted rank: rank inside})
    for k in np.flatnonzero(n):
        ranks = {int(x) for q in shares for x in (np.floor(q * (n[k] - 1)), np.ceil(q * (n[k] - 1)))}
        tasks.append((int(k), *map(int, _place(np.array([low[k], high[k]]))), int(n[k]), {p: p for p in ranks}))
    while True:
        for k, lower, upper, _, ranks in tasks:
            if lower == upper:
                found |= {(k, wanted): _value(lower) for wanted in ranks}
        tasks = [t for t in tasks if t[1] < t[2]]
        if all(t[3] <= max(1, MANY_VALUES // len(tasks)) for t in tasks):
            break
        bins = max(2, min(4_096, MANY_COUNTS // len(tasks)))
        steps = [-(-(t[2] - t[1] + 1) // bins) for t in tasks]
        by_series: dict[int, list[int]] = {}
        for a, t in enumerate(tasks):
            by_series.setdefault(t[0], []).append(a)

        def count(batches, tasks=tasks, steps=steps, by_series=by_series, bins=bins):
            counts = np.zeros((len(tasks), bins), np.int64)
            for batch in batches:
                for k, x in series.finite(batch):
                    place = _place(x)
                    for a in by_series.get(k, ()):
                        inside = place[(place >= tasks[a][1]) & (place <= tasks[a][2])]
                        with np.errstate(over="ignore"):
                            apart = inside.astype(np.uint64) - np.uint64(tasks[a][1] % 2**64)
                        counts[a] += np.bincount((apart // np.uint64(steps[a])).astype(np.int64), minlength=bins)
            at, b = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(b), pa.array(counts[at, b])], ["a", "b", "n"])

        counts = np.zeros((len(tasks), bins), np.int64)
        table = series.df.mapInArrow(count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()  # MANY_COUNTS at most
        counts[table.column("a").to_numpy(), table.column("b").to_numpy()] = table.column("n").to_numpy()
        after = []
        for a, (k, lower, upper, _, ranks) in enumerate(tasks):
            before = np.concatenate([[0], np.cumsum(counts[a])])
            inner: dict[int, dict[int, int]] = {}
            for wanted, rank in ranks.items():
                b = int(np.searchsorted(before, rank, "right")) - 1
                inner.setdefault(b, {})[wanted] = rank - int(before[b])
            after += [(k, lower + b * steps[a], min(upper, lower + (b + 1) * steps[a] - 1), int(counts[a][b]), own) for b, own in inner.items()]
        tasks = after

    def fetch(batches):
        for batch in batches:
            for k, x in series.finite(batch):
                place = _place(x)
                for a, t in enumerate(tasks):
                    if t[0] == k:
                        values, times = np.unique(x[(place >= t[1]) & (place <= t[2])], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), a)), pa.array(values), pa.array(times)], ["a", "x", "n"])

    if tasks:
        rows = series.df.mapInArrow(fetch, "a long, x double, n long").groupBy("a", "x").agg(F.sum("n").alias("n")).toArrow().sort_by([("a", "ascending"), ("x", "ascending")])  # MANY_VALUES at most
        a, x, times = (rows.column(c).to_numpy() for c in ("a", "x", "n"))
        for at, t in enumerate(tasks):
            ends = np.cumsum(times[a == at])
            for wanted, rank in t[4].items():
                found[t[0], wanted] = float(x[a == at][np.searchsorted(ends, rank, "right")])
    out = np.full((width, len(shares)), np.nan)
    for k in np.flatnonzero(n):
        for c, q in enumerate(shares):
            at = q * (n[k] - 1)
            first, last = found[int(k), int(np.floor(at))], found[int(k), int(np.ceil(at))]
            out[k, c] = first + (last - first) * (at - np.floor(at)) if last > first else first
    return out
