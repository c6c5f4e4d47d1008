"""Exact nearest neighbours and the scores built on them.

Rows meet in ``blocks``: the work is quadratic by definition, but nothing is sent for a pair of blocks, and a task keeps each row's
nearest ones only.  ``nearest_in_cells`` finds the same edges and leaves out what the triangle inequality allows."""

from __future__ import annotations

from collections.abc import Sequence
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, order, tables
from . import blocks, scaling

EPS = 1e-12
BLOCK_ROWS, ASKED, MOST_CELLS = blocks.BLOCK_ROWS, blocks.ASKED, 1_024
#: Pairs of rows whose differences are held at a time; an id behind all others; columns that meet the edges at a time.
PIECE, LAST_ID, SLICE = 1 << 16, np.iinfo(np.int64).max, 16


def _asks(own) -> np.ndarray:
    """Times (v, square) of another row: the squared distance to it, less the own square."""
    return np.column_stack([-2 * own.v, np.ones(len(own.ids))])


class Nearest(blocks.Meeting):
    """The k nearest rows of each row so far (never itself, ties by id).  Products in single precision say which rows may be among
    them (the slack is above twice their error), differences in double precision which are."""

    schema = "a long, b long, d2 double"

    def __init__(self, k: int) -> None:
        self.k = k

    def prepare(self, block, ids, v):
        square = (v * v).sum(1)
        exact = not square.max(initial=0) < 1e30  # too large for single precision, or no numbers
        kind = np.float64 if exact else np.float32
        low = np.column_stack([v, square]).astype(kind)
        return SimpleNamespace(block=block, ids=ids, v=v, square=square, exact=exact, low=low)

    def begin(self, own):
        shape = (len(own.ids), self.k)
        return SimpleNamespace(own=own, asks=_asks(own).astype(own.low.dtype), ids=np.full(shape, LAST_ID), d=np.full(shape, np.inf))

    def meet(self, state, other, same):
        self.meet_rows(state, np.arange(len(state.own.ids)), other, same)

    def meet_rows(self, state, rows, other, same):
        own = state.own
        exact = own.exact or other.exact
        unit = 2.0 ** (-52 if exact else -23)
        lowest = other.ids[0] if len(other.ids) else 0
        asks, low = (_asks(own), np.column_stack([other.v, other.square])) if exact else (state.asks, other.low)
        longest = np.sqrt(other.square.max(initial=0))
        for begin in range(0, len(rows), ASKED):
            some = rows[begin : begin + ASKED]
            bound, worst = state.d[some, -1], state.ids[some, -1]
            if not len(other.ids) or ((bound == 0) & (worst < lowest)).all():
                continue
            near = asks[some] @ low.T  # less the own square
            if exact:
                near[np.isnan(near)] = np.inf
            if same:
                near[own.ids[some, None] == other.ids] = np.inf
            slack = (own.v.shape[1] + 8) * unit * (np.sqrt(own.square[some]) + longest) ** 2
            limit = bound - own.square[some] + slack
            if (open_ := np.isinf(bound)).any():
                k = min(self.k, len(other.ids)) - 1
                limit[open_] = np.partition(near[open_], k, axis=1)[:, k] + 2 * slack[open_]
            if exact:
                limit[np.isnan(limit)] = np.inf
            hit = np.flatnonzero(near <= limit.astype(near.dtype)[:, None])
            row, col = hit // len(other.ids), hit % len(other.ids)
            if len(row):
                wanted = (bound[row] > 0) | (other.ids[col] < worst[row])
                if same:
                    wanted &= own.ids[some[row]] != other.ids[col]
                row, col = some[row[wanted]], col[wanted]
            for first in range(0, len(row), PIECE):
                self._take(state, row[first : first + PIECE], other, col[first : first + PIECE])

    def _take(self, state, row, other, col):
        d = ((state.own.v[row] - other.v[col]) ** 2).sum(1)
        some = d <= state.d[row, -1]  # not with NaN
        row, ids, d = row[some], other.ids[col[some]], d[some]
        rows = np.unique(row)
        row = np.concatenate([np.repeat(rows, self.k), row])
        ids, d = np.concatenate([state.ids[rows].ravel(), ids]), np.concatenate([state.d[rows].ravel(), d])
        by_row = np.lexsort((ids, d, row))
        row, ids, d = row[by_row], ids[by_row], d[by_row]
        best = np.arange(len(row)) - np.searchsorted(row, row) < self.k
        state.ids[rows], state.d[rows] = ids[best].reshape(-1, self.k), d[best].reshape(-1, self.k)

    def finish(self, state):
        row, place = np.nonzero(np.isfinite(state.d))
        return pa.RecordBatch.from_arrays([pa.array(state.own.ids[row]), pa.array(state.ids[row, place]), pa.array(state.d[row, place])], ["a", "b", "d2"])


def _rows(df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("a"), F.array(*(F.col(c).cast("double") for c in features)).alias("v"))


def nearest(df: DataFrame, key: str, features: Sequence[str], k: int) -> DataFrame:
    """a, b, d2: the k nearest other rows of each row (ties by key), found now and written."""
    table = blocks.packed(_rows(df, key, features))
    edges = tables.written(blocks.met(table, Nearest(k)))
    tables.discard(table)
    return edges


class NearestInCells(Nearest):
    """As ``Nearest``, where a row asks only blocks whose cell the triangle inequality does not leave out."""

    schema = "a long, b long, d2 double, x int, y int, n long"

    def __init__(self, k: int, cells: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> None:
        super().__init__(k)
        self.cells, self.centres, self.radius = cells, centres, radius  # the cell of each block, and of each cell

    def begin(self, own):
        state = super().begin(own)
        super().meet(state, own, True)  # first, for a bound
        state.asked = []
        return state

    def meet(self, state, other, same):
        if same:
            return
        cell = self.cells[other.block]
        away = np.sqrt(((state.own.v - self.centres[cell]) ** 2).sum(1))  # by differences: no cancellation
        rows = np.flatnonzero(away <= np.sqrt(state.d[:, -1]) + self.radius[cell] + 1e-9 * (1 + away))
        if len(rows):
            state.asked.append((other.block, len(rows)))
            self.meet_rows(state, rows, other, False)

    def finish(self, state):
        edges = super().finish(state)
        y, n = np.array(state.asked, np.int64).reshape(-1, 2).T
        edge, block = pa.nulls(len(y), pa.int64()), pa.nulls(edges.num_rows, pa.int32())
        both = lambda one, other: pa.concat_arrays([one, other])
        asked = [both(block, pa.array(np.full(len(y), state.own.block, np.int32))), both(block, pa.array(y.astype(np.int32))), both(block.cast(pa.int64()), pa.array(n))]
        return pa.RecordBatch.from_arrays([both(edges.column("a"), edge), both(edges.column("b"), edge), both(edges.column("d2"), edge.cast(pa.float64())), *asked], ["a", "b", "d2", "x", "y", "n"])


def nearest_in_cells(df: DataFrame, key: str, features: Sequence[str], k: int, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """As ``nearest`` (the same edges), and x, y, n: how many rows of block x were compared with block y.

    Rows lie in cells around rows taken in the order of a hash (MOST_CELLS at most; a full cell is cut into blocks of about
    ``block_rows``).  A row's own block, then what else it was compared with, gives a bound on its k-th distance; by the triangle
    inequality it need not ask a cell whose centre is farther than that bound plus the cell's radius.  A row that has no k others
    yet asks all."""
    n = df.count()
    if not n:
        return nearest(df, key, features, k), df.sparkSession.createDataFrame([], "x int, y int, n long")
    rows = _rows(df, key, features)
    cells = min(MOST_CELLS, -(-n // block_rows))
    centres = np.array([r.v for r in rows.orderBy(F.xxhash64("a"), "a").limit(cells).collect()])

    def place(batches):
        for batch in batches:
            v = arrays.stacked(batch.column("v"))
            d = np.sqrt(np.stack([((v - c) ** 2).sum(1) for c in centres], 1))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("v"), pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1))], ["a", "v", "cell", "r"])

    placed = tables.written(rows.mapInArrow(place, "a long, v array<double>, cell int, r double"))
    size, radius = np.zeros(cells, np.int64), np.zeros(cells)
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("r").alias("r")).collect():  # a row for each cell
        size[r.cell], radius[r.cell] = r.n, r.r
    parts = np.maximum(-(-size // block_rows), 1)
    start = np.cumsum(parts) - parts
    starts = df.sparkSession.createDataFrame([(c, int(start[c]), int(parts[c])) for c in range(cells)], "cell int, start int, parts int")
    table = blocks.packed(placed.join(F.broadcast(starts), "cell").select("a", "v", (F.col("start") + F.pmod(F.xxhash64("a"), F.col("parts"))).cast("int").alias("block")))  # MOST_CELLS rows
    tables.discard(placed)
    found = tables.written(blocks.met(table, NearestInCells(k, np.repeat(np.arange(cells), parts), centres, radius)))
    tables.discard(table)
    return found.where("a is not null").select("a", "b", "d2"), found.where("x is not null").select("x", "y", "n")


def heat_graph(edges: DataFrame, t: float | None = None) -> DataFrame:
    """a, b, w in both directions: exp(-d2 / t) of an edge that either end has; t: median of the positive d2.  Columns are
    expected to be standardised."""
    if t is None:
        t = float(np.nan_to_num(order.quantiles(order.Columns(edges.where("d2 > 0"), ["d2"]), (0.5,))[0, 0])) or 1.0
    both = edges.select("a", "b", "d2").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "d2"))
    return both.groupBy("a", "b").agg(F.max(F.exp(-F.col("d2") / F.lit(max(t, EPS)))).alias("w"))


def laplacian_scores(graph: DataFrame, df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """feature, score: f'Lf / f'Df of each feature centred by degree; small is smooth.  graph: (a, b, w) in both directions.  Edges meet
    the columns of both ends, SLICE columns at a time, whose shuffle files go before the next ones."""
    spark = df.sparkSession
    degree = graph.groupBy("a").agg(F.sum("w").alias("d"))
    once = graph.where("a < b")  # stands for its other direction too
    cut, mass = np.zeros(len(features)), np.zeros(len(features))
    with tables.freeing(spark):
        for first in range(0, len(features), SLICE):
            some = slice(first, first + SLICE)
            x = _rows(df, key, features[some])
            width = len(features[some])
            ends = once.join(x, "a").join(x.select(F.col("a").alias("b"), F.col("v").alias("u")), "b")
            apart = ends.select(F.concat(F.array("w"), "v", "u").alias("e"))
            cut[some] = arrays.column_sums(apart, "e", width, lambda e, width=width: e[:, :1] * (e[:, 1 : width + 1] - e[:, width + 1 :]) ** 2)
            weighted = degree.join(x, "a").select(F.concat(F.array("d"), "v").alias("e"))
            sums = arrays.column_sums(weighted, "e", width + 1, lambda e: e[:, :1] * np.column_stack([np.ones(len(e)), e[:, 1:]]))
            mean = sums[1:] / (sums[0] + EPS)
            mass[some] = arrays.column_sums(weighted, "e", width, lambda e, mean=mean: e[:, :1] * (e[:, 1:] - mean) ** 2)
    return spark.createDataFrame([(c, float(cut[i] / (mass[i] + EPS))) for i, c in enumerate(features)], "feature string, score double")


def preserved(full: DataFrame, part: DataFrame, k: int) -> DataFrame:
    """preservation: share of the neighbours in all columns that are neighbours in the selected ones too."""
    kept = full.join(part.select("a", "b"), ["a", "b"], "left_semi")
    total = full.agg(F.count("*").alias("n"))
    return kept.agg(F.count("*").alias("k")).join(total).select((F.col("k") / F.col("n")).alias("preservation"))  # one row each


def preservation(df: DataFrame, key: str, features: Sequence[str], selected: Sequence[str], k: int = 10) -> DataFrame:
    """preservation of the selected columns, both spaces standardised: null without selected columns or with fewer than
    three rows, 1 if all are selected."""
    spark = df.sparkSession
    if set(selected) == set(features):
        return spark.createDataFrame([(1.0,)], "preservation double")
    n = df.count()
    if not selected or n < 3:
        return spark.createDataFrame([(None,)], "preservation double")
    z, k = scaling.mean_sd(df, features).apply(df), min(k, n - 1)
    return preserved(nearest(z, key, features, k), nearest(z, key, selected, k), k)
