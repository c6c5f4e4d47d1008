"""Granular balls and a random walk over features: a ranking that needs no pairs of rows beyond the balls' own.

1. Rows lie in one ball.  A ball splits at its two farthest rows, each row going to the nearer one, as long as its halves are denser
   (their mean distance sums, weighted by size, are below its own); then balls that are more than twice as wide as usual split
   on.  A round of Spark jobs splits all large balls at once; a ball of at most ``BALL_ROWS`` rows is one task's, with all
   that comes of it.
2. Two features are linked by how badly one covers the other over the balls: for a row, with m the kernel of its value and the balls'
   centres, min over balls of max(1 - m_i, m_j), divided by max over balls of min(m_i, m_j); the largest over all rows counts.
   Rows stay where they are; centres are broadcast in blocks of ``CENTRE_BYTES``.  A part of the balls bounds a row's ratio from
   above, so a row leaves the pairs that another row has beaten, and only what is left goes on to the next block.
3. A walk over this graph with restarts, momentum, decay of visits and a projection to the L1 ball gives the scores.  It runs on the
   driver over one matrix of features by features, whose size is checked.

The farthest pair of a ball is exact.  Rows too near to the centre to end it are left out first; the others meet in ``blocks``,
which is quadratic in their number.  Ties go by the rows' positions.
"""

from __future__ import annotations

from collections.abc import Sequence
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, order, tables
from ..functions.tables import kept
from ..sources.matrix import matrix
from . import blocks, scaling
from .rankers import Ranking, top_k
from .selector import ParameterError

EPS = 1e-12
#: Rows of a ball that one task splits; rows of a block of a larger one; balls whose facts are broadcast; bytes of centres sent at a time;
#: features that the walk's matrix may have.
BALL_ROWS, BLOCK_ROWS, FEW_BALLS, CENTRE_BYTES, MOST_FEATURES = 4_000, 1_000, 10_000, 16 << 20, 4_096
#: Balls that a row's pairs of features meet first; numbers held at a time; features whose first and last rows go first.
FIRST_BALLS, CELLS, END_FEATURES = 16, 1 << 20, 64


def least_rows(n: int) -> int:
    """Rows that a ball needs to split.  (Larger sizes for more rows are overruled in the published rule, so 16 is the largest.)"""
    root = n**0.5
    return 16 if root > 16 else 8 if root > 8 else int(root)


def _ends(d2: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool) -> list[tuple[float, int, int]]:
    """(distance, position, position) of the first two ordered pairs at the largest distance of two blocks."""
    most = d2.max()
    at = np.argwhere(d2 == most)
    pairs = {(int(low[r]), int(high[c])) for r, c in at}
    if not same:
        pairs |= {(c, r) for r, c in pairs}
    return [(float(most), *p) for p in sorted(pairs)[:2]]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances from differences, column by column: equal rows have exactly 0."""
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        out += (a[:, k, None] - b[None, :, k]) ** 2
    return out


def _local_halves(v: np.ndarray) -> np.ndarray | None:
    """Is a row of the second half?  None: all rows are equal."""
    best: list[tuple[float, int, int]] = []
    place = np.arange(len(v))
    for a in range(0, len(v), BLOCK_ROWS):
        for b in range(a, len(v), BLOCK_ROWS):
            x, y = slice(a, a + BLOCK_ROWS), slice(b, b + BLOCK_ROWS)
            best += _ends(_distances(v[x], v[y]), place[x], place[y], a == b)
    most = max(x[0] for x in best)
    if most == 0:
        return None
    _, p, q = sorted(x for x in best if x[0] == most)[1]
    first, second = (_distances(v, v[[x]])[:, 0] for x in (p, q))
    return first >= second


def _spread(v: np.ndarray) -> tuple[float, float]:
    """Sum of the distances to the centre (the number of rows if that is 0), and the largest."""
    d = np.sqrt(((v - v.mean(0)) ** 2).sum(1))
    return float(d.sum()) or float(len(v)), float(d.max())


def _leaves(v: np.ndarray, least: int, limit: float | None) -> list[str]:
    """The path of each row within a ball that one task splits for good.  limit: split by radius, else by density."""
    paths, todo = [""] * len(v), [(np.arange(len(v)), "")]
    while todo:
        rows, path = todo.pop()
        own = v[rows]
        spread, radius = _spread(own)
        upper = None
        if len(rows) >= least and (limit is None or radius > limit):
            upper = _local_halves(own)
        if upper is not None and limit is None:
            halves = own[~upper], own[upper]
            if not sum(len(h) * _spread(h)[0] for h in halves) / len(own) < spread:
                upper = None
        if upper is None:
            for r in rows:
                paths[r] = path
        else:
            todo += [(rows[~upper], path + "0"), (rows[upper], path + "1")]
    return paths


def _facts(rows: DataFrame, facts: DataFrame, balls: int) -> DataFrame:
    """Joined by ball: few balls are sent to every task, many are small enough to be dealt out."""
    return rows.join(F.broadcast(facts) if balls <= FEW_BALLS else facts, "ball")


def centres(rows: DataFrame) -> DataFrame:
    """ball, n, centre of rows (ball, v)."""
    means = rows.select("ball", F.posexplode("v").alias("k", "x")).groupBy("ball", "k").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return means.groupBy("ball").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("centre"))


def _distance(a: str, b: str):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


class Farthest(blocks.Meeting):
    """The first two ordered pairs at the largest distance between a block and the blocks of its ball from it on.  Rows end with their
    position; products say which pairs may be the farthest, differences which are."""

    schema = "ball string, d double, i long, j long, p array<double>, q array<double>"

    def __init__(self, balls: Sequence[tuple[str, int]]) -> None:
        self.names, self.starts = [b for b, _ in balls], np.array([first for _, first in balls])  # rising

    def prepare(self, block, ids, v):
        square = (v * v).sum(1)
        one = np.ones(len(v))
        asks, other = np.column_stack([-2 * v, square, one]), np.column_stack([v, one, square])
        return SimpleNamespace(block=block, ball=int(np.searchsorted(self.starts, block, "right")) - 1, ids=ids, v=v, square=square, asks=asks, other=other)

    def begin(self, own):
        return SimpleNamespace(own=own, best=[])

    def meet(self, state, other, same):
        own = state.own
        if own.ball != other.ball or other.block < own.block:
            return
        slack = (own.v.shape[1] + 8) * 2.0**-50 * (np.sqrt(own.square.max()) + np.sqrt(other.square.max())) ** 2
        for first in range(0, len(own.ids), blocks.ASKED):
            near = own.asks[first : first + blocks.ASKED] @ other.other.T
            least = max(near.max(), state.best[0][0] if state.best else 0.0) - slack
            row, col = np.nonzero(near >= least)
            for a in range(0, len(row), blocks.BLOCK_ROWS**2 // 4):
                r, c = first + row[a : a + blocks.BLOCK_ROWS**2 // 4], col[a : a + blocks.BLOCK_ROWS**2 // 4]
                d = np.zeros(len(r))
                for k in range(own.v.shape[1]):  # as _distances adds them up
                    d += (own.v[r, k] - other.v[c, k]) ** 2
                at = np.flatnonzero(d == d.max())
                pairs = {(int(own.ids[r[x]]), int(other.ids[c[x]])): (own.v[r[x]], other.v[c[x]]) for x in self._first(own.ids[r[at]], other.ids[c[at]], at)}
                if not same:
                    pairs |= {(int(other.ids[c[x]]), int(own.ids[r[x]])): (other.v[c[x]], own.v[r[x]]) for x in self._first(other.ids[c[at]], own.ids[r[at]], at)}
                found = [*state.best, *((float(d.max()), *ids, *ends) for ids, ends in pairs.items())]
                most = max(x[0] for x in found)
                state.best = sorted((x for x in found if x[0] == most), key=lambda x: x[1:3])[:2]

    @staticmethod
    def _first(i: np.ndarray, j: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The first two by (i, j)."""
        return at[np.lexsort((j, i))[:2]]

    def finish(self, state):
        best = state.best
        columns = [pa.array([self.names[state.own.ball]] * len(best), pa.string()), *(pa.array([x[k] for x in best], kind) for k, kind in ((0, pa.float64()), (1, pa.int64()), (2, pa.int64()))), *(pa.array([x[k].tolist() for x in best], pa.list_(pa.float64())) for k in (3, 4))]
        return pa.RecordBatch.from_arrays(columns, ["ball", "d", "i", "j", "p", "q"])


def _farthest(rows: DataFrame, balls: int) -> DataFrame:
    """ball, p, q (vectors): the ends of the farthest pair of each ball of rows (ball, pos, v, d: to the centre)."""
    wide = rows.groupBy("ball").agg(F.max("d").alias("radius"), F.max_by("v", F.struct("d", -F.col("pos"))).alias("edge"))
    sighted = _facts(rows, wide, balls).withColumn("seen", _distance("v", "edge"))
    known = sighted.groupBy("ball").agg(F.max("seen").alias("known"))
    able = kept(_facts(sighted, known, balls).where(F.col("d") + F.col("radius") >= F.col("known") * (1 - 1e-9)).select("ball", "pos", "v"))
    sizes = sorted((r.ball, -(-r.n // BLOCK_ROWS)) for r in able.groupBy("ball").agg(F.count("*").alias("n")).collect())  # a row for each ball of more than BALL_ROWS
    starts = np.cumsum([0, *(n for _, n in sizes)])[:-1].tolist()
    numbers = rows.sparkSession.createDataFrame([(b, first, n) for (b, n), first in zip(sizes, starts, strict=True)], "ball string, start int, blocks int")
    table = blocks.packed(_facts(able, numbers, balls).select(F.col("pos").alias("a"), "v", (F.col("start") + F.pmod(F.xxhash64("pos"), F.col("blocks"))).cast("int").alias("block")))
    ends = tables.written(blocks.met(table, Farthest([(b, first) for (b, _), first in zip(sizes, starts, strict=True)])))
    tables.discard(table)
    first_two = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("d")).alias("d"), "i", "j", "p", "q"))), 1, 2)  # two for each block
    return ends.groupBy("ball").agg(first_two.alias("two")).where("two[0].d < 0").select("ball", F.col("two")[1]["p"].alias("p"), F.col("two")[1]["q"].alias("q"))


def _split_large(rows: DataFrame, balls: int, limit: float | None) -> DataFrame:
    """rows (pos, v, ball) of balls that may split, each with its ball after it, and ``open``: has that to be looked at again?"""
    own = kept(_facts(rows, centres(rows), balls).withColumn("d", _distance("v", "centre")).select("pos", "v", "ball", "n", "d"))
    spread = own.groupBy("ball").agg(F.sum("d").alias("spread"), F.max("d").alias("radius"), F.first("n").alias("n"))
    wanted = own if limit is None else _facts(own, spread.where(F.col("radius") > limit).select("ball"), balls)
    ends = kept(_farthest(wanted, balls))
    halved = _facts(wanted, ends, balls).select("pos", "v", "ball", F.concat("ball", F.when(_distance("v", "p") < _distance("v", "q"), "0").otherwise("1")).alias("half"))
    if limit is None:
        parts = halved.select("pos", "v", F.col("half").alias("ball"))
        apart = _facts(parts, centres(parts), 2 * balls).withColumn("d", _distance("v", "centre")).groupBy("ball").agg(F.sum("d").alias("d"), F.count("*").alias("n"))
        share = apart.select(F.expr("substring(ball, 1, length(ball) - 1)").alias("ball"), (F.col("n") * F.when(F.col("d") != 0, F.col("d")).otherwise(F.col("n"))).alias("d"))
        both = share.groupBy("ball").agg(F.sum("d").alias("both"))
        good = both.join(spread, "ball").where(F.col("both") / F.col("n") < F.when(F.col("spread") != 0, F.col("spread")).otherwise(F.col("n"))).select("ball")
        halved = _facts(halved, good, balls)
    moved = halved.select("pos", "half")
    return rows.join(moved, "pos", "left").select("pos", "v", F.coalesce("half", "ball").alias("ball"), F.col("half").isNotNull().alias("open"))


def _split(rows: DataFrame, least: int, limit: float | None) -> DataFrame:
    """rows (pos, v, ball) after all splits by one rule."""
    state = rows.withColumn("open", F.lit(True))
    while True:
        sizes = state.where("open").groupBy("ball").agg(F.count("*").alias("size"))
        large = kept(sizes.where(F.col("size") > max(BALL_ROWS, least - 1)).select("ball"))
        balls = large.count()
        if not balls:
            break
        big = _facts(state.where("open"), large, balls).select("pos", "v", "ball")
        rest = (state.where("open").join(F.broadcast(large) if balls <= FEW_BALLS else large, "ball", "left_anti").select("pos", "v", "ball", "open")).unionByName(state.where("not open"))
        state = kept(rest.unionByName(_split_large(big, balls, limit)))

    def run(table):
        ordered = table.sort_by("pos")
        paths = _leaves(np.stack(ordered.column("v").to_numpy()), least, limit)
        return ordered.set_column(ordered.schema.get_field_index("ball"), "ball", pa.array([b + p for b, p in zip(ordered.column("ball").to_pylist(), paths, strict=True)]))

    local = state.where("open").select("pos", "v", "ball").groupBy("ball").applyInArrow(run, "pos long, v array<double>, ball string")
    closed = state.where("not open").select("pos", "v", "ball")
    return kept(local.unionByName(closed))


def balls(rows: DataFrame) -> DataFrame:
    """pos, v, ball (a path of splits) for rows (pos, v)."""
    n = rows.count()
    first = _split(rows.select("pos", "v", F.lit("r").alias("ball")), max(least_rows(n), 2), None)
    facts = centres(first)
    radii = _facts(first, facts, facts.count()).withColumn("d", _distance("v", "centre")).groupBy("ball").agg(F.max("d").alias("radius"), F.count("*").alias("n")).where("n >= 2")
    middle = order.median(radii, "radius")
    if middle is None:
        return first
    mean = radii.agg(F.avg("radius")).first()[0]
    return _split(first, 2, 2 * max(middle, mean))


def kernel(values: np.ndarray, centre: np.ndarray, smooth: np.ndarray, width: float) -> np.ndarray:
    """features x balls for one row: a Gaussian of the difference, or equality where a feature is not ``smooth``."""
    difference = values[:, None] - centre
    return np.where(smooth[:, None], np.exp(-(difference**2) / (2 * width**2 + EPS)), (difference == 0).astype(float))


class _Pairs:
    """Pairs of features (i * p + j) that one row may still raise: the two covering measures over the balls so far."""

    def __init__(self, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.at, self.low, self.high = at, low, high

    def ratio(self) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.low / self.high

    def prune(self, most: np.ndarray) -> None:
        """More balls only lower a ratio (``low`` falls, ``high`` rises), so pairs go whose ratio is no larger than one that is known."""
        alive = ~(self.ratio() <= most[self.at])  # stays if it is no number
        if not alive.all():
            self.at, self.low, self.high = self.at[alive], self.low[alive], self.high[alive]


def _first_balls(v: np.ndarray, centre: np.ndarray, smooth: np.ndarray, width: float, most: np.ndarray) -> _Pairs:
    """All pairs over a few balls, pruned; some features at a time."""
    p = len(v)
    m = kernel(v, centre, smooth, width)
    step, parts = max(1, CELLS // (p * m.shape[1])), []
    for a in range(0, p, step):
        x = m[a : a + step, None, :]
        pairs = _Pairs(np.arange(a * p, min(a + step, p) * p), np.maximum(1 - x, m).min(2).ravel(), np.minimum(x, m).max(2).ravel())
        pairs.prune(most)
        parts.append(pairs)
    return _Pairs(*(np.concatenate([getattr(x, c) for x in parts]) for c in ("at", "low", "high")))


def _covering(v: np.ndarray, centre: np.ndarray, smooth: np.ndarray, width: float, most: np.ndarray, pairs: _Pairs | None) -> _Pairs:
    """What is left of a row's pairs after these balls; None: all pairs."""
    p, at, step = len(v), 0, FIRST_BALLS
    if pairs is None:
        pairs, at = _first_balls(v, centre[:, :step], smooth, width, most), step
    while at < centre.shape[1] and len(pairs.at):
        step = min(4 * step, max(FIRST_BALLS, CELLS // len(pairs.at)))
        i, j = np.divmod(pairs.at, p)
        used, place = np.unique(np.concatenate([i, j]), return_inverse=True)
        m = kernel(v[used], centre[used, at : at + step], smooth[used], width)
        x, y = m[place[: len(i)]], m[place[len(i) :]]
        np.maximum(pairs.high, np.minimum(x, y).max(1), out=pairs.high)
        np.minimum(pairs.low, np.maximum(np.subtract(1, x, out=x), y, out=x).min(1), out=pairs.low)
        pairs.prune(most)
        at += step
    return pairs


def _ratios(rows: DataFrame, placed: DataFrame, count: int, smooth: np.ndarray, width: float, known: np.ndarray) -> np.ndarray:
    """features x features: the largest ratio of rows (pos, v) over balls in ``count`` blocks (centre, block), where it exceeds ``known``."""
    p = len(smooth)
    context = rows.sparkSession.sparkContext
    most_sent = context.broadcast(known.ravel())

    def part(block: int):
        got = placed.where(F.col("block") == block).orderBy("ball").select("centre").collect()  # CENTRE_BYTES, about
        centre = np.array([r.centre for r in got], float).reshape(-1, p)
        return context.broadcast(np.ascontiguousarray(np.random.default_rng(0).permutation(centre).T))

    def left(batch, sent, most):
        carried = "at" in batch.schema.names
        for k, v in enumerate(arrays.stacked(batch.column("v"))):
            pairs = _Pairs(*(np.frombuffer(batch.column(c)[k].as_py(), kind).copy() for c, kind in (("at", np.int64), ("low", float), ("high", float)))) if carried else None
            yield k, _covering(v, sent.value, smooth, width, most, pairs)

    def carried(sent):
        def run(batches):
            most = most_sent.value
            for batch in batches:
                found = [(k, pairs) for k, pairs in left(batch, sent, most) if len(pairs.at)]
                some = batch.select(["pos", "v"]).take(pa.array([k for k, _ in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([*some.columns, *(pa.array([getattr(x, c).tobytes() for _, x in found], pa.binary()) for c in ("at", "low", "high"))], ["pos", "v", "at", "low", "high"])

        return run

    def ratios(sent):
        def run(batches):
            most = most_sent.value.copy()
            for batch in batches:
                for _, pairs in left(batch, sent, most):
                    ratio = pairs.ratio()
                    most[pairs.at] = np.maximum(most[pairs.at], np.where(np.isfinite(ratio), ratio, 0.0))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(p, dtype=np.int32)), pa.array(list(most.reshape(p, p)), pa.list_(pa.float64()))], ["i", "row"])

        return run

    state = rows.select("pos", "v")
    for block in range(count - 1):
        sent = part(block)
        state = tables.written(state.mapInArrow(carried(sent), "pos long, v array<double>, at binary, low binary, high binary"))
        sent.unpersist()
    parts = state.mapInArrow(ratios(part(count - 1)), "i int, row array<double>")
    found = parts.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.max("x").alias("x")).toArrow()  # features x features
    out = known.copy()
    out[found.column("i").to_numpy(), found.column("j").to_numpy()] = found.column("x").to_numpy()
    return out


def feature_graph(rows: DataFrame, centre: DataFrame, smooth: np.ndarray, width: float) -> np.ndarray:
    """features x features: for each pair the largest ratio over rows (pos, v) of the two covering measures over all balls (ball, centre).

    Rows at the ends of features have most of the largest ratios: they go first, and other rows need look at pairs only until
    some balls show that they have no larger one."""
    p = len(smooth)
    count = max(1, -(-centre.count() * 8 * p // CENTRE_BYTES))
    placed = kept(centre.select("ball", "centre", F.pmod(F.xxhash64("ball"), F.lit(count)).alias("block")))
    ends = rows.agg(*(f("pos", F.col("v")[k]) for k in range(min(p, END_FEATURES)) for f in (F.min_by, F.max_by))).first()
    first = rows.where(F.col("pos").isin(sorted({x for x in ends if x is not None}))).repartition(rows.sparkSession.sparkContext.defaultParallelism)
    known = _ratios(first, placed, count, smooth, width, np.zeros((p, p)))
    return _ratios(rows, placed, count, smooth, width, known)


def to_l1(x: np.ndarray, size: float) -> np.ndarray:
    """The nearest point whose absolute values sum to ``size`` at most."""
    if np.abs(x).sum() <= size:
        return x
    falling = np.sort(np.abs(x))[::-1]
    excess = (np.cumsum(falling) - size) / np.arange(1, len(x) + 1)
    cut = excess[np.flatnonzero(falling > excess)[-1]]
    return np.sign(x) * np.maximum(np.abs(x) - cut, 0)


def walk(graph: np.ndarray, size: float = 0.8, momentum: float = 0.2, decay: float = 0.1, rounds: int = 10_000, tolerance: float = 1e-4) -> np.ndarray:
    """Scores in [0, 1] (all 0 if the walk tells nothing apart)."""
    strength = graph.sum(1)
    moves = graph / (strength + 1e-8)[:, None]
    restart = 1 / (1 + np.log(strength.mean() + 1 + EPS))
    now = before = start = np.full(len(graph), 1 / len(graph))
    visits = np.zeros(len(graph))
    for _ in range(rounds):
        pushed = ((1 - momentum) * now + momentum * before) / (1 + decay * visits)
        after = restart * start + (1 - restart) * (pushed @ moves)
        if after.sum() > EPS:
            visits = visits + after / after.sum()
        after = to_l1(after, size)
        still = np.abs(after - now).sum() < tolerance
        now, before = after, now
        if still:
            break
    reach = now.max() - now.min()
    return np.zeros(len(now)) if reach < EPS else (now - now.min()) / reach


def granular_walk(df: DataFrame, key: str, features: Sequence[str], k: int, width: float = 0.1, rescale: bool = True, **options) -> Ranking:
    """Columns by the walk's scores.  ``rescale``: to [0, 1] first; constant columns then score -1.  Without it a column has the
    Gaussian kernel only if it spans exactly 0 to 1, else equality.  ``options``: of ``walk``."""
    source = matrix(df, key, features)
    live, data = tuple(source.features), source.data
    if rescale:
        fitted, _ = scaling.min_max(data, live)
        live, data = fitted.features, fitted.apply(data)
    if not 1 <= len(live) <= MOST_FEATURES:
        raise ParameterError(f"1 to {MOST_FEATURES} columns that vary are needed")
    rows = kept(data.select("pos", F.array(*(F.col(c).cast("double") for c in live)).alias("v")))
    ranges = data.agg(*(f(c).alias(f"{n}{i}") for i, c in enumerate(live) for n, f in (("a", F.min), ("b", F.max)))).first()
    smooth = np.array([ranges[f"a{i}"] == 0 and ranges[f"b{i}"] == 1 for i in range(len(live))])
    graph = feature_graph(rows, centres(balls(rows)), smooth, width)
    score = dict(zip(live, walk(graph, **options).tolist(), strict=True))
    return top_k(source.features, [score.get(c, -1.0) for c in source.features], k, source="native_or_local")
