"""Leading eigenpairs of a symmetric operator that is only known by what it does to a table of vectors.

Block Lanczos with full reorthogonalisation and thick restarts.  The basis stays a table (a row for each node); a step
applies the operator once to one block of vectors, and the driver sees products of the basis with that block, matrices
as wide as the basis.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.tables import discard, kept, written

#: Vectors that the basis has at most, beside what is asked for; steps; residual at which a pair counts as found.
MOST_WIDTH, STEPS, TOLERANCE = 128, 60, 1e-7

Operator = Callable[[DataFrame], DataFrame]


def products(df: DataFrame, left: str, right: str, w: int, s: int, turn: np.ndarray | None = None) -> np.ndarray:
    """left' right of two array columns of w and s numbers; ``turn``: left' (right - left turn) above (right - left turn)' itself."""
    shape = (w, s) if turn is None else (w + s, s)

    def run(batches):
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                a, b = arrays.stacked(batch.column(left)), arrays.stacked(batch.column(right))
                if turn is not None:
                    b = b - a @ turn
                    a = np.column_stack([a, b])
                total += a.T @ b
        yield pa.RecordBatch.from_arrays([arrays.listed(total.reshape(1, -1))], ["g"])

    names = [left] if left == right else [left, right]
    long = df.select(*names).mapInArrow(run, "g array<double>").select(F.posexplode("g").alias("k", "g")).groupBy("k").agg(F.sum("g").alias("g")).toArrow()
    out = np.zeros(shape[0] * shape[1])
    out[long.column("k").to_numpy()] = long.column("g").to_numpy()
    return out.reshape(shape)


def _mapped(df: DataFrame, of: Callable[..., np.ndarray | tuple], names: tuple[str, ...], out: tuple[str, ...]) -> DataFrame:
    """a, and array columns computed from array columns row by row."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                found = of(*(arrays.stacked(batch.column(c)) for c in names))
                yield pa.RecordBatch.from_arrays([batch.column("a"), *map(arrays.listed, found if isinstance(found, tuple) else (found,))], ["a", *out])

    return df.select("a", *names).mapInArrow(run, "a long, " + ", ".join(f"{c} array<double>" for c in out))


def leading(apply: Operator, nodes: DataFrame, count: int, steps: int = STEPS, tolerance: float = TOLERANCE, seed: int = 0) -> tuple[np.ndarray, DataFrame]:
    """The ``count`` largest eigenvalues, falling, and their vectors (a, y: an array) of an operator on nodes (a: long).  ``apply``: from
    (a, y) to (a, z), for every node.  Eigenvalues that repeat more than ``count + 2`` times are found as often as that.  Nodes may
    bring ``start``, an array of vectors near the wanted ones, of about one size: the first block has them beside the random ones."""
    block = count + 2
    noise: Callable[[int], Column] = lambda k: F.sin(F.xxhash64(F.lit(seed), F.lit(k), "a") / F.lit(1e15))
    random = F.array(*(noise(k) for k in range(block)))
    y = kept(nodes.select("a", (F.concat("start", random) if "start" in nodes.columns else random).alias("y")))
    if "start" in nodes.columns:
        block = y.agg(F.max(F.size("y"))).first()[0] or block
    for _ in range(2):  # again for vectors that were close to dependent
        sizes, turn = np.linalg.eigh(products(y, "y", "y", block, block))
        live = sizes > 1e-10 * max(sizes.max(initial=0), 1e-300)
        first = turn[:, live] / np.sqrt(sizes[live])
        y = _mapped(y, lambda v, first=first: v @ first, ("y",), ("y",))
        block = first.shape[1]
    state, table, h = None, None, np.zeros((0, 0))
    values, turn = np.zeros(0), np.zeros((0, 0))
    added = block
    for _ in range(steps):
        met = y.join(apply(y), "a")
        if state is None:
            state = met.select("a", F.col("y").alias("q"), "z")
        else:
            state = state.select("a", "q").join(met, "a").select("a", F.concat("q", "y").alias("q"), "z")
        # A table rather than a checkpoint: that would carry the partitionings of all joins before it, twice as many each step.
        before, state = table, written(state)
        table = state
        if before is not None:
            discard(before)
        width = len(h) + added
        c = products(state, "q", "z", width, added)
        grown = np.zeros((width, width))
        grown[: len(h), : len(h)] = h
        grown[:, width - added :] = c
        grown[width - added :] = c.T
        grown[width - added :, width - added :] = (c[width - added :] + c[width - added :].T) / 2
        h = grown
        values, turn = np.linalg.eigh(h)
        values, turn = values[::-1], turn[:, ::-1]
        again = products(state, "q", "z", width, added, c)  # what the first pass left along the basis, and the squares of the rest
        c2, left = again[:width], again[width:]
        left = left - c2.T @ c2
        sizes, axes = np.linalg.eigh((left + left.T) / 2)
        live = sizes > 1e-22 * max(1.0, np.abs(values).max())
        beyond = np.sqrt(np.maximum(sizes, 0))[:, None] * axes.T
        residual = np.linalg.norm(beyond @ turn[width - added :, :count], axis=0)
        if not live.any() or width >= count and residual.max(initial=0) <= tolerance:
            break
        next_basis = axes[:, live] / np.sqrt(sizes[live])
        y = _mapped(state, lambda q, z, c=c + c2, b=next_basis: (z - q @ c) @ b, ("q", "z"), ("y",))
        added = next_basis.shape[1]
        if width + added > MOST_WIDTH + 2 * block:
            # The vectors behind y must stay as they are: they are written before the basis is turned.
            y = kept(y)
            best = turn[:, : count + block]
            state = _mapped(state, lambda q, best=best: q @ best, ("q",), ("q",))
            values, turn = values[: best.shape[1]], np.eye(best.shape[1])  # of the turned basis
            h = np.diag(values)
    shown = min(count, len(values))
    best = turn[:, :shown]
    return values[:shown], _mapped(state, lambda q: q @ best, ("q",), ("y",))
