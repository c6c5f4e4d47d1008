"""Residuals of profiles in Gram space: one distributed product of columns, then small solves on the driver."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 1e-12


def gram(geometry: DataFrame, features: Sequence[str]) -> np.ndarray:
    """G'G. Each task multiplies its rows; the partial products, a row of p numbers for each feature, are summed."""
    width = len(features)

    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            g = np.stack([batch.column(c).to_numpy() for c in features])
            total += g @ g.T
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(list(total))], ["a", "row"])

    parts = geometry.select(*features).mapInArrow(run, "a int, row array<double>")
    summed = parts.select("a", F.posexplode("row").alias("b", "x")).groupBy("a", "b").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros((width, width))
    out[summed.column("a").to_numpy(), summed.column("b").to_numpy()] = summed.column("x").to_numpy()
    return out


def unit_gram(g: np.ndarray) -> np.ndarray:
    """Of the columns divided by (norm + eps)."""
    norms = np.sqrt(np.maximum(np.diag(g), 0)) + EPS
    return g / norms[:, None] / norms[None, :]


def nnls_gram(basis: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Minimiser of a'Ba - 2a't over a >= 0, by active sets."""
    k = len(target)
    a, free = np.zeros(k), np.zeros(k, bool)
    for _ in range(10 * k + 10):
        slope = target - basis @ a
        slope[free] = 0
        best = int(slope.argmax())
        if slope[best] <= 1e-12:
            break
        free[best] = True
        while True:
            at = np.flatnonzero(free)
            s = np.zeros(k)
            s[at] = np.linalg.lstsq(basis[np.ix_(at, at)], target[at], rcond=None)[0]
            if s[at].min() > 0:
                a = s
                break
            low = at[s[at] <= 0]
            step = min((a[low] / np.maximum(a[low] - s[low], 1e-300)).min(), 1.0)
            a = a + step * (s - a)
            free[at[a[at] <= 1e-14]] = False
            a[~free] = 0
            if not free.any():
                break
    return a


def descent_gram(basis: np.ndarray, targets: np.ndarray, sweeps: int = 1000, tol: float = 1e-12) -> np.ndarray:
    """The same for all columns of ``targets`` at once, by cyclic coordinate descent."""
    a, diagonal = np.zeros_like(targets), np.maximum(np.diag(basis), EPS)
    for _ in range(sweeps):
        moved = 0.0
        for i in range(len(basis)):
            new = np.maximum(a[i] + (targets[i] - basis[i] @ a) / diagonal[i], 0)
            moved = max(moved, float(np.abs(new - a[i]).max(initial=0)))
            a[i] = new
        if moved <= tol:
            break
    return a


def engine_label(engine: str, width: int, pairs: int) -> str:
    if engine != "auto":
        return engine
    return "batched_cd" if width >= 50 or pairs >= 15_000 else "nnls"


def _block(h, a: Sequence[int], b: Sequence[int]) -> np.ndarray:
    return h[np.ix_(a, b)] if isinstance(h, np.ndarray) else h.block(a, b)


def residuals(h, chosen: Sequence[int], rest: Sequence[int], engine: str = "nnls") -> np.ndarray:
    """Share of each remaining unit profile that no non-negative mix of the chosen explains, in [0, 1]; 1 if none is
    chosen.  h: Gram matrix of unit profiles, or a ``tiles.Gram`` that has its columns when they are needed."""
    chosen, rest = list(chosen), list(rest)
    if not chosen:
        return np.ones(len(rest))
    basis, cross, own = _block(h, chosen, chosen), _block(h, chosen, rest), (np.diag(h) if isinstance(h, np.ndarray) else h.diagonal)[rest]
    a = descent_gram(basis, cross) if engine == "batched_cd" else np.stack([nnls_gram(basis, c) for c in cross.T], 1) if rest else np.zeros((len(chosen), 0))
    left = own - 2 * (a * cross).sum(0) + np.einsum("ik,ij,jk->k", a, basis, a)
    return np.clip(np.maximum(left, 0) / (own + EPS), 0, 1)


def substitution(h, chosen: Sequence[int], r: int, j: int) -> float:
    """How well j can stand in for r among the chosen: 1 less the worse of what each leaves unexplained."""
    if r not in chosen:
        raise ValueError("the representative must be selected")
    if r == j:
        return 1.0
    swapped = [c for c in chosen if c != r] + [j]
    return float(np.clip(1 - max(residuals(h, chosen, [j])[0], residuals(h, swapped, [r])[0]), 0, 1))
