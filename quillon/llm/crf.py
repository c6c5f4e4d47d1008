"""Quality classifier: a linear-chain conditional random field over the lines of a text.

1. Each line with a word is an item of its document's chain, with features of its own (lengths, shares of
   kinds of characters, words and word windows that repeat) and those of the lines before and after it.
2. The field has two states, bad and good: a weight for each feature of a line that is good, and one for
   each pair of states of neighbouring lines.  Training lines carry their document's label.  The weights
   maximise the penalised likelihood, every document counting alike: L-BFGS on the driver, each
   gradient a sum over Spark tasks that hold the features of a bounded sample of labelled documents.
3. Forward-backward gives each line's probability to be good.  Both passes are products of 2 x 2 matrices, taken
   by doubling for all chains of a slice at once, however long.
4. The mean of these over the lines, weighted by their characters, is the document's quality; a logistic curve in its
   log-odds, fitted on the same sample, makes it the probability of label 1.

Null texts, empty ones and those without a word have no line: they score the share of label 1 among such
labelled documents, drawn to the share among all.  Without labelled documents every score is 0.5, with those of one
label only every score is near it.  Labels other than 0 and 1 are no labels; a document with several counts as bad if one
says so.  Repeated rows score alike; extra columns, languages, sources and ids never reach a score.  Whole texts are read.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import kept
from .text import SPACE, U64, Words, doc_texts, mix, slices

#: Labelled documents that are learned from, about; tasks that hold them; steps of L-BFGS; weight of the penalty.
SAMPLE_ROWS, TASKS, STEPS, PENALTY = 20_000, 8, 20, 1e-3

#: Kinds of bytes: 0 small letter, 1 capital, 2 digit, 3 end of a sentence, 4 comma and its like, 5 bar, 6 other symbol of markup, 7 other
#: ASCII, 8 letter beyond ASCII, 9 rest of a character, 10 exclamation.
_KINDS = 11
_KIND = np.full(256, 7, np.uint8)
_KIND[ord("a") : ord("z") + 1], _KIND[ord("A") : ord("Z") + 1], _KIND[ord("0") : ord("9") + 1], _KIND[0xC0:], _KIND[0x80:0xC0] = 0, 1, 2, 8, 9
for _k, _chars in ((3, b".?"), (4, b",;:"), (5, b"|"), (6, b"#*$%&<>=_~^{}[]\\/@+"), (10, b"!")):
    _KIND[list(_chars)] = _k


def _steps(x: np.ndarray, *at: float) -> list[np.ndarray]:
    """A share as such, and whether it is above each of some values."""
    return [x, *((x > a).astype(float) for a in at)]


def line_features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line with a word, in order: features (float32), its document's number, its characters in words."""
    words = Words(texts, lower=False)
    if not len(words):
        return np.zeros((0, WIDTH), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    breaks = np.flatnonzero(words.data == 10)
    line = np.searchsorted(breaks, words.start)
    first = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (words.doc[1:] != words.doc[:-1])]))  # the first word of each item
    n_words = np.diff(np.append(first, len(words)))
    item = np.repeat(np.arange(len(first)), n_words)
    doc = words.doc[first]
    kinds = _KIND[words.data[~SPACE[words.data]]]  # bytes outside words are white space
    counts = np.bincount(np.repeat(item * _KINDS, words.stop - words.start) + kinds, minlength=len(first) * _KINDS).reshape(-1, _KINDS).astype(float)
    chars = counts.sum(1) - counts[:, 9]
    share = counts / np.maximum(chars, 1)[:, None]
    letters = np.maximum(counts[:, 0] + counts[:, 1] + counts[:, 8], 1)
    tail = _KIND[words.data[words.stop - 1]]
    hashes = words.hashes()

    def mean(x):
        return np.add.reduceat(x.astype(float), first) / n_words

    order = np.lexsort((hashes, item))
    fresh = np.concatenate([[True], (hashes[order][1:] != hashes[order][:-1]) | (item[order][1:] != item[order][:-1])])
    distinct = np.add.reduceat(fresh.astype(float), first) / n_words  # the order keeps each item's words together
    with np.errstate(over="ignore"):
        place = np.arange(len(words)) - np.repeat(first, n_words)
        key = np.add.reduceat(mix(hashes + mix(place.astype(U64) + U64(1))), first)
    order = np.lexsort((np.arange(len(first)), key, doc))
    again = np.zeros(len(first))
    again[order[1:]] = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    covered = np.zeros(len(words) + 3)
    begin, window = words.windows(hashes, 3)
    if len(begin):
        order = np.lexsort((window, words.doc[begin]))
        same = (window[order][1:] == window[order][:-1]) & (words.doc[begin][order][1:] == words.doc[begin][order][:-1])
        for k in range(3):
            covered[begin[order[np.append(same, False) | np.insert(same, 0, False)]] + k] = 1
    long_word = np.maximum.reduceat(words.stop - words.start, first)
    head = _KIND[words.data[words.start[first]]]
    end = tail[np.append(first[1:], len(words)) - 1]
    columns = [
        np.ones(len(first)), np.log1p(chars) / 8, np.log1p(n_words) / 6, np.minimum(chars / n_words / 10, 3), np.log1p(long_word) / 6,
        *_steps(counts[:, 1] / letters, 0.1, 0.3, 0.7), *_steps(share[:, 2], 0.05, 0.2), *_steps(share[:, 3], 0.001, 0.05), *_steps(share[:, 4], 0.02),
        *_steps(share[:, 5], 0.02), *_steps(share[:, 6], 0.02, 0.1), *_steps(share[:, 7], 0.05), share[:, 8], *_steps(share[:, 10], 0.02, 0.1),
        n_words < 2, n_words < 5, n_words < 12, n_words > 60, (head == 1) | (head == 8), head == 2, (end == 3) | (end == 10), end == 4,
        *_steps(mean(np.isin(tail, (3, 4, 10))), 0.5), *_steps(mean(tail == 6), 0.3), *_steps(distinct, 0.5, 0.8), again, *_steps(mean(covered[: len(words)]), 0.1, 0.5),
    ]
    return np.column_stack(columns).astype(np.float32), doc, chars.astype(np.int64)


#: Features of a line itself; of a line with its neighbours, and whether it has any.
WIDTH = 47
WEIGHTS = 3 * WIDTH + 2


def with_neighbours(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Features of a line, of the one before and of the one after it in its document (zeros where there is none), and two marks of that."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first], after[last] = 0, 0
    return np.column_stack([x, before, after, first.astype(x.dtype), last.astype(x.dtype)])


def ends(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Is a line the first, the last of its document?"""
    other = doc[1:] != doc[:-1]
    return np.concatenate([[True], other]), np.concatenate([other, [True]])


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of 2 x 2 matrices of logarithms."""
    return np.logaddexp(a[:, :, 0, None] + b[:, None, 0, :], a[:, :, 1, None] + b[:, None, 1, :])


def forward_backward(good: np.ndarray, step: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """good: each line's weight to be good (bad: 0); step: 2 x 2 weights of neighbouring states, bad first.
    Log-probabilities of each line's states (n x 2), of its state and that of the line before (n x 2 x 2, meaningless for first
    lines), and the log-sum of all labellings at each document's lines."""
    n = len(good)
    emit = np.column_stack([np.zeros(n), good])
    one = np.where(first[:, None, None], 0.0, step[None]) + emit[:, None, :]
    number = np.cumsum(first) - 1
    start, stop = np.flatnonzero(first)[number], np.flatnonzero(last)[number]
    before, after = np.arange(n) - start, stop - np.arange(n)
    ahead, behind = one.copy(), one.copy()  # products from a document's first line, and to its last
    d = 1
    while (rows := np.flatnonzero(before >= d)).size:
        ahead[rows] = _times(ahead[rows - d], ahead[rows])
        rows = np.flatnonzero(after >= d)
        behind[rows] = _times(behind[rows], behind[rows + d])
        d *= 2
    alpha = ahead[:, 0]
    beta = np.zeros((n, 2))
    rows = np.flatnonzero(~last)
    beta[rows] = np.logaddexp(behind[rows + 1, :, 0], behind[rows + 1, :, 1])
    total = np.logaddexp(alpha[:, 0], alpha[:, 1])[stop]
    pair = np.roll(alpha, 1, axis=0)[:, :, None] + step[None] + (emit + beta)[:, None, :] - total[:, None, None]
    return alpha + beta - total[:, None], pair, total


def loss_and_gradient(weights: np.ndarray, x: np.ndarray, doc: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Negative log-likelihood of labelled chains, each divided by its lines, and its gradient.  label: of each line."""
    first, last = ends(doc)
    full = with_neighbours(x, first, last).astype(float)
    w, step = weights[:WEIGHTS], weights[WEIGHTS:].reshape(2, 2)
    good = full @ w
    single, pair, total = forward_backward(good, step, first, last)
    number = np.cumsum(first) - 1
    share = 1.0 / np.bincount(number)[number]
    inner = ~first
    own = label * good + np.where(inner, step[label, label], 0.0)
    loss = (share * own).sum() - (share * total)[last].sum()
    by_weight = full.T @ (share * (label - np.exp(single[:, 1])))
    by_step = np.array([[(share * inner * ((label == i) * (i == j))).sum() for j in (0, 1)] for i in (0, 1)])
    by_step -= (share[inner, None, None] * np.exp(pair[inner])).sum(0)
    return -np.concatenate([[loss], by_weight, by_step.ravel()])


def lbfgs(value, start: np.ndarray, steps: int, memory: int = 8, tolerance: float = 1e-4) -> np.ndarray:
    """Minimises ``value(x)``, which gives the value and its gradient in one array."""
    x, got = start, value(start)
    f, g, pairs = got[0], got[1:], []
    for _ in range(steps):
        direction, scales = g.copy(), []
        for s, y in reversed(pairs):
            scales.append((s @ direction) / (s @ y))
            direction -= scales[-1] * y
        direction *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else min(1.0, 1 / max(np.abs(g).sum(), 1e-12))
        for (s, y), scale in zip(pairs, reversed(scales), strict=True):
            direction += s * (scale - (y @ direction) / (s @ y))
        rate = 1.0
        while True:
            new = x - rate * direction
            got = value(new)
            if got[0] <= f - 1e-4 * rate * (g @ direction) or rate < 1e-6:
                break
            rate /= 2
        s, y = new - x, got[1:] - g
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        gain, x, f, g = f - got[0], new, got[0], got[1:]
        if gain < tolerance * max(1e-3, abs(f)):
            break
    return x


def good_lines(weights: np.ndarray, x: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Each line's probability to be good."""
    if not len(x):
        return np.zeros(0)
    first, last = ends(doc)
    single, _, _ = forward_backward(with_neighbours(x, first, last).astype(float) @ weights[:WEIGHTS], weights[WEIGHTS:].reshape(2, 2), first, last)
    return np.exp(single[:, 1])


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(WEIGHTS + 4))
    slope: float = 1.0
    offset: float = 0.0
    empty: float = 0.5  # of a text without lines


def weighted(p: np.ndarray, doc: np.ndarray, chars: np.ndarray, documents: int) -> np.ndarray:
    """Mean of the lines of each document by their length; NaN without lines."""
    size = np.bincount(doc, chars, minlength=documents)
    with np.errstate(invalid="ignore"):
        return np.where(size > 0, np.bincount(doc, chars * p, minlength=documents) / size, np.nan)


def _odds(quality: np.ndarray) -> np.ndarray:
    q = np.clip(quality, 1e-5, 1 - 1e-5)
    return np.log(q / (1 - q))


def scores(model: Model, texts: list[bytes | None]) -> np.ndarray:
    x, doc, chars = line_features(texts)
    quality = weighted(good_lines(model.weights, x, doc), doc, chars, len(texts))
    with np.errstate(invalid="ignore"):
        return np.where(np.isnan(quality), model.empty, 1 / (1 + np.exp(-(model.slope * _odds(quality) + model.offset))))


def _lines_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, document and characters of the lines of a batch of the sample."""
    raw = batch.column("x").to_pylist()
    x = np.frombuffer(b"".join(raw), np.float32).reshape(-1, WIDTH)
    chars = np.frombuffer(b"".join(batch.column("chars").to_pylist()), np.int64)
    return x, np.repeat(np.arange(len(raw)), [len(b) // (4 * WIDTH) for b in raw]), chars


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, steps: int = STEPS) -> Model:
    """From about ``sample_rows`` of the labelled rows, taken by a hash of doc_id, or all if there are fewer.  ``docs``: doc_id, text;
    ``labels``: doc_id, quality.  The sample's labels are broadcast, its features lie in TASKS partitions by doc_id, so the
    result does not depend on how the rows came."""
    model = Model()
    marks = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("good"))
    share = min(1.0, sample_rows / max(1, marks.count()))
    sample = marks.where((F.xxhash64("doc_id") / 2.0**64 + 0.5) < share)
    rows = doc_texts(docs).join(F.broadcast(sample), "doc_id")

    def features(batches):
        for batch in batches:
            for part, texts in slices(batch, "text"):
                x, doc, chars = line_features(texts)
                cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
                both = [pa.array([v[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()) for v in (x, chars)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("good"), *both], ["doc_id", "good", "x", "chars"])

    held = rows.select("doc_id", "good", "text").mapInArrow(features, "doc_id long, good int, x binary, chars binary")
    held = kept(held.repartition(TASKS, "doc_id").sortWithinPartitions("doc_id", "x"))
    size = {(r.good, r.lines): r.n for r in held.groupBy("good", (F.length("x") > 0).alias("lines")).agg(F.count("*").alias("n")).collect()}
    n = sum(size.values())
    if not n:
        return model
    bare, lined = ([size.get((good, lines), 0) for good in (0, 1)] for lines in (False, True))
    rate = (bare[1] + lined[1] + 1) / (n + 2)
    model.empty = (bare[1] + 2 * rate) / (sum(bare) + 2)
    if 0 in lined:  # nothing to learn from
        model.offset = float(np.log(rate / (1 - rate)))
        return model
    held = held.where("length(x) > 0")

    def gradient(weights: np.ndarray) -> np.ndarray:
        def run(batches):
            total = np.zeros(WEIGHTS + 5)
            for batch in batches:
                x, doc, _ = _lines_of(batch)
                if len(x):
                    total += loss_and_gradient(weights, x, doc, batch.column("good").to_numpy()[doc])
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["g"])

        got = np.sum([r.g for r in held.mapInArrow(run, "g array<double>").collect()], axis=0) / sum(lined)  # TASKS rows
        got[0] += PENALTY / 2 * (weights @ weights)
        got[1:] += PENALTY * weights
        return got

    model.weights = lbfgs(gradient, np.zeros(WEIGHTS + 4), steps)

    def qualities(batches):
        for batch in batches:
            x, doc, chars = _lines_of(batch)
            odds = _odds(weighted(good_lines(model.weights, x, doc), doc, chars, batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array(odds)], ["good", "odds"])

    pairs = held.mapInArrow(qualities, "good int, odds double").toPandas()  # two numbers for each row of the sample
    model.slope, model.offset = _curve(pairs.odds.to_numpy(), pairs.good.to_numpy())
    return model


def _curve(odds: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton's steps with a small penalty; the slope is never negative."""
    x, w = np.column_stack([odds, np.ones(len(odds))]), np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(2) * 1e-2, x.T @ (p - good) + 1e-2 * (w - [1.0, 0.0]))
        w = w - step * min(1.0, 2 / max(np.abs(step).max(), 1e-12))
    return max(float(w[0]), 0.0), float(w[1])


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted, for each row of ``docs``."""

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for part, texts in slices(batch, "text"):
                s = scores(model, texts)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(s, pa.float64()), pa.array(s >= threshold).cast(pa.int32())], ["doc_id", "score", "predicted"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def label_lines(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, line (number of a line with a word among all lines of the text), p_good, good: the field's verdict on single lines."""

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, "text"):
                x, doc, _ = line_features(texts)
                p = good_lines(model.weights, x, doc)
                numbers = [k for t in texts for k, x in enumerate((t or b"").split(b"\n")) if x.strip(b" \t\r\x0b\x0c")]
                ids = part.column("doc_id").cast(pa.int64()).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([ids, pa.array(numbers, pa.int64()), pa.array(p, pa.float64()), pa.array(p >= 0.5)], ["doc_id", "line", "p_good", "good"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, line long, p_good double, good boolean")
