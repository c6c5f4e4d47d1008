"""LM scoring: a gated recurrent language model in numpy.

1. Counts of all training tokens are summed over the corpus (a table that grows with it).
2. The output is class-factored: frequent words stand in classes of equal size, each with a
   softmax of its own; every other word belongs to a class by its last two bytes, in
   which its corpus count gives its share.  So a probability is a product: of the class, given
   the state, and of the word, given the class.
3. Training documents are dealt, by a hash of the row, to units of about UNIT tokens; a unit is
   one round of one copy of the model.  Copies and rounds both grow with the square root of the
   units, so copies are averaged after each UNIT tokens whatever the corpus.  A copy reads its unit's
   documents from begin to end, long ones first (so that no lane runs on alone) and BATCH at a time; the state is carried from window to
   window, where gradients are cut.  Copies are averaged (weighted by tokens, in the order of their
   numbers, in a tree of tasks) between rounds.  So scores do not depend on how rows lie in
   partitions, but for the rounding of float32 products.  Equal rows (id and text) go to one unit,
   which streams them.
4. Scoring reads documents from begin to end, one after another in lanes of like length; the state is
   carried from window to window.  The counts of the most frequent words (KNOWN at most) are
   broadcast; those of all others are joined by word.

Words are lower-cased in A-Z; each text ends with a token of its own, so null and empty texts
have that one.  A token with count c among training tokens has the base log10 of
(c + 0.1) / (N + 0.1 * (V + 1)).  Repeated rows are scored (and counted) each.  A row without
doc_id is taken as having the id "".  Without training rows the model is uniform over its classes.
Very long texts are scored whole; a batch holds ids, not texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, fields
from functools import cached_property
from heapq import heapreplace
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import written
from .text import doc_texts

KNOWN, HEAD, CLASS, TAILS, HIDDEN = 1 << 18, 2048, 64, 32, 16
WINDOW, BATCH, RATE = 32, 128, 0.02
#: Tokens that a copy of the model reads between two averages, and the most partitions that hold the units.
UNIT, PARTS = 4_000_000, 20_000
#: Documents of more tokens are read first, the longest before the others; all others in the order of their hashes.
LONG = 1024
#: Weights and biases of the outputs stay within these, so a logit is at most HIDDEN * 2.5 + 40 = 80: float32 holds
#: its exponential and the sums over a softmax.
MOST_WEIGHT, MOST_BIAS = 2.5, 40.0
#: Copies of the model that a task of the tree adds up.
FAN_IN = 32
END = b"\n"  # no word holds it
START = HEAD + TAILS
SYMBOL = "<i2"  # a text's symbols are one binary value, which Spark moves without looking at each
SCORE_BATCH, SCORE_WINDOW = 256, 32
#: Bytes that a task keeps, below glibc's largest limit (``keep_memory``).
KEPT = 24 << 20
#: Bytes of rows whose words a task counts at a time, and of those that it looks up at a time.
COUNT_BYTES, LOOK_UP_BYTES = 64 << 20, 16 << 20
#: States of which the outputs are computed at a time, and windows of scoring that are laid out at a time.
BLOCK, HELD = 512, 32


def tail(word: bytes) -> int:
    """Class of a word that is not among the frequent ones."""
    return (word[-1] + 7 * word[-2]) % TAILS if len(word) > 1 else word[-1] % TAILS


def keep_memory() -> None:
    """When an array made alone is freed, glibc's malloc sets its limits to the array's size: from then on smaller ones are taken from memory
    that the process has, and each window's arrays cost no page faults.  A task holds up to twice as much unused."""
    np.empty(KEPT, np.uint8)  # freed at once


def as_binary(words: list[bytes] | pa.Array | pa.ChunkedArray) -> pa.Array | pa.ChunkedArray:
    return pa.array(words, pa.binary()) if isinstance(words, list) else words.cast(pa.binary())


def tails(words: list[bytes] | pa.Array) -> np.ndarray:
    """``tail`` of each word."""
    words = as_binary(words)
    if not len(words):
        return np.zeros(0, np.int32)
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data, sizes = np.frombuffer(data, np.uint8), np.diff(ends)
    last, before = (data[np.maximum(ends[1:] - k, 0)].astype(np.int32) for k in (1, 2))
    return (last + np.where(sizes > 1, 7 * before, 0)) % TAILS


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts (null: none), lower-cased in A-Z, without their ends, and how many each text has.  No word is a Python object."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(texts))  # at U+0020 and U+0009..U+000D
    words, sizes = found.flatten(), pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    some = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    if not some.all():  # Arrow gives an empty word before or behind white space at an end of a text
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[some], minlength=len(sizes))
        words = words.filter(pa.array(some))
    return words, sizes


@dataclass
class Gru:
    """Parameters.  Symbols: frequent words, then tail classes, then START (input only)."""

    embed: np.ndarray  # symbol, HIDDEN
    inward: np.ndarray  # HIDDEN, 3 * HIDDEN: update, reset, candidate
    across: np.ndarray  # HIDDEN, 3 * HIDDEN
    bias: np.ndarray  # 3 * HIDDEN
    to_class: np.ndarray  # HIDDEN, classes
    class_bias: np.ndarray
    to_word: np.ndarray  # class of frequent words, HIDDEN, CLASS
    word_bias: np.ndarray  # class of frequent words, CLASS

    @staticmethod
    def fresh(mass: np.ndarray) -> Gru:
        """Small random weights; biases from the symbols' counts, so that it starts as a unigram model."""
        rng, n = np.random.default_rng(11), HEAD // CLASS
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        mass = mass + 0.5
        by_class = np.concatenate([mass[:HEAD].reshape(n, CLASS).sum(1), mass[HEAD:START]])
        log = lambda x: np.log(x).astype(np.float32)
        return Gru(
            small(START + 1, HIDDEN), small(HIDDEN, 3 * HIDDEN) * 3, small(HIDDEN, 3 * HIDDEN) * 3, np.zeros(3 * HIDDEN, np.float32), small(HIDDEN, n + TAILS),
            log(by_class / by_class.sum()), small(n, HIDDEN, CLASS), log(mass[:HEAD].reshape(n, CLASS) / by_class[:n, None]),
        )

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    def filled(self, flat: np.ndarray) -> Gru:
        out, at = [], 0
        for a in self.arrays():
            out.append(flat[at : at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return Gru(*out)


def sigmoid_in_place(x: np.ndarray) -> None:
    """Of -x (``exponents``); an exponential beyond the largest number gives 0."""
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


def tanh_in_place(x: np.ndarray) -> None:
    """Of -2x (``exponents``): NumPy's exp takes a third of the time of its tanh."""
    np.exp(x, out=x)
    x += 1
    np.divide(2, x, out=x)
    x -= 1


def by_symbol(targets: np.ndarray) -> np.ndarray:
    """Places of the targets (-1: none), in order of their symbols: a class is one run of them."""
    live = np.flatnonzero(targets >= 0)
    return live[np.argsort(targets[live].astype(np.int16), kind="stable")]


def run_starts(ordered: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))


def run_sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of runs of rows (an even number of columns); two columns are one complex number, which halves NumPy's inner loops."""
    return np.add.reduceat(x.view(np.result_type(x.dtype, np.complex64)), first, axis=0).view(x.dtype)


class Outputs:
    """The class-factored softmax over states and their symbols, both in order of the symbols.

    States have a last column of ones, and weights the biases as their last row.  Sums over a softmax come
    from the product that its gradient needs anyway, and the one-hot parts from gathered rows: so of the
    (token, word) arrays only the exponentials are made.  Logits are bounded (MOST_WEIGHT) and need no shift."""

    def __init__(self, m: Gru) -> None:
        self.m, self.n, kind = m, HEAD // CLASS, m.embed.dtype
        ones = lambda w: np.concatenate([np.swapaxes(w, -1, -2), np.ones((*w.shape[:-2], w.shape[-1], 1), kind)], -1)
        self.classes, self.words = np.concatenate([m.to_class, m.class_bias[None]]), np.concatenate([m.to_word, m.word_bias[:, None]], 1)
        self.class_back, self.word_back = ones(m.to_class), ones(m.to_word)
        self.class_rows, self.word_rows = np.ascontiguousarray(self.classes.T), np.swapaxes(self.words, 1, 2).reshape(HEAD, -1)

    def _softmax(self, hs: np.ndarray, weights: np.ndarray, back: np.ndarray, out: np.ndarray, to: np.ndarray | None) -> None:
        """``out``: the exponentials times ``back``; ``to`` gets the weights' gradients.  In blocks that stay in the cache."""
        held = np.empty((min(len(hs), BLOCK), weights.shape[1]), hs.dtype)
        for a in range(0, len(hs), BLOCK):
            part, found = hs[a : a + BLOCK], out[a : a + BLOCK]
            e = np.matmul(part, weights, out=held[: len(part)])
            np.exp(e, out=e)
            np.matmul(e, back, out=found)
            if to is not None:
                to += (part / found[:, -1:]).T @ e

    def __call__(self, hs: np.ndarray, ts: np.ndarray, g: Gru | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log-likelihood of each symbol; with ``g``, which gets the weights' gradients, also those of the states."""
        h, n = hs.shape[1] - 1, self.n
        classes = np.where(ts < HEAD, ts // CLASS, ts - HEAD + n)
        own, from_column = self.class_rows.take(classes, 0), 0 if g else h
        back, to_class = np.empty((len(hs), h + 1 - from_column), hs.dtype), np.zeros_like(self.classes) if g else None
        self._softmax(hs, self.classes, self.class_back[:, from_column:], back, to_class)
        total = back[:, -1:]
        logs = np.einsum("ij,ij->i", hs, own) - np.log(total[:, 0])
        top = int(np.searchsorted(ts, HEAD))
        cuts = np.searchsorted(ts[:top], np.arange(0, HEAD + 1, CLASS)).tolist()
        word_own = self.word_rows.take(ts[:top], 0)
        word_back = np.empty((top, h + 1 - from_column), hs.dtype)
        to_word = np.zeros_like(self.words) if g else None
        for k in range(n):
            a, b = cuts[k], cuts[k + 1]
            if a < b:
                self._softmax(hs[a:b], self.words[k], self.word_back[k][:, from_column:], word_back[a:b], to_word[k] if g else None)
        logs[:top] += np.einsum("ij,ij->i", hs[:top], word_own) - np.log(word_back[:, -1])
        if not g or not len(ts):
            return logs, None if not g else np.zeros((0, h), hs.dtype)
        first = run_starts(ts)
        sums, symbols = np.empty((len(first), h + 1), hs.dtype), ts[first]
        sums[:, :h], sums[:, h] = run_sums(np.ascontiguousarray(hs[:, :h]), first), np.diff(first, append=len(ts))
        of_class = classes[first]
        begins = run_starts(of_class)
        to_class[:, of_class[begins]] -= np.add.reduceat(sums, begins, axis=0).T
        head = symbols < HEAD
        to_word[symbols[head] // CLASS, :, symbols[head] % CLASS] -= sums[head]
        g.to_class[:], g.class_bias[:], g.to_word[:], g.word_bias[:] = to_class[:h], to_class[h], to_word[:, :h], to_word[:, h]
        states = back[:, :h] / total - own[:, :h]
        states[:top] += word_back[:, :h] / word_back[:, h:] - word_own[:, :h]
        return logs, states


def by_gate(weights: np.ndarray) -> np.ndarray:
    """(3, ..., HIDDEN): copies of the parts for update, reset and candidate, each in one piece."""
    return np.array(np.moveaxis(weights.reshape(*weights.shape[:-1], 3, -1), -2, 0), order="C")


def exponents(weights: np.ndarray) -> np.ndarray:
    """The same, times what the gates' exponentials take: -1 (update, reset) or -2 (candidate)."""
    out = by_gate(weights)
    out[:2] *= -1
    out[2] *= -2
    return out


def input_table(m: Gru) -> np.ndarray:
    """What a symbol adds to the gates' exponents: rows by gate and symbol."""
    return np.matmul(m.embed, exponents(m.inward)) + exponents(m.bias)[:, None]


def looked_up(table: np.ndarray, inputs: np.ndarray) -> np.ndarray:
    """Rows of a table by gate and symbol (below 0: some symbol's): step, gate, lane; so a step's lie together."""
    gates, symbols, h = table.shape
    return table.reshape(-1, h).take(inputs[:, None] + (np.arange(gates) * symbols)[:, None], 0, mode="clip")


@np.errstate(over="ignore")  # of exponentials under 1
def gradients(m: Gru, inputs: np.ndarray, targets: np.ndarray, state: np.ndarray | None = None) -> tuple[float, list[np.ndarray]]:
    """Summed negative log-likelihood of targets (steps, batch; -1: none) and its gradients, by
    backpropagation through these steps from ``state`` (batch, HIDDEN; None: zero), which becomes
    that after the last step.  An input START begins a document: the state before it is zero."""
    (steps, batch), h, kind = inputs.shape, HIDDEN, m.embed.dtype
    hid = np.zeros((steps + 1, batch, h), kind)
    if state is not None:
        hid[0] = state
    fresh = [np.flatnonzero(row) for row in inputs == START]
    x, across = looked_up(input_table(m), inputs), exponents(m.across)
    u, c, gap = np.empty((steps, 3, batch, h), kind), *(np.empty((steps, batch, h), kind) for _ in range(2))
    for t in range(steps):
        if len(fresh[t]):
            hid[t, fresh[t]] = 0  # the step before had no target there
        (_, r, to_r), now = np.matmul(hid[t], across, out=u[t]), c[t]
        gates = u[t, :2]
        gates += x[t, :2]
        sigmoid_in_place(gates)
        np.multiply(r, to_r, out=now)
        now += x[t, 2]
        tanh_in_place(now)
        np.subtract(hid[t], now, out=gap[t])
        np.multiply(gates[0], gap[t], out=hid[t + 1])
        hid[t + 1] += now
    if state is not None:
        state[:] = hid[-1]
    g = Gru(*(np.zeros_like(a) for a in m.arrays()))
    flat = targets.ravel()
    live = by_symbol(flat)
    hs = np.ones((len(live), h + 1), kind)
    hs[:, :h] = hid[1:].reshape(-1, h).take(live, 0)
    logs, found = Outputs(m)(hs, flat[live], g)
    out = np.zeros((steps * batch, h), kind)
    out[live] = found
    out = out.reshape(steps, batch, h)
    z, r, to_r = np.moveaxis(u, 1, 0)  # to_r: from -2 times the candidate's recurrent part
    to_z = 1 - z
    np.multiply(c, c, out=c)
    to_c = np.subtract(1, c, out=c)
    to_c *= to_z
    to_z *= z
    to_z *= gap
    to_r *= r
    to_r *= np.multiply(np.subtract(1, r, out=gap), -0.5, out=gap)
    d = np.empty((4, steps, batch, h), kind)  # of update, reset, the candidate's recurrent part, candidate
    carry, back, three = np.zeros((batch, h), kind), np.ascontiguousarray(np.swapaxes(by_gate(m.across), 1, 2)), np.empty((3, batch, h), kind)
    for t in range(steps - 1, -1, -1):
        o, (dz, dr, last, dc) = out[t], d[:, t]
        o += carry
        np.multiply(o, to_c[t], out=dc)
        np.multiply(o, to_z[t], out=dz)
        np.multiply(dc, to_r[t], out=dr)
        np.multiply(dc, r[t], out=last)
        np.matmul(d[:3, t], back, out=three)
        carry = three[0]
        carry += three[1]
        carry += three[2]
        o *= z[t]
        carry += o
        if len(fresh[t]):
            carry[fresh[t]] = 0
    before = hid[:-1].reshape(-1, h).T
    for k in range(3):
        g.across[:, k * h : (k + 1) * h] = before @ d[k].reshape(-1, h)
    # A symbol's sums come first, so the products take a row for each symbol, not for each token.
    seen = inputs.ravel()
    order = np.argsort(seen.astype(np.int16), kind="stable")
    first = run_starts(seen[order])
    symbols = seen[order[first]]
    sums = run_sums(np.concatenate([d[k].reshape(-1, h).take(order, 0) for k in (0, 1, 3)], 1), first)
    g.embed[symbols], g.inward[:], g.bias[:] = sums @ m.inward.T, m.embed[symbols].T @ sums, sums.sum(0)
    return -float(logs.sum()), g.arrays()


class Adam:
    def __init__(self, m: Gru, rate: float) -> None:
        """The parameters of ``m`` become parts of one vector, on which a step works at once."""
        self.m, self.rate, self.t, self.flat = m, rate, 0, m.flat()
        self.first, self.second, at = np.zeros_like(self.flat), np.zeros_like(self.flat), 0
        for f, a in zip(fields(m), m.arrays(), strict=True):
            setattr(m, f.name, self.flat[at : at + a.size].reshape(a.shape))
            at += a.size

    def step(self, grads: list[np.ndarray], scale: float, share: float = 1.0) -> None:
        """A step is as long as the window is full: a document whose lane runs on alone counts by its tokens."""
        self.t += 1
        size = share * self.rate * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        g, first, second = np.concatenate([x.ravel() for x in grads]), self.first, self.second
        g *= scale
        np.clip(g, -1, 1, out=g)
        first *= 0.9
        first += 0.1 * g
        g *= g
        second *= 0.99
        second += 0.01 * g
        np.sqrt(second, out=g)
        g += 1e-6
        np.divide(first, g, out=g)
        g *= size
        self.flat -= g
        for a, most in ((self.m.to_class, MOST_WEIGHT), (self.m.to_word, MOST_WEIGHT), (self.m.class_bias, MOST_BIAS), (self.m.word_bias, MOST_BIAS)):
            np.clip(a, -most, most, out=a)


class Scorer:
    """Natural-log probabilities of whole symbol sequences under a trained model."""

    def __init__(self, m: Gru) -> None:
        self.input, self.across, self.outputs = input_table(m), exponents(m.across), Outputs(m)  # input: rows by symbol

    @np.errstate(over="ignore")  # of exponentials under 1
    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Documents lie one after another in SCORE_BATCH lanes of like length, so no lane stands idle; a lane's longest is its first."""
        h, out, lengths = HIDDEN, np.zeros(len(docs)), np.array([len(d) for d in docs], np.int64)
        heap = [(0, k) for k in range(min(SCORE_BATCH, len(docs)))]
        own: list[list[int]] = [[] for _ in heap]
        for i in np.argsort(-lengths, kind="stable").tolist():
            total, k = heap[0]
            own[k].append(i)
            heapreplace(heap, (total + int(lengths[i]), k))
        own = [own[k] for total, k in sorted(heap, reverse=True) if total]  # lanes still running are the first rows
        if not own:
            return out
        doc = np.array([i for lane in own for i in lane if lengths[i]])
        targets = np.concatenate([docs[i] for i in doc.tolist()])
        inputs = np.append(np.int16(START), targets[:-1])
        inputs[np.cumsum(lengths[doc])[:-1]] = START
        streams, ends = [targets, inputs, np.repeat(doc, lengths[doc])], np.cumsum([lengths[lane].sum() for lane in own])
        sizes = np.diff(ends, prepend=0)
        state = np.zeros((len(own), h), np.float32)
        for begin in range(0, int(sizes[0]), SCORE_WINDOW):
            at = begin % (SCORE_WINDOW * HELD)
            if not at:
                held = [np.full((int((sizes > begin).sum()), SCORE_WINDOW * HELD), -1, x.dtype) for x in streams]
                for k, (a, b) in enumerate(zip((ends - sizes + begin).tolist(), ends[: len(held[0])].tolist(), strict=False)):
                    for rows, x in zip(held, streams, strict=True):
                        piece = x[a : min(b, a + rows.shape[1])]
                        rows[k, : len(piece)] = piece
            alive, steps = int((sizes > begin).sum()), int(min(SCORE_WINDOW, sizes[0] - begin))
            target, source, owner = (rows[:alive, at : at + steps].T for rows in held)
            state = state[:alive]
            hidden = np.ones((steps, alive, h + 1), np.float32)
            x, begins = looked_up(self.input, source), source == START  # a finished lane reads some symbol; its states are not used
            for t in range(steps):
                state[begins[t]] = 0
                u = np.matmul(state, self.across)
                gates, c = u[:2], u[2]
                gates += x[t, :2]
                sigmoid_in_place(gates)
                c *= gates[1]
                c += x[t, 2]
                tanh_in_place(c)
                state = state - c
                state *= gates[0]
                state += c
                hidden[t, :, :h] = state
            flat = target.ravel()
            live = by_symbol(flat)
            found, _ = self.outputs(hidden.reshape(-1, h + 1).take(live, 0), flat[live])
            out += np.bincount(owner.ravel()[live], found, len(docs))
        return out


@dataclass
class Vocabulary:
    """The most frequent training tokens (KNOWN + HEAD at most) with their counts, and the totals of all."""

    place: dict[bytes, int]
    log_counts: np.ndarray  # log10(count + 0.1) of each, then that of count 0
    symbol: np.ndarray  # of each
    n: int
    types: int
    tail_norm: np.ndarray  # log10 of N + 0.1 * (V + 1) within each tail class

    def base_norm(self) -> float:
        return float(np.log10(self.n + 0.1 * (self.types + 1)))

    @cached_property
    def tokens(self) -> pa.Array:
        """By place."""
        return pa.array(self.place, pa.binary())

    def places(self, words: list[bytes] | pa.Array | pa.ChunkedArray) -> np.ndarray:
        """-1: not known.  Arrow hashes all known tokens anew in each call, so a call should have many words."""
        return pc.fill_null(pc.index_in(as_binary(words), value_set=self.tokens), -1).to_numpy()

    def symbols(self, words: list[bytes] | pa.Array, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """place (-1: not known) and symbol of each word."""
        place, words = self.places(words) if place is None else place, as_binary(words)
        symbol, rare = self.symbol[place], place < 0
        if rare.any():
            symbol[rare] = HEAD + tails(words.filter(pa.array(rare)))
        return place, symbol


def groups(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Runs of batches with about ``most`` bytes (one batch at least)."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def token_counts(docs: DataFrame) -> DataFrame:
    """token binary, c: over all rows given."""

    def run(batches):
        rows = 0
        for group in groups(batches, COUNT_BYTES):
            found = pc.value_counts(pa.chunked_array([words_of(batch.column("text"))[0] for batch in group]))
            rows += sum(batch.num_rows for batch in group)
            yield pa.RecordBatch.from_arrays([as_binary(found.field("values")), found.field("counts")], ["token", "c"])
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([rows], pa.int64())], ["token", "c"])

    return docs.select("text").mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def least_known(counts: DataFrame, most: int | None = None) -> int:
    """A count that at most ``most`` (KNOWN) tokens reach, from a histogram in steps of a sixteenth of a doubling: a
    few hundred rows, whatever the corpus.  Tokens of the step that would exceed it stay with the rest (``vocabulary`` takes
    the HEAD first of all tokens whatever their step, so the network has its frequent words)."""
    bins = counts.groupBy(F.floor(16 * F.log2("c")).alias("bin")).agg(F.count("*").alias("n"), F.min("c").alias("least"))
    left, least = KNOWN if most is None else most, 2**62
    for r in sorted(bins.collect(), key=lambda r: -r.bin):
        if r.n > left:
            break
        left, least = left - r.n, r.least
    return least


def vocabulary(counts: DataFrame) -> tuple[Vocabulary, np.ndarray]:
    """With the training count of each symbol."""
    pairs = lambda t: zip(t.column("token").to_pylist(), t.column("c").to_pylist(), strict=True)
    first = counts.orderBy(F.desc("c"), "token").limit(HEAD).toArrow()
    known = counts.where(F.col("c") >= least_known(counts)).toArrow()  # KNOWN rows at most
    top = sorted({*pairs(first), *pairs(known)}, key=lambda x: (-x[1], x[0]))
    tokens, c = [t for t, _ in top], np.array([n for _, n in top], np.int64)
    head = pa.array(tokens[:HEAD], pa.binary())

    def by_class(batches):
        n, v = np.zeros(TAILS, np.int64), np.zeros(TAILS, np.int64)
        for batch in batches:
            others = pa.Table.from_batches([batch]).filter(pc.invert(pc.is_in(batch.column("token"), value_set=head))).combine_chunks()
            for token, count in zip(others.column("token").chunks, others.column("c").chunks, strict=True):
                k = tails(token)
                np.add.at(n, k, count.to_numpy())
                np.add.at(v, k, 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(TAILS), pa.int32()), pa.array(n), pa.array(v)], ["k", "n", "v"])

    by_tail = {r.k: (r.n, r.v) for r in counts.mapInArrow(by_class, "k int, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()}
    n = np.array([by_tail.get(k, (0, 0))[0] for k in range(TAILS)])
    v = np.array([by_tail.get(k, (0, 0))[1] for k in range(TAILS)])
    symbol = np.array([i if i < HEAD else HEAD + tail(t) for i, t in enumerate(tokens)] + [HEAD], np.int32)
    mass = np.zeros(START)
    mass[: min(HEAD, len(c))] = c[:HEAD]
    mass[HEAD:] = n
    words = Vocabulary({t: i for i, t in enumerate(tokens)}, np.log10(np.append(c, 0) + 0.1), symbol, int(mass.sum()), int(v.sum()) + min(HEAD, len(tokens)), np.log10(n + 0.1 * (v + 1)))
    return words, mass


def plan(tokens: int) -> tuple[int, int]:
    """Rounds and copies for a number of training tokens."""
    units = max(1, -(-tokens // UNIT))
    copies = math.isqrt(units - 1) + 1
    return -(-units // copies), copies


def rare_words(words: pa.Array, sizes: np.ndarray, rare: np.ndarray, end: bool) -> tuple[pa.Array, pa.Array]:
    """For texts of ``sizes`` words each, the distinct ones of those marked as rare (and the texts' ends, if ``end``), and how often each occurs."""
    found = as_binary(words).filter(pa.array(rare)).dictionary_encode()
    kinds, codes, owner = found.dictionary, found.indices.to_numpy(), np.repeat(np.arange(len(sizes)), sizes)[rare]
    if end:
        codes, owner = np.append(codes, np.full(len(sizes), len(kinds))), np.append(owner, np.arange(len(sizes)))
        kinds = pa.concat_arrays([kinds, pa.array([END], pa.binary())])
    n = max(len(kinds), 1)
    keys, times = np.unique(owner * n + codes, return_counts=True)
    at = pa.array(np.searchsorted(keys, np.arange(len(sizes) + 1) * n), pa.int32())
    return pa.ListArray.from_arrays(at, kinds.take(pa.array(keys % n))), pa.ListArray.from_arrays(at, pa.array(times, pa.int32()))


def symbolised(docs: DataFrame, shared, rounds: int, copies: int) -> DataFrame:
    """r (a number for each row), round (-1: held out) and copy that reads the row, doc_id, n_tokens, n_rare, base and rest
    (known words' share of the scores), rare and times (unknown words), ids (symbols of the whole text, with its end, as bytes),
    written by round; a unit's rows lie together, long ones first."""

    def run(batches):
        keep_memory()
        words, norm = shared.value, shared.value.base_norm()
        (end,), (end_symbol,) = words.symbols([END])
        for group in groups(batches, LOOK_UP_BYTES):
            texts = [words_of(batch.column("text")) for batch in group]
            places = np.split(words.places(pa.chunked_array([tokens for tokens, _ in texts])), np.cumsum([len(tokens) for tokens, _ in texts])[:-1])
            for batch, (tokens, inside), place in zip(group, texts, places, strict=True):
                size, ends = inside + 1, np.cumsum(inside)
                begin = np.append(0, np.cumsum(size))
                sums = lambda x, at=begin[:-1]: np.add.reduceat(x, at)  # noqa: E731  (a text has its end at least)
                symbol = np.insert(words.symbols(tokens, place)[1], ends, end_symbol)
                rare, times = rare_words(tokens, inside, place < 0, end < 0)
                place = np.insert(place, ends, end)
                logs, unknown = words.log_counts[place], place < 0
                logs[unknown] = 0.0
                in_tail = np.where(symbol >= HEAD, logs - words.tail_norm[np.maximum(symbol - HEAD, 0)], 0.0)
                ids = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((2 * begin).astype(np.int32)), pa.py_buffer(symbol.astype(SYMBOL))])
                out = [pa.array(size), pa.array(sums(unknown.astype(np.int64))), pa.array(sums(logs) - size * norm), pa.array(sums(in_tail)), rare, times, ids]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*PLACE.split(), "doc_id"]), *out], [*PLACE.split(), *ROW.split()])

    units = rounds * copies
    rows = docs.withColumn("h", F.xxhash64("doc_id", "text")).withColumn("unit", F.pmod("h", F.lit(units)).cast("int"))
    rows = rows.select(F.when(F.col("held_out"), -1).otherwise(F.col("unit") % rounds).cast("int").alias("round"), F.floor(F.col("unit") / rounds).cast("int").alias("copy"), "unit", "h", F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = rows.mapInArrow(run, "round int, copy int, unit int, h long, doc_id long, n_tokens long, n_rare long, base double, rest double, rare array<binary>, times array<int>, ids binary")
    parts = min(units, PARTS)
    dealt = found.repartitionById(parts, F.pmod("unit", F.lit(parts)).cast("int")).sortWithinPartitions("round", "copy", F.greatest("n_tokens", F.lit(LONG)).desc(), "h")
    return written(dealt.drop("unit", "h").withColumn("r", F.monotonically_increasing_id()), "round")


PLACE, ROW = "round copy unit h", "doc_id n_tokens n_rare base rest rare times ids"


def lists(column: pa.Array) -> list[np.ndarray]:
    """Symbols of each row, as bytes or as integers."""
    if pa.types.is_list(column.type):
        return np.split(column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())[:-1])
    return [np.frombuffer(ids, SYMBOL) for ids in column.to_pylist()]


def lanes(docs: Iterable[np.ndarray], rows: int = BATCH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Consecutive windows of ``rows`` streams of documents, each document with START before it: blocks (WINDOW + 1 or fewer
    steps, live lanes; -1: none) and the numbers of their lanes.  A lane whose document ends goes on with the next, in the same
    window; a window's last symbol is the first of the lane's next one."""
    docs = iter(docs)
    held: list[np.ndarray] = [np.zeros(0, np.int32)] * rows
    more = True
    while True:
        for k in range(rows):
            if more and len(held[k]) <= WINDOW:
                parts, size = [held[k]], len(held[k])
                while size <= WINDOW:
                    doc = next(docs, None)
                    if doc is None:
                        more = False
                        break
                    parts.append(doc)
                    size += len(doc)
                held[k] = np.concatenate(parts)
        live = [k for k in range(rows) if len(held[k]) > 1]
        if not live:
            return
        pieces = [held[k][: WINDOW + 1] for k in live]
        sizes = [*map(len, pieces)]
        if min(sizes) == max(sizes):
            block = np.concatenate(pieces).reshape(len(live), -1).T.astype(np.int64, order="C")
        else:
            block = np.full((max(sizes), len(live)), -1)
            for i, piece in enumerate(pieces):
                block[: len(piece), i] = piece
        for k in live:
            held[k] = held[k][WINDOW:]
        yield block, np.array(live)


def train(seen: DataFrame, m: Gru, rounds: int, copies: int) -> Gru:
    """Rounds of local training and averaging over a table of symbols (round, copy, ids); each round reads its share whole."""
    context = seen.sparkSession.sparkContext
    names, kind = ["copy", "part", "x", "n"], "copy int, part int, x array<double>, n long"

    def send(found: list[tuple]):
        columns = zip(*found, strict=True)
        return [pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.int64()), strict=True)]

    def add(table):
        """Copies of one part, in the order of their numbers."""
        order = np.lexsort((table.column("n").to_numpy(), table.column("copy").to_numpy()))
        x, n = np.stack(table.column("x").to_numpy())[order].sum(0), sum(table.column("n").to_pylist())
        return pa.table(send([(int(table.column("copy")[0].as_py()) // FAN_IN, table.column("part")[0].as_py(), x, n)]), names=names)

    for r in range(rounds):
        shared = context.broadcast(m.flat())  # its size is fixed by the constants above

        def run(batches, shared=shared, m=m):
            keep_memory()
            rows = (row for batch in batches for row in zip(batch.column("copy").to_pylist(), lists(batch.column("ids")), strict=True))
            for copy, docs in groupby(rows, itemgetter(0)):
                own = m.filled(shared.value)
                adam, n, states = Adam(own, RATE), 0, np.zeros((BATCH, HIDDEN), np.float32)
                for block, live in lanes(np.append(np.int32(START), ids) for _, ids in docs):
                    state, targets = states[live], np.where(block[1:] == START, -1, block[1:])
                    _, grads = gradients(own, np.maximum(block[:-1], 0), targets, state)
                    states[live] = state
                    seen_here = int((targets >= 0).sum())
                    adam.step(grads, 4 / seen_here, seen_here / (WINDOW * BATCH))
                    n += seen_here
                flat = own.flat().astype(float) * n
                yield pa.RecordBatch.from_arrays(send([(copy, i, flat[at : at + 4096], n) for i, at in enumerate(range(0, len(flat), 4096))]), names)

        found, left = seen.where(F.col("round") == r).select("copy", "ids").mapInArrow(run, kind), copies
        while left > FAN_IN:  # a tree: a task adds up FAN_IN copies of some weights
            found, left = found.groupBy("part", F.floor(F.col("copy") / FAN_IN)).applyInArrow(lambda table: add(table), kind), -(-left // FAN_IN)
        parts: dict[int, list] = {}
        for p in sorted(found.collect(), key=lambda p: (p.part, p.copy, p.n)):  # FAN_IN copies at most
            parts.setdefault(p.part, []).append(p)
        if parts:
            m = m.filled(np.concatenate([np.sum([p.x for p in ps], axis=0) / sum(p.n for p in ps) for _, ps in sorted(parts.items())]))
    return m


def score_documents(docs: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; rows for which the
    column ``held_out`` is not true teach the model."""
    context = docs.sparkSession.sparkContext
    docs = doc_texts(docs).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    counts = written(token_counts(docs.where(~F.col("held_out"))))
    words, mass = vocabulary(counts)
    rounds, copies = plan(words.n)
    rows = symbolised(docs, context.broadcast(words), rounds, copies)  # KNOWN + HEAD tokens at most
    model = context.broadcast(train(rows, Gru.fresh(mass), rounds, copies))

    def run(batches):
        keep_memory()
        scorer = Scorer(model.value)
        for batch in batches:
            scores = scorer.score(lists(batch.column("ids"))) / np.log(10) + batch.column("rest").to_numpy()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("r", "doc_id", "round", "n_tokens", "n_rare", "base")), pa.array(scores)], ["r", "doc_id", "round", "n_tokens", "n_rare", "base", "score"])

    scored = rows.select("r", "doc_id", "round", "n_tokens", "n_rare", "base", "rest", "ids").mapInArrow(run, "r long, doc_id long, round int, n_tokens long, n_rare long, base double, score double")
    each = rows.select("r", F.inline(F.arrays_zip("rare", "times"))).select("r", F.col("rare").alias("token"), "times")
    joined = each.join(counts, "token", "left").select("r", "times", "c")
    sums = joined.groupBy("r").agg(F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("logs"), F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("known"))
    zero = F.lit(0.0)
    return scored.join(sums, "r", "left").select(
        "doc_id", (F.col("round") < 0).alias("held_out"), "n_tokens",
        (F.col("n_tokens") - F.col("n_rare") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(words.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("logs", zero)).alias("score"),
    )
