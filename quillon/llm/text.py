"""Words and word hashes of Arrow batches, without a Python object per word.

A word is a maximal run of characters other than U+0020 and U+0009..U+000D.  In
UTF-8 those six are single bytes that occur nowhere inside another character, so
words can be cut from the bytes.  ``bytes.split()`` cuts at exactly these six.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 5  # odd, 5 modulo 8: its powers repeat as late as they can
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _fixed_noise(n: int, salt: int) -> np.ndarray:
    x = np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(salt)
    return mix(mix(x))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(33))
        x = x * U64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> U64(29))
        x = x * U64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> U64(32))


class Powers:
    """Powers of an odd base modulo 2**64 and their inverses, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(16, (n - 1).bit_length())
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, _BASE, U64)]))
                self.down = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, pow(_BASE, -1, 1 << 64), U64)]))
        return self.up, self.down


_POWERS = Powers()
_BYTES = {salt: _fixed_noise(256, salt) for salt in (17, 4099)}


class Words:
    """The words of some documents: flat arrays in document order.

    start, stop: byte offsets into ``data``; doc: the document of each word;
    first: for each document the index of its first word (one more entry than documents).
    """

    def __init__(self, texts: list[bytes | None], lower: bool) -> None:
        self.n_docs = len(texts)
        data = np.frombuffer(b"\n".join(t or b"" for t in texts), np.uint8)
        self.data = _LOWER[data] if lower else data
        ends = np.cumsum(np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts)))
        space = np.ones(len(data) + 2, bool)
        space[1:-1] = SPACE[data]
        change = np.flatnonzero(space[1:] != space[:-1])
        self.start, self.stop = change[0::2], change[1::2]
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends)]).astype(np.int64)
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, salt: int = 17) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self):
            return np.zeros(0, U64)
        up, down = _POWERS.get(len(self.data) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(self.data) + 1, U64)
            np.cumsum(_BYTES[salt][self.data] * up[: len(self.data)], out=sums[1:])
            return mix((sums[self.stop] - sums[self.start]) * down[self.start] + (self.stop - self.start).astype(U64))

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word, and hash, of each run of ``size`` words of one document."""
        n = len(hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        at = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        return at, mix(rolled(hashes, size))[at]


def rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """For each position the sum of ``hashes[i + j] * base**j`` over ``size`` places; sums of the
    parts of a window combine into that of the whole."""
    n = len(hashes) - size + 1
    with np.errstate(over="ignore"):
        done, out, step = 0, np.zeros(max(n, 0), U64), 1
        part, bits = hashes, size
        factor = _BASE
        while bits:
            if bits & 1:
                out += part[done : done + n] * U64(pow(_BASE, done, 1 << 64))
                done += step
            bits >>= 1
            if bits:
                part = part[:-step] + part[step:] * U64(factor)
                factor = factor * factor % (1 << 64)
                step *= 2
        return out


#: Latin letters below U+0250 without signs between them, and the other characters for which Python's own
#: classes agree with those of the patterns of byte-level tokenizers.
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_PLAIN = re.compile(rf"[\t-\r -~{_LATIN}]*").fullmatch


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """Matches of a pattern with \\p{L} and \\p{N}; texts of Latin letters and ASCII take the standard library's
    engine, which is faster and finds the same."""
    full = regex.compile(pattern).findall
    plain = pattern.replace(r"\p{L}\p{N}]", f"{_LATIN}0-9]").replace(r"\p{L}", f"[{_LATIN}]").replace(r"\p{N}", "[0-9]")
    if "\\p" in plain:
        return full
    fast = re.compile(plain).findall
    return lambda text: fast(text) if _PLAIN(text) else full(text)


#: Bytes of text that a task holds as arrays at a time, and of an Arrow batch between Spark and Python.
SLICE_BYTES, BATCH_BYTES = 1 << 20, 4 << 20


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Cuts a batch into runs of rows with about ``most`` bytes of text (one row at least), with
    the column's values as bytes."""
    values = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(values.cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > most:
            part = batch.slice(begin, i - begin)
            yield part, part.column(column).cast(pa.large_binary()).to_pylist()
            begin, total = i, 0
        total += size
    if begin < batch.num_rows:
        part = batch.slice(begin)
        yield part, part.column(column).cast(pa.large_binary()).to_pylist()
    pa.default_memory_pool().release_unused()


def small_batches(spark) -> None:
    """Bounds Arrow batches by bytes: rows alone say little about the size of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def doc_texts(docs):
    """doc_id and text alone: other columns, whatever their names, never reach an operator."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text")
