"""Quality rules: compression bands.

A text is compressed with zstandard as a whole and in fixed chunks.  Repetitive text shrinks
too far and noise does not shrink enough; how far prose shrinks depends on its length, so
each length class has limits of its own.  Rules on word counts stand before the bands.

Null and empty texts have no words and fail.  A repeated row gets the same verdict each
time.  A very long text is judged whole, then chunk by chunk; the last chunk ends with the text,
so that every byte stands in one.  A text of one chunk or less is judged whole only.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Words, doc_texts, slices

SCHEMA = """doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,
base_failed boolean, kept boolean, ratio double, worst_low double, worst_high double"""
KINDS = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()] * 3


@dataclass(frozen=True)
class Bands:
    """Limits on compressed size / size.  ``below``: length classes by their upper ends in bytes; ``low``
    and ``high``: the limits of each class and of all longer texts.  A chunk of ``chunk`` bytes has
    the limits of a text of its length, widened by ``slack``; up to ``bad_chunks`` of the
    chunks may lie outside."""

    min_words: int = 50
    max_repeat_percent: int = 50
    level: int = 3
    below: tuple[int, ...] = (512, 1024, 2048, 4096, 8192, 16384)
    low: tuple[float, ...] = (0.50, 0.475, 0.45, 0.435, 0.415, 0.40, 0.38)
    high: tuple[float, ...] = (0.80, 0.74, 0.65, 0.60, 0.56, 0.52, 0.50)
    chunk: int = 4096
    slack: float = 0.02
    bad_chunks: float = 0.34

    def inside(self, size: int, ratio: float, slack: float = 0.0) -> bool:
        k = bisect_right(self.below, size)
        return self.low[k] - slack <= ratio <= self.high[k] + slack


def ratios(text: bytes, bands: Bands, press) -> tuple[float, list[float]]:
    """Of the whole and of each chunk."""
    n, size = len(text), bands.chunk
    starts = [*range(0, n - size + 1, size), *([n - size] if n % size else [])] if n > size else []
    return len(press(text)) / n, [len(press(text[a : a + size])) / size for a in starts]


def judge(text: bytes, bands: Bands, press) -> tuple[bool, float | None, float | None, float | None]:
    if not text:
        return False, None, None, None
    whole, chunks = ratios(text, bands, press)
    outside = sum(not bands.inside(bands.chunk, r, bands.slack) for r in chunks)
    kept = bands.inside(len(text), whole) and outside <= bands.bad_chunks * len(chunks)
    return kept, whole, min(chunks, default=None), max(chunks, default=None)


def word_rules(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """Counts of each text, by array operations over all of them."""
    words = Words(texts, lower=False)
    n, starts = words.counts(), np.zeros(len(words.data) + 1, np.int64)
    np.cumsum((words.data & 0xC0) != 0x80, out=starts[1:])  # code points begin at these bytes
    per_word = starts[words.stop] - starts[words.start]
    sums = np.concatenate([[0], np.cumsum(per_word)])
    word_chars = sums[words.first[1:]] - sums[words.first[:-1]]
    at, hashed = words.windows(words.hashes(), 3)
    covered = np.zeros(len(words) + 3, bool)
    if len(at):
        order = np.lexsort((hashed, words.doc[at]))
        h, d = hashed[order], words.doc[at][order]
        same = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
        twice = at[order[np.append(same, False) | np.insert(same, 0, False)]]
        for k in range(3):
            covered[twice + k] = True
    repeated = np.concatenate([[0], np.cumsum(covered[: len(words)])])
    symbols = [0 if t is None else sum(map(t.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))) for t in texts]
    lines = []
    for t in texts:
        with_word = [x for x in (t or b"").split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
        lines.append(len(with_word) - len(set(with_word)))
    return {
        "n_words": n,
        "word_chars": word_chars,
        "n_symbols": np.array(symbols, np.int64),
        "n_dup_lines": np.array(lines, np.int64),
        "n_repeat_words": repeated[words.first[1:]] - repeated[words.first[:-1]],
    }


def verdicts(texts: list[bytes | None], bands: Bands) -> dict[str, list | np.ndarray]:
    rules = word_rules(texts)
    failed = (rules["n_words"] < bands.min_words) | (100 * rules["n_repeat_words"] > bands.max_repeat_percent * rules["n_words"])
    press = zstandard.ZstdCompressor(level=bands.level).compress
    found = [judge(t or b"", bands, press) for t in texts]
    return rules | {
        "base_failed": failed,
        "kept": np.array([x[0] for x in found], bool) & ~failed,
        "ratio": [x[1] for x in found],
        "worst_low": [x[2] for x in found],
        "worst_high": [x[3] for x in found],
    }


def quality_report(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """One row for each row of ``docs``; no shuffle."""

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, "text"):
                columns = verdicts(texts, bands)
                values = [part.column("doc_id").to_pylist(), *columns.values()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, KINDS, strict=True)], ["doc_id", *columns])

    return doc_texts(docs).mapInArrow(run, SCHEMA)


def quality_filter(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows of ``docs`` that pass, all columns unchanged."""

    @F.pandas_udf("boolean")
    def passes(text: pd.Series) -> pd.Series:
        batch = pa.RecordBatch.from_arrays([pa.array(text, pa.string())], ["text"])
        return pd.Series(np.concatenate([verdicts(texts, bands)["kept"] for _, texts in slices(batch, "text")] or [np.zeros(0, bool)]))

    return docs.where(passes(docs["text"]))
