"""Substring dedup: windows of words that start at two places or more, by level-wise doubling.

The final length is reached over half and quarter of it, rounded up (35: 9, 18, 35).  A level asks
which runs of its length occur twice; only final windows made of such runs go on to the
next.  Up to the last level a window is represented by one run inside it, the leftmost with the
least hash: equal windows choose the same run, so the few chosen runs decide exactly
whether a window can still be a repeat, and a twentieth of all positions is shuffled.
After the first level candidates are stretches of word hashes without their documents; equal
stretches become one with a count, so a group of copies costs as much as one of them.  The
last level compares every window of the surviving stretches.  What is repeated within a text or a
stretch is found there and sent once, and counts are summed before they are sent, so that a very
common run is no large group; the join with the runs found can be split by adaptive execution.

The last level compares 96 bits of a window (two independent hashes); n candidate windows give about
n*n/2**97 false repeats.
Null, empty and short texts have no window and keep all their words.  Repeated rows are
places of their own: both lose what they share, as do rows with one doc_id or none.  In a very
long text only its surviving stretches are shuffled, besides one copy of the text for each join.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import discard, written
from .text import U64, Words, mix, rolled, slices, small_batches

KEYS = ["d", "h"]


def levels(size: int) -> list[int]:
    return sorted({-(-size // 4), -(-size // 2), size})


def chosen(hashes: np.ndarray, starts: np.ndarray, length: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For windows of ``size`` words at ``starts``: hash of their leftmost least run of ``length`` words, and its
    place."""
    value = mix(rolled(hashes, length))
    place, width, step = np.arange(len(value)), size - length + 1, 1

    def least(v, p, by):
        left = v[:-by] <= v[by:]
        return np.where(left, v[:-by], v[by:]), np.where(left, p[:-by], p[by:])

    while 2 * step <= width:
        value, place = least(value, place, step)
        step *= 2
    if width > step:
        value, place = least(value, place, width - step)
    return value[starts], place[starts]


def stretches(starts: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Unions of the windows at ``starts`` (sorted): first word, word after the last."""
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > size)
    return list(zip(starts[np.insert(cuts + 1, 0, 0)].tolist(), (starts[np.append(cuts, len(starts) - 1)] + size).tolist()))


def keyed(docs: DataFrame) -> DataFrame:
    """Text with a key that equal rows share."""
    small_batches(docs.sparkSession)
    return docs.select(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("d"), F.xxhash64("text").alias("h"), "text")


def _starts(words: Words, size: int) -> np.ndarray:
    n = len(words) - size + 1
    return np.flatnonzero(words.doc[:n] == words.doc[size - 1 :]) if n > 0 else np.zeros(0, np.int64)


def _distinct(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the first of each (group, value), and 1 or 2: once, or more often."""
    order = np.lexsort((value, group))
    first = np.flatnonzero(np.append(True, (np.diff(group[order]) != 0) | (np.diff(value[order]) != 0)))
    return order[first], np.minimum(np.diff(np.append(first, len(order))), 2)


def _first_level(rows: DataFrame, length: int, size: int) -> DataFrame:
    """d, h, run, n: the chosen runs of all documents, each once; n is 2 if it occurs there more often."""

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, "text"):
                words = Words(texts, lower=False)
                starts = _starts(words, size)
                if len(starts):
                    value, place = chosen(words.hashes(), starts, length, size)
                    new = np.append(True, place[1:] != place[:-1])
                    value, doc = value[new].view(np.int64), words.doc[place[new]]
                    at, n = _distinct(doc, value)
                    row = pa.array(doc[at])
                    yield pa.RecordBatch.from_arrays([part.column("d").take(row), part.column("h").take(row), pa.array(value[at]), pa.array(n, pa.int32())], [*KEYS, "run", "n"])

    return rows.mapInArrow(run, "d long, h long, run long, n int")


def _often(runs: DataFrame, *keys: str) -> DataFrame:
    """The runs that occur twice or more."""
    return runs.groupBy(*keys).agg(F.sum("n").alias("times")).where("times > 1").select(*keys)


def _repeated(runs: DataFrame, by: list[str]) -> DataFrame:
    """For each ``by``: the array of its runs that occur twice or more."""
    return runs.join(_often(runs, "run"), "run").groupBy(*by).agg(F.collect_list("run").alias("runs"))


def _cut_documents(rows: DataFrame, hits: DataFrame, length: int, size: int) -> DataFrame:
    """d, h, first, sid, words: the stretches of documents that survive."""

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, "text"):
                words = Words(texts, lower=False)
                starts, hashes = _starts(words, size), words.hashes()
                if not len(starts):
                    continue
                value, _ = chosen(hashes, starts, length, size)
                out = []
                bounds = np.searchsorted(starts, words.first)
                for i, found in enumerate(part.column("runs")):
                    a, b = bounds[i], bounds[i + 1]
                    alive = starts[a:b][np.isin(value[a:b].view(np.int64), found.values.to_numpy())]
                    for first, last in stretches(alive, size):
                        raw = hashes[first:last].tobytes()
                        out.append((part["d"][i].as_py(), part["h"][i].as_py(), first - int(words.first[i]), hashlib.blake2b(raw, digest_size=16).digest(), raw))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [*KEYS, "first", "sid", "words"])

    return rows.join(hits.hint("shuffle_hash"), KEYS).mapInArrow(run, "d long, h long, first long, sid binary, words binary")


def _level(distinct: DataFrame, length: int, size: int) -> DataFrame:
    """s, run, n: the chosen runs of the distinct stretches, each once; n is 2 if it occurs more often."""

    def run(batches):
        for batch in batches:
            for s, n, raw in zip(*(batch.column(c).to_pylist() for c in ("s", "n", "words")), strict=True):
                hashes = np.frombuffer(raw, U64)
                value, place = chosen(hashes, np.arange(len(hashes) - size + 1), length, size)
                value, times = np.unique(value[np.append(True, place[1:] != place[:-1])].view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), s)), pa.array(value), pa.array(np.minimum(times * n, 2), pa.int32())], ["s", "run", "n"])

    return distinct.select("s", "n", "words").mapInArrow(run, "s long, run long, n int")


def _cut_stretches(distinct: DataFrame, hits: DataFrame, length: int, size: int) -> DataFrame:
    """old, at, sid, words: what is left of each stretch."""

    def run(batches):
        for batch in batches:
            out = []
            for old, raw, found in zip(batch.column("sid").to_pylist(), batch.column("words").to_pylist(), batch.column("runs"), strict=True):
                hashes = np.frombuffer(raw, U64)
                starts = np.arange(len(hashes) - size + 1)
                value, _ = chosen(hashes, starts, length, size)
                for first, last in stretches(starts[np.isin(value.view(np.int64), found.values.to_numpy())], size):
                    part = hashes[first:last].tobytes()
                    out.append((old, first, hashlib.blake2b(part, digest_size=16).digest(), part))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["old", "at", "sid", "words"])

    return distinct.join(hits, "s").select("sid", "words", "runs").mapInArrow(run, "old binary, at long, sid binary, words binary")


def _windows(raw: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of every window."""
    hashes = np.frombuffer(raw, U64)
    return mix(rolled(hashes, size)).view(np.int64), (mix(rolled(mix(hashes ^ U64(0x5851F42D4C957F2D)), size)) >> U64(32)).astype(np.uint32).view(np.int32)


def _last_level(distinct: DataFrame, size: int) -> DataFrame:
    """s, spans: the words of each stretch that repeated windows cover, in one row or more.

    A stretch that occurs twice is covered whole, and so are windows that a stretch holds twice; only the other
    windows ask whether they occur elsewhere."""

    def count(batches):
        for batch in batches:
            for n, raw in zip(*(batch.column(c).to_pylist() for c in ("n", "words")), strict=True):
                value, check = _windows(raw, size)
                at, times = _distinct(check, value)
                yield pa.RecordBatch.from_arrays([pa.array(value[at]), pa.array(check[at]), pa.array(np.minimum(times * n, 2), pa.int32())], ["run", "check", "n"])

    def known(batches):
        for batch in batches:
            names, spans = [], []
            for s, n, raw in zip(*(batch.column(c).to_pylist() for c in ("s", "n", "words")), strict=True):
                if n > 1:
                    found = [(0, len(raw) // 8)]
                else:
                    value, check = _windows(raw, size)
                    at, times = _distinct(check, value)
                    lone = np.zeros(len(value), bool)
                    lone[at[times == 1]] = True
                    found = stretches(np.flatnonzero(~lone), size)
                if found:
                    names.append(s)
                    spans.append([x for ab in found for x in ab])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(spans, pa.list_(pa.int64()))], ["s", "spans"])

    def ask(batches):
        for batch in batches:
            for s, raw in zip(*(batch.column(c).to_pylist() for c in ("s", "words")), strict=True):
                value, check = _windows(raw, size)
                at, times = _distinct(check, value)
                at = np.sort(at[times == 1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), s)), pa.array(at, pa.int32()), pa.array(value[at]), pa.array(check[at])], ["s", "at", "run", "check"])

    counted = distinct.select("n", "words").mapInArrow(count, "run long, check int, n int")
    asking = distinct.where("n = 1").select("s", "words").mapInArrow(ask, "s long, at int, run long, check int")
    found = asking.join(_often(counted, "run", "check"), ["run", "check"]).groupBy("s").agg(F.sort_array(F.collect_list("at")).alias("at"))

    def join_up(batches):
        for batch in batches:
            spans = [[x for ab in stretches(np.asarray(at.values), size) for x in ab] for at in batch.column("at")]
            yield pa.RecordBatch.from_arrays([batch.column("s"), pa.array(spans, pa.list_(pa.int64()))], ["s", "spans"])

    kind = "s long, spans array<long>"
    return found.mapInArrow(join_up, kind).unionByName(distinct.select("s", "n", "words").mapInArrow(known, kind))


def _numbered(stretched: DataFrame) -> DataFrame:
    """sid, words, n, and a short id ``s``, written once."""
    return written(stretched.withColumn("s", F.monotonically_increasing_id()))


def repeated_spans(docs: DataFrame, size: int) -> DataFrame:
    """d, h, spans (flat array of first word, word after the last): what each document loses."""
    rows = keyed(docs).where("text is not null")
    steps = levels(size)
    runs = written(_first_level(rows, steps[0], size))
    cut = written(_cut_documents(rows, _repeated(runs, KEYS), steps[0], size))
    discard(runs)
    alive = _numbered(cut.groupBy("sid").agg(F.first("words").alias("words"), F.count("*").alias("n")))
    places = written(cut.select(*KEYS, "first", "sid"))
    discard(cut)
    for length in steps[1:-1]:
        runs = written(_level(alive, length, size))
        part = written(_cut_stretches(alive, _repeated(runs, ["s"]), length, size))
        discard(runs)
        moved = written(places.withColumnRenamed("sid", "old").join(part.select("old", "at", "sid"), "old").select(*KEYS, (F.col("first") + F.col("at")).alias("first"), "sid"))
        counts = alive.select(F.col("sid").alias("old"), "n")
        fewer = _numbered(part.join(counts, "old").groupBy("sid").agg(F.first("words").alias("words"), F.sum("n").alias("n")))
        for table in (part, places, alive):
            discard(table)
        places, alive = moved, fewer
    found = written(alive.select("s", "sid").join(_last_level(alive, size), "s").select("sid", "spans"))
    discard(alive)
    placed = places.join(found, "sid").select(*KEYS, F.transform("spans", lambda x: x + F.col("first")).alias("spans"))
    return placed.groupBy(*KEYS).agg(F.flatten(F.collect_set("spans")).alias("spans"))


def with_spans(docs: DataFrame, size: int) -> DataFrame:
    """All rows and columns of ``docs`` in a struct, with the spans to remove (null: none)."""
    spans = written(repeated_spans(docs, size))
    row = docs.select(F.struct("*").alias("row"))
    keys = row.withColumns({"d": F.coalesce(F.col("row.doc_id"), F.lit(-(2**63))), "h": F.xxhash64("row.text")})
    return keys.join(spans.hint("shuffle_hash"), KEYS, "left").select("row", "spans")


def keep_words(text: bytes | None, spans: list[int] | None) -> tuple[int, list[bytes]]:
    """Number of words, and the words left."""
    words = (text or b"").split()
    if not spans:
        return len(words), words
    gone = np.zeros(len(words), bool)
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        gone[a:b] = True
    return len(words), [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def digest(docs: DataFrame, size: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, "text"):
                n, gone, digests = [], [], []
                for text, spans in zip(texts, part.column("spans").to_pylist(), strict=True):
                    total, left = keep_words(text, spans)
                    n.append(total)
                    gone.append(total - len(left))
                    digests.append(hashlib.sha256(b" ".join(left)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = with_spans(docs.select("doc_id", "text"), size)
    return rows.select("row.doc_id", "row.text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, size: int = 35) -> DataFrame:
    """``docs`` with every covered word cut out of ``text``; white space between kept words stays as it was
    and texts that lose nothing are unchanged.  All columns are returned."""

    @F.pandas_udf("string")
    def cut(text, spans):
        return text.combine(spans, lambda t, s: t if t is None or s is None or not len(s) else _without(t.encode(), s))

    rows = with_spans(docs, size)
    return rows.withColumn("new", cut("row.text", "spans")).select(*(F.col("new").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def _without(text: bytes, spans: list[int]) -> str:
    words = Words([text], lower=False)
    gone = np.zeros(len(words), bool)
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        gone[a:b] = True
    cuts = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    out, at = [], 0
    for a, b in zip(cuts[::2], cuts[1::2], strict=True):
        out.append(text[at : words.start[a]])
        at = words.start[b] if b < len(words) else len(text)
    return (b"".join(out) + text[at:]).decode().strip()
