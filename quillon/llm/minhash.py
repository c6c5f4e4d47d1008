"""MinHash near-dedup: one permutation, optimal densification, banded buckets, stars of candidates.

1. A task hashes each document's distinct shingles once and keeps the least hash of each of
   ``bands * rows`` bins; empty bins copy the bin that a fixed random sequence leads to.
   Documents with equal sets (one digest) become one representative.
2. Signatures are cut into bands; representatives that share a band's values share a bucket.
   Each bucket ties its members to its least one: as many candidate edges as members.  The
   components of these stars are clusters: whoever shares a bucket is in one.
3. The full shingle sets of a small cluster meet in one task.  There the exact intersections of all its sets are
   counted as a matrix product over the shingles that two or more of them hold; what leaves
   the task is each set's least group member, never pairs.
4. In a large cluster one star edge of each member is confirmed first, to the least of its centres.  Whoever is
   linked to its star's centre needs no more comparisons with those that are too; only buckets
   whose members are not all joined by then meet in blocks, so no pair that shares a bucket
   goes unconfirmed.
5. Confirmed links are joined into components.

Words are lower-cased in A-Z.  A text with fewer words than a shingle has one, all its words;
null, empty and blank texts have none and link with nothing.  Repeated rows share a
digest and so a component.  Rows with one doc_id and different texts are sets of their own: each has
the component of its own text.  Rows without doc_id are returned with null component and not
kept.  Very long texts are one set like any other; blocks are bounded by shingles too.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, kept, written
from .text import U64, Words, doc_texts, mix, slices, small_batches

BANDS, ROWS = 30, 5
#: A block's expected documents and shingles; up to how many clustered ids are sent to the documents.
BLOCK_ROWS, BLOCK_SHINGLES, SENT_IDS = 500, 1_000_000, 200_000


def shingle_sets(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = Words(texts, lower=True)
    at, found = words.windows(words.hashes(), size)
    ends = np.searchsorted(at, words.first)
    out = [np.unique(found[a:b]) for a, b in zip(ends, ends[1:])]
    for i in np.flatnonzero((words.counts() > 0) & (words.counts() < size)):
        whole = b" ".join(bytes(words.data[words.start[w] : words.stop[w]]) for w in range(words.first[i], words.first[i + 1]))
        out[i] = np.frombuffer(hashlib.blake2b(whole, digest_size=8).digest(), U64)
    return out


class OnePermutation:
    """Signatures of sorted hash sets.  ``jumps`` holds, for each bin, where an empty one looks."""

    def __init__(self, bins: int, tries: int = 512) -> None:
        self.bins = bins
        self.bounds = np.array([(i << 64) // bins for i in range(bins)], U64)
        grid = np.arange(bins * tries, dtype=U64).reshape(bins, tries)
        self.jumps = (mix(grid * U64(0x9E3779B97F4A7C15) + U64(1)) % U64(bins)).astype(np.int64)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(hashes, self.bounds)
        ends = np.append(at[1:], len(hashes))
        full = ends > at
        source = np.arange(self.bins)
        empty = np.flatnonzero(~full)
        left = empty
        for t in range(self.jumps.shape[1]):
            if not len(left):
                break
            to = self.jumps[left, t]
            hit = full[to]
            source[left[hit]] = to[hit]
            left = left[~hit]
        if len(left):  # so few bins are full that no try met one
            source[left] = np.flatnonzero(full)[0]
        return hashes[at[source]]


def signatures(docs: DataFrame, size: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, h (hash of the text), n_shingles, digest, band keys; the last two null for empty sets."""

    def run(batches):
        sign = OnePermutation(bands * rows)
        salt = mix(np.arange(1, bands + 1, dtype=U64))
        powers = mix(np.arange(101, 101 + rows, dtype=U64)) | U64(1)
        for batch in batches:
            for part, texts in slices(batch, "text"):
                sets = shingle_sets(texts, size)
                digests, keys = [], []
                for s in sets:
                    if not len(s):
                        digests.append(None)
                        keys.append(None)
                        continue
                    v = sign(s)
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    with np.errstate(over="ignore"):
                        keys.append(mix((v.reshape(bands, rows) * powers).sum(1) + salt).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), part.column("h"), pa.array(map(len, sets), pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "h", "n_shingles", "digest", "keys"],
                )

    return doc_texts(docs).withColumn("h", F.xxhash64("text")).mapInArrow(run, "doc_id long, h long, n_shingles long, digest binary, keys array<long>")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Exact sizes of all intersections (the diagonal is not filled)."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((n, n), np.float32)
    two = times[column] == 2
    a, b = row[two][0::2], row[two][1::2]
    np.add.at(out, (a, b), 1)
    np.add.at(out, (b, a), 1)
    more = times[column] > 2
    row, (_, column) = row[more], np.unique(column[more], return_inverse=True)
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        i, j = np.searchsorted(column, (begin, begin + 2048))
        held = np.zeros((n, min(2048, int(column[-1]) + 1 - begin)), np.float32)
        held[row[i:j], column[i:j] - begin] = 1
        out += held @ held.T
    return out


def grouped(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Least id that each row of a symmetric link matrix reaches."""
    least = ids.copy()
    while True:
        after = np.minimum(least, np.where(linked, least[None, :], np.iinfo(np.int64).max).min(1))
        after = np.minimum(after, least)
        if (after == least).all():
            return least
        least = after


def full_sets(docs: DataFrame, placed: DataFrame, size: int) -> DataFrame:
    """rep, s (the shingles) of the representatives in ``placed`` (doc_id, digest, rep): of rows with one doc_id the one whose
    set has that digest."""

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, "text"):
                sets = [s.tobytes() for s in shingle_sets(texts, size)]
                own = [i for i, (s, d) in enumerate(zip(sets, part.column("digest").to_pylist(), strict=True)) if hashlib.blake2b(s, digest_size=16).digest() == d]
                if own:
                    yield pa.RecordBatch.from_arrays([part.column("rep").take(pa.array(own)), pa.array([sets[i] for i in own], pa.binary())], ["rep", "s"])

    few = placed.count() <= SENT_IDS  # else both sides are shuffled
    rows = doc_texts(docs).withColumn("doc_id", F.col("doc_id").cast("long")).join(F.broadcast(placed) if few else placed, "doc_id")
    return written(rows.select("rep", "digest", "text").mapInArrow(run, "rep long, s binary").dropDuplicates(["rep"]))


def confirmed_stars(sets: DataFrame, stars: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) whose full sets reach the limit: both sets of an edge meet in a row."""
    side = lambda name: sets.select(F.col("rep").alias(name), F.col("s").alias(f"s{name}"))

    def run(batches):
        for batch in batches:
            own = []
            for i, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"), strict=True)):
                x, y = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    own.append(i)
            yield batch.select(["a", "b"]).take(pa.array(own, pa.int64()))

    small_batches(sets.sparkSession)
    met = stars.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
    return met.mapInArrow(run, "a long, b long")


def compared(sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """a, b: links that connect all representatives of a group (groups: cluster, rep, blocks) whose full sets reach the limit."""
    placed = kept(groups.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")))
    placed = F.broadcast(placed) if placed.count() <= SENT_IDS else placed  # few rows are sent to the sets, else both are shuffled
    met = sets.join(placed, "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cluster", F.least("block", "other").alias("lower"), F.greatest("block", "other").alias("upper"), "rep", "s")

    def compare(table):
        rep = table.column("rep").to_numpy()
        found = [np.frombuffer(x, U64) for x in table.column("s").to_pylist()]
        both, n = shared_counts(found), np.array([len(x) for x in found], np.float64)
        linked = 100 * both.astype(np.float64) >= percent * (n[:, None] + n[None, :] - both)
        np.fill_diagonal(linked, False)
        least = grouped(linked, rep)
        some = least < rep
        return pa.table([pa.array(least[some], pa.int64()), pa.array(rep[some], pa.int64())], names=["a", "b"])

    return met.groupBy("cluster", "lower", "upper").applyInArrow(compare, "a long, b long")


def _in_blocks(groups: DataFrame) -> DataFrame:
    """groups (cluster, rep, n): with the number of blocks of each cluster."""
    blocks = groups.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    return groups.join(blocks, "cluster")


def confirmed(docs: DataFrame, reps: DataFrame, banded: DataFrame, stars: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b: links that connect all representatives that share a bucket and whose full sets reach the limit.
    reps: rep, doc_id, digest, n (shingles); banded: rep, key; stars: a, b, key."""
    clusters = components(stars).select(F.col("node").alias("rep"), F.col("component").alias("cluster")).join(reps, "rep")
    groups = kept(_in_blocks(clusters))
    sets = full_sets(docs, groups.select("doc_id", "digest", "rep"), size)
    links = compared(sets, groups.where("blocks = 1").select("cluster", "rep", "blocks"), percent)
    large = groups.where("blocks > 1").select("rep", "n")
    if large.isEmpty():
        return links
    # One edge for each member, to the least of its centres: two sets are sent for a member, whatever the cluster's size.
    own = kept(stars.join(large.select(F.col("rep").alias("b")), "b", "left_semi").groupBy("b").agg(F.min("a").alias("a")))
    direct = kept(confirmed_stars(sets, own, percent))
    joined = components(direct).select(F.col("node").alias("rep"), "component")
    placed = banded.join(large, "rep").join(joined, "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("key")
    # Once for each of its members, however many such buckets it is in.
    rest = _in_blocks(groups.select("cluster", "rep", "n").join(placed.join(mixed, "key").select("rep").distinct(), "rep"))
    return links.unionByName(direct).unionByName(compared(sets, rest.select("cluster", "rep", "blocks"), percent))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, by_text: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; ``by_text``: with h (hash of its text), digest of its set, and
    ``first``: is it the set of the smallest doc_id of its component (of several with that id the one of the least digest)?"""
    signed = kept(signatures(docs, size))
    named = signed.where("digest is not null and doc_id is not null")
    # One row for each distinct set, with a number of its own: a doc_id may stand on several.
    sets = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    one = kept(sets.withColumn("rep", F.monotonically_increasing_id()))
    banded = one.select("rep", F.explode("keys").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("rep").alias("centre"), F.count("*").alias("n")).where("n > 1").select("key", "centre")
    stars = kept(banded.join(buckets, "key").where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b"), "key"))
    shared = banded.join(buckets, "key").select("rep", "key")
    joined = components(confirmed(docs, one.select("rep", "doc_id", "digest", "n"), shared, stars, size, percent)).select(F.col("node").alias("rep"), "component")
    by_rep = one.select("rep", "digest", "doc_id").join(joined, "rep", "left").select("digest", "doc_id", F.coalesce("component", "rep").alias("component"))
    least = by_rep.groupBy("component").agg(F.min(F.struct("doc_id", "digest")).alias("least"))
    by_set = by_rep.join(least, "component").select("digest", F.col("least.doc_id").alias("component_id"), (F.col("digest") == F.col("least.digest")).alias("first"))
    rows = signed.select("doc_id", "h", "n_shingles", "digest").join(by_set, "digest", "left")
    more = ["h", "digest", F.coalesce("first", F.lit(True)).alias("first")] if by_text else []
    out = rows.select("doc_id", "n_shingles", F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component_id")), "doc_id").alias("component_id"), *more)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group, all columns: that of the smallest doc_id (of several texts with that id one, of
    rows equal in doc_id and text any one).  Rows with one doc_id and texts of different groups stay each, as
    do all rows without doc_id; of rows without words one stays for each doc_id."""
    found = near_duplicates(docs, size, percent, by_text=True)
    stay = found.where("kept and first").groupBy("doc_id", "digest").agg(F.min("h").alias("h")).select(F.col("doc_id").alias("d"), "h").distinct()
    # The row is held in a struct, so that no name of its columns can meet those of the join.
    named = docs.where("doc_id is not null").select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"))
    # Two sets of an id may have one text's hash each; equal rows collapse after the join, which needs no sort of the texts.
    left = named.join(stay.hint("shuffle_hash"), ["d", "h"], "left_semi").dropDuplicates(["d", "h"])
    return left.select("row.*").unionByName(docs.where("doc_id is null"))
