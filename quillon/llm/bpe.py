"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Each task takes the distinct pre-tokens of a run of documents as one small corpus and replays
the merges over all of them together: an inverted index leads from a merge to the places of
the token pairs that it joins, the lowest rank goes first, and a merge touches only its two
neighbours.  A pre-token's ids are kept (in a store of bounded size) for the next run.

Null and empty texts have no tokens.  One row comes out for each row that goes in, repeated
rows and null doc_ids included.  Very long texts and pre-tokens are encoded whole; an
index over n bytes takes O(n log n).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import doc_texts, slices, splitter

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Pre-tokens that a task keeps, and the longest one that it keeps.
KEPT_WORDS, KEPT_BYTES = 300_000, 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, of a file with a base64 token and a rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Merges:
    """The merges of a vocabulary: a token pair leads to the rank of its product."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        left, right, product = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None:
                    left.append(a)
                    right.append(b)
                    product.append(rank)
        pairs = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        order = np.argsort(pairs)
        self.pairs = np.append(pairs[order], np.int64(2**63 - 1))
        self.product = np.append(np.array(product, np.int64)[order], NONE)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = a << 32 | b
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.product[at], NONE)


NONE = np.int64(2**62)


class Replay:
    """Words as linked lists of tokens in flat arrays, and an inverted index from a merge (named
    by its rank) to the left ends of the pairs that it joins."""

    def __init__(self, words: list[bytes], merges: Merges) -> None:
        self.merges, sizes = merges, np.fromiter(map(len, words), np.int64, len(words))
        self.token = merges.bytes[np.frombuffer(b"".join(words), np.uint8)]
        self.word = np.repeat(np.arange(len(words)), sizes)
        n, self.first = len(self.token), np.cumsum(sizes) - sizes
        self.right, self.left = np.arange(1, n + 1), np.arange(-1, n - 1)
        self.right[self.first + sizes - 1] = -1
        self.left[self.first] = -1
        self.places: dict[int, list[np.ndarray]] = {}
        self.queue: list[int] = []
        i = np.flatnonzero(self.right >= 0)
        self.note(i, merges.rank(self.token[i], self.token[i + 1]) if len(i) else i)

    def note(self, left: np.ndarray, rank: np.ndarray) -> None:
        """Adds pairs to the index."""
        can = rank < NONE
        left, rank = left[can], rank[can]
        if not len(rank):
            return
        order = np.argsort(rank, kind="stable")
        left, rank = left[order], rank[order]
        cuts = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(rank)]
        for name, a, b in zip(rank[cuts[:-1]].tolist(), cuts, cuts[1:]):
            if name not in self.places:
                self.places[name] = []
                heapq.heappush(self.queue, name)
            self.places[name].append(left[a:b])

    def neighbours(self, i: np.ndarray, product: int) -> tuple[np.ndarray, np.ndarray]:
        """Were the pairs at i merged: the ranks of the new pairs before and after each."""
        before, after = self.left[i], self.right[self.right[i]]
        new = np.full(len(i), product)
        return np.where(before >= 0, self.merges.rank(self.token[before], new), NONE), np.where(after >= 0, self.merges.rank(new, self.token[after]), NONE)

    def apply(self, rank: int, i: np.ndarray) -> None:
        """Merges pairs that have no token in common."""
        gone = self.right[i]
        self.token[i], self.token[gone] = rank, -1
        self.right[i] = after = self.right[gone]
        self.left[after[after >= 0]] = i[after >= 0]
        before = self.left[i]
        new = np.full(len(i), rank)
        self.note(before, np.where(before >= 0, self.merges.rank(self.token[before], new), NONE))
        self.note(i, np.where(after >= 0, self.merges.rank(new, self.token[after]), NONE))

    def next_merges(self, rank: int, i: np.ndarray) -> np.ndarray:
        """Of the pairs at i (sorted), those that may be merged at once.

        Within a word the leftmost goes first, so of pairs that overlap every second one is merged.
        Where a new pair would come before this rank, only the word's first is, and the others wait."""
        word, place = self.word[i], np.arange(len(i))
        same = np.append(False, word[1:] == word[:-1])
        if not same.any():
            return i
        lower = np.minimum(*self.neighbours(i, rank)) <= rank
        lower |= self.merges.rank(np.array([rank]), np.array([rank])) <= rank
        waits = np.isin(word, word[lower]) if lower.any() else np.zeros(len(i), bool)
        overlaps = same & np.append(False, self.right[i[:-1]] == i[1:])
        begin = np.maximum.accumulate(np.where(overlaps, 0, place))
        if (later := waits & same).any():
            self.note(i[later], np.full(later.sum(), rank))
        return i[np.where(waits, ~same, (place - begin) % 2 == 0)]

    def run(self) -> list[list[int]]:
        while self.queue:
            rank = heapq.heappop(self.queue)
            i = np.sort(np.concatenate(found)) if len(found := self.places.pop(rank)) > 1 else np.sort(found[0])
            i = i[(self.token[i] >= 0) & (self.right[i] >= 0)]
            if len(i) > 1:
                i = i[np.append(True, i[1:] != i[:-1])]
            i = i[self.merges.rank(self.token[i], self.token[self.right[i]]) == rank]  # else a neighbour was merged meanwhile
            if len(i):
                self.apply(rank, self.next_merges(rank, i) if len(i) > 1 else i)
        alive = np.flatnonzero(self.token >= 0)
        ids, ends = self.token[alive].tolist(), np.searchsorted(alive, np.append(self.first[1:], len(self.token))).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]


def replay(words: list[bytes], merges: Merges) -> list[list[int]]:
    """Ids of each word (none is empty)."""
    return Replay(words, merges).run() if words else []


class Encoder:
    """Encodes runs of texts; one for each task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.merges, self.split = ranks, Merges(ranks), splitter(pattern)
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, texts: Iterable[str]) -> Iterator[list[int]]:
        pieces = [self.split(t) for t in texts]
        if len(self.known) > KEPT_WORDS:
            self.known = {}
        found, missing = self.known, []
        for word in set(chain.from_iterable(pieces)).difference(found):
            if (whole := self.ranks.get(raw := word.encode())) is not None:
                found[word] = (whole,)
            else:
                missing.append((word, raw))
        found.update(zip((w for w, _ in missing), map(tuple, replay([raw for _, raw in missing], self.merges)), strict=True))
        for words in pieces:
            yield list(chain.from_iterable(map(found.__getitem__, words)))
        for word, _ in missing:
            if len(word) > KEPT_BYTES:
                del found[word]


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, ids array<int>: the general operator."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary file: its size is fixed

    def run(batches):
        encoder = Encoder(shared.value, pattern)
        for batch in batches:
            for part, texts in slices(batch, "text"):
                ids = encoder.encode((t or b"").decode() for t in texts)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """doc_id, bytes binary: the texts that ``encode_documents`` was given; null ids give null."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        vocabulary = _vocabulary(shared.value)
        for batch in batches:
            out = [None if ids is None else b"".join(map(vocabulary.__getitem__, ids)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def _vocabulary(ranks: dict[bytes, int]) -> dict[int, bytes]:
    return {rank: token for token, rank in ranks.items()}


def digest_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Encodes every text, decodes the ids, and returns their digests: no ids leave the task."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        encoder = Encoder(shared.value, pattern)
        vocabulary = _vocabulary(shared.value)
        decimal = {i: str(i) for i in vocabulary}
        for batch in batches:
            for part, texts in slices(batch, "text"):
                counts, hashed, decoded = [], [], []
                for ids in encoder.encode((t or b"").decode() for t in texts):
                    counts.append(len(ids))
                    hashed.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(b"".join(map(vocabulary.__getitem__, ids))).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(hashed, pa.string()), pa.array(decoded, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return doc_texts(docs).mapInArrow(run, SCHEMA)
