"""Packing: best-fit decreasing over a segment tree of remaining capacities.

1. Each task tokenises its documents, ends each with id 0, and cuts documents that are
   longer than a sequence into full windows and a rest.  Only pieces (document, start,
   length, checksum) leave the task, no ids.
2. Pieces are dealt by a hash of their content into shards of a bounded number of
   documents; within a shard Spark's external sort puts the longest first.
3. A task streams through its sorted pieces: the segment tree finds the open sequence with
   the least room that still takes the piece.  It holds open sequences only.

Null and empty texts are a piece of the id 0 alone.  Repeated rows are packed each time.
Rows without doc_id keep it null.  Ties in length are broken by doc_id and start, then by
checksum.  Very long documents take as many windows as they need.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import doc_texts, slices

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"
SHARD_DOCUMENTS = 50_000


class Capacities:
    """Open sequences by remaining room: a segment tree over 0..size whose nodes count the open
    sequences below them, with a stack of sequences at each leaf."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, least: int) -> tuple[int, int] | None:
        """Takes out an open sequence of the least room that is ``least`` or more: (room, sequence)."""
        node = least + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                if not self.count[node]:
                    node += 1
        room = node - self.leaves
        self._change(room, -1)
        return room, self.open[room].pop()


def best_fit(lengths: Iterator[int], size: int) -> Iterator[tuple[int, int]]:
    """(sequence, offset) of each length; the lengths come longest first."""
    tree, fresh = Capacities(size), 0
    for length in lengths:
        found = tree.tightest(length) if length < size else None
        if found is None:
            found, fresh = (size, fresh), fresh + 1
        room, sequence = found
        yield sequence, size - room
        if room > length:
            tree.add(room - length, sequence)


def byte_ranks(tokenizer_json: str) -> dict[bytes, int]:
    """Token bytes to id, of a byte-level BPE file whose ids are in order of their merges.

    Its tokens are written with one visible character for each byte: bytes that are printable in
    Latin-1 stand for themselves, the others, in order, for the characters from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in visible]
    byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    file = json.loads(tokenizer_json)
    special = {x["content"] for x in file.get("added_tokens", [])}
    return {bytes(map(byte_of.__getitem__, token)): i for token, i in file["model"]["vocab"].items() if token not in special}


class Ids:
    """Token ids of a text as little-endian 32-bit bytes: those that the tokenizers library gives for the same
    file, special tokens' strings in a text being ordinary text."""

    def __init__(self, tokenizer_json: str, pattern: str) -> None:
        self.encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=byte_ranks(tokenizer_json), special_tokens={})

    def __call__(self, text: str) -> bytes:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


def cut(docs: DataFrame, tokenizer_json: str, pattern: str, size: int, end_id: int = 0) -> DataFrame:
    """The pieces of all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # a vocabulary file: its size is fixed

    def run(batches):
        ids_of, end = Ids(shared.value, pattern), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part, texts in slices(batch, "text"):
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                    ids = ids_of((text or b"").decode()) + end
                    n = len(ids) // 4
                    for start in range(0, n, size):
                        piece = ids[4 * start : 4 * (start + size)]
                        rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), n))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return doc_texts(docs).mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer_json: str, pattern: str, size: int = 1024, shard_documents: int = SHARD_DOCUMENTS) -> DataFrame:
    """One row for each piece, with its sequence and its place there."""
    shards = max(1, -(-docs.count() // shard_documents))
    dealt = cut(docs, tokenizer_json, pattern, size).repartition(shards, F.xxhash64("doc_id", "start", "ids_crc32"))
    ordered = dealt.sortWithinPartitions(F.desc("length"), "doc_id", "start", "ids_crc32")

    def run(batches):
        base = TaskContext.get().partitionId() << 40
        held: list[pa.RecordBatch] = []  # the batch that the generator below reads from

        def lengths():
            for batch in batches:
                held[:] = [batch]
                yield from batch.column("length").to_pylist()

        sequences, offsets = [], []
        for sequence, offset in best_fit(lengths(), size):
            sequences.append(base + sequence)
            offsets.append(offset)
            if len(sequences) == held[0].num_rows:
                yield pa.RecordBatch.from_arrays([*held[0].columns, pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())], [*held[0].schema.names, "sequence_id", "offset"])
                sequences, offsets = [], []

    return ordered.mapInArrow(run, PACKED)
