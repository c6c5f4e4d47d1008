"""Cross-tokenizer alignment by byte-owner arrays.

Two tokenizers cut one byte string in their own ways.  ``np.repeat`` writes, for each byte, the number of the token that
owns it, once for A and once for B.  Where the pair of owners changes an overlap begins; where both change
at once is a cut, and the tokens between two cuts are a group: the least runs of A and B tokens with the same bytes.

A is a byte-level BPE file, B a sentencepiece model whose pieces hold no space after another character, so that its words can be
encoded one by one and a word met before is looked up (another model is given whole texts).

Counts of linked id pairs over the corpus: documents are encoded once into a compressed table; its links are summed by
pair; pairs that make up at least 1/HOT_PAIRS of all links (so at most HOT_PAIRS of them, whatever the
corpus) are broadcast and looked up where the links lie, links of rarer pairs are joined.  A rare pair is never a hot
key.  Then each document's sums come together by a number of the row.

A text that is null, empty, or whose joined token bytes differ from a space and the text for either tokenizer
has no tokens: zeros and an empty string.  Repeated rows are aligned, and count, each time.  Whole texts are read; special
tokens' strings in them are ordinary text.  Columns beside doc_id and text never reach the operator.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import discard, kept, written
from .packing import byte_ranks
from .text import doc_texts, slices

#: Pairs that are broadcast at most.  Words of B that a task remembers, their longest length in characters.
HOT_PAIRS, HELD_WORDS, LONGEST_WORD = 500_000, 300_000, 64
#: An id pair in one number: A's id times this, plus B's.
_FIRST = 1 << 32
#: Texts without tokens get this.
NONE = (0, 0, 0, "", [])


class Tokens:
    """Ids of both tokenizers, and their bytes."""

    def __init__(self, a_json: str, a_pattern: str, b_model: bytes) -> None:
        ranks = byte_ranks(a_json)
        self.a = tiktoken.Encoding("alignment", pat_str=a_pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, t)), np.int64) for t in (self.a_bytes, self.b_bytes))
        self.by_word = "▁" in pieces and not any("▁" in p.lstrip("▁") for p in pieces)
        self.words: dict[str, list[int]] = {}
        self.space = [self.b.piece_to_id("▁")]

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        if not self.by_word:
            return self.b.encode(texts, num_threads=1)
        cut = [_WORDS(" " + t.replace("▁", " ")) for t in texts]  # one and the same to the tokenizer
        if len(self.words) > HELD_WORDS:
            self.words.clear()
        self.words[" "] = self.space  # without a text the tokenizer adds no space
        new = list({w for words in cut for w in words if w not in self.words})
        if new:  # the tokenizer adds the first space itself
            self.words.update(zip(new, self.b.encode([w[1:] for w in new], num_threads=1), strict=True))
        out = [[i for w in words for i in self.words[w]] for words in cut]
        for w in new:
            if len(w) > LONGEST_WORD:
                del self.words[w]
        return out


#: Each word with the spaces before it; spaces at the end alone.
_WORDS = re.compile(" +[^ ]+| +").findall


def owners(sizes: np.ndarray) -> np.ndarray:
    """The token that owns each byte."""
    return np.repeat(np.arange(len(sizes)), sizes)


def aligned(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of token sizes over the same bytes: A and B token of each overlap in order of bytes, and the last A and B token
    of each group."""
    a, b = owners(a_sizes), owners(b_sizes)
    a_new, b_new = a[1:] != a[:-1], b[1:] != b[:-1]
    begins = np.flatnonzero(np.concatenate([np.ones(min(len(a), 1), bool), a_new | b_new]))
    closes = np.flatnonzero(np.concatenate([a_new & b_new, np.ones(min(len(a), 1), bool)]))
    return a[begins], b[begins], a[closes], b[closes]


def groups_texts(a_ids: np.ndarray, b_ids: np.ndarray, a_last: np.ndarray, b_last: np.ndarray) -> np.ndarray:
    """Pieces of text in the order of the groups, as strings: `a1,a2|b1;` and so on."""
    a_end, b_end = np.zeros(len(a_ids), bool), np.zeros(len(b_ids), bool)
    a_end[a_last], b_end[b_last] = True, True
    a_group, b_group = np.cumsum(a_end) - a_end, np.cumsum(b_end) - b_end
    order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
    signs = np.concatenate([np.where(a_end, 1, 0), np.where(b_end, 2, 0)])[order]
    return np.concatenate([a_ids, b_ids])[order] * 3 + signs


class Written(dict):
    """Number of id and sign to text, made when first asked for."""

    def __missing__(self, key: int) -> str:
        text = self[key] = f"{key // 3}{',|;'[key % 3]}"
        return text


def align_texts(tokens: Tokens, texts: list[str | None], written_ids: Written) -> list[tuple]:
    """n_a, n_b, n_groups, groups (text), pairs (of each link) of each text."""
    whole = [i for i, t in enumerate(texts) if t]
    out: list[tuple] = [NONE] * len(texts)
    a_all = [tokens.a.encode_to_numpy(" " + texts[i], disallowed_special=()).astype(np.int64) for i in whole]
    for i, a_ids, b_list in zip(whole, a_all, tokens.encode_b([texts[i] for i in whole]), strict=True):
        raw = (" " + texts[i]).encode()
        if b"".join(map(tokens.b_bytes.__getitem__, b_list)) != raw or b"".join(map(tokens.a_bytes.__getitem__, a_ids.tolist())) != raw:
            continue
        b_ids = np.array(b_list, np.int64)
        _, _, a_last, b_last = aligned(tokens.a_sizes[a_ids], tokens.b_sizes[b_ids])
        text = "".join(map(written_ids.__getitem__, groups_texts(a_ids, b_ids, a_last, b_last).tolist()))
        out[i] = len(a_ids), len(b_ids), len(a_last), text[:-1], a_ids[a_last] * _FIRST + b_ids[b_last]
    return out


ENCODED = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>"


def encoded(docs: DataFrame, a_json: str, a_pattern: str, b_model: bytes) -> DataFrame:
    """ENCODED for each row: its digest, and the id pair of each link."""
    shared = docs.sparkSession.sparkContext.broadcast((a_json, a_pattern, b_model))  # vocabulary files: their size is fixed

    def run(batches: Iterable[pa.RecordBatch]):
        tokens, strings = Tokens(*shared.value), Written()
        for batch in batches:
            for part, texts in slices(batch, "text"):
                found = align_texts(tokens, [None if t is None else t.decode() for t in texts], strings)
                hashes = [hashlib.sha256(f[3].encode()).hexdigest() if f[0] else "" for f in found]
                counts = [pa.array([f[k] for f in found], pa.int64()) for k in range(3)]
                offsets = np.concatenate([[0], np.cumsum([len(f[4]) for f in found])]).astype(np.int32)
                pairs = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.asarray(f[4], np.int64) for f in found])))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *counts, pa.array(hashes), pairs], [c.split()[0] for c in ENCODED.split(", ")])

    return doc_texts(docs).mapInArrow(run, ENCODED)


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n, best (is n the highest among pairs with the same B id?)."""
    counts = kept(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    highest = counts.groupBy(F.pmod("pair", F.lit(_FIRST)).alias("b_id")).agg(F.max("n").alias("most"))  # a row for each id of B's vocabulary
    return counts.join(F.broadcast(highest), F.pmod("pair", F.lit(_FIRST)) == F.col("b_id")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


SUMS = "at long, n_best long, count_sum long"


def link_sums(rows: DataFrame, counts: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """For rows (at: their number, pairs): n_best and count_sum over all links; several rows for one number."""
    spark = rows.sparkSession
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = total // hot_pairs + 1  # a pair with more than total / hot_pairs links: fewer than hot_pairs of them
    table = counts.where(F.col("n") >= least).toArrow().sort_by("pair")
    hot = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "n", "best")))

    def place(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(hot.value[0], values), max(len(hot.value[0]) - 1, 0))
        return at, (hot.value[0][at] == values if len(hot.value[0]) else np.zeros(len(values), bool))

    def sums(batches):
        for batch in batches:
            pairs = batch.column("pairs")
            sizes = pairs.value_lengths().to_numpy(zero_copy_only=False)
            at, known = place(pairs.flatten().to_numpy())
            row = np.repeat(np.arange(batch.num_rows), sizes)[known]
            n, best = (np.zeros(batch.num_rows, np.int64) for _ in range(2))
            np.add.at(n, row, hot.value[1][at[known]])
            np.add.at(best, row, hot.value[2][at[known]].astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("at"), pa.array(best), pa.array(n)], ["at", "n_best", "count_sum"])

    def rest(batches):
        for batch in batches:
            pairs = batch.column("pairs")
            values = pairs.flatten().to_numpy()
            _, known = place(values)
            row = np.repeat(batch.column("at").to_numpy(), pairs.value_lengths().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(row[~known]), pa.array(values[~known])], ["at", "pair"])

    near = rows.select("at", "pairs").mapInArrow(sums, SUMS)
    if least == 1:
        return near
    far = rows.select("at", "pairs").mapInArrow(rest, "at long, pair long").groupBy("at", "pair").agg(F.count("*").alias("k"))
    rare = counts.where(F.col("n") < least)
    joined = far.join(rare, "pair").select("at", (F.col("best").cast("long") * F.col("k")).alias("n_best"), (F.col("n") * F.col("k")).alias("count_sum"))
    return near.unionByName(joined)


def align_documents(docs: DataFrame, a_json: str, a_pattern: str, b_model: bytes, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row."""
    rows = written(encoded(docs, a_json, a_pattern, b_model).withColumn("at", F.monotonically_increasing_id()))
    counts = written(pair_counts(rows))
    sums = link_sums(rows, counts, hot_pairs).groupBy("at").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    digest = rows.select("at", "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "groups_sha256")
    done = kept(digest.join(sums, "at").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))
    discard(rows)
    discard(counts)
    return done


def overlaps(docs: DataFrame, a_json: str, a_pattern: str, b_model: bytes) -> DataFrame:
    """doc_id, a_token, b_token (numbers in the text), a_id, b_id, group of each overlap: the whole alignment of each row."""
    shared = docs.sparkSession.sparkContext.broadcast((a_json, a_pattern, b_model))
    names = ["doc_id", "a_token", "b_token", "a_id", "b_id", "group"]

    def run(batches):
        tokens = Tokens(*shared.value)
        for batch in batches:
            for part, texts in slices(batch, "text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                    if not text:
                        continue
                    raw = b" " + text
                    a_ids = tokens.a.encode_to_numpy(raw.decode(), disallowed_special=()).astype(np.int64)
                    b_ids = np.array(tokens.encode_b([text.decode()])[0], np.int64)
                    if any(b"".join(table[i] for i in ids) != raw for table, ids in ((tokens.a_bytes, a_ids), (tokens.b_bytes, b_ids))):
                        continue
                    a, b, a_last, _ = aligned(tokens.a_sizes[a_ids], tokens.b_sizes[b_ids])
                    columns = [np.full(len(a), doc_id, object).tolist(), a, b, a_ids[a], b_ids[b], np.searchsorted(a_last, a)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return doc_texts(docs).mapInArrow(run, "doc_id long, a_token long, b_token long, a_id long, b_id long, group long")
