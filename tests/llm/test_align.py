"""Alignment against sets of byte offsets, with whole texts given to both libraries."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillon.llm import align
from tests.llm.fixtures import empty_docs, odd_docs, odd_rows

A_JSON = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
B_MODEL = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
MORE = [(30, "  two  spaces  "), (31, "▁ is no space"), (32, " <s> </s> <unk> <|endoftext|>"), (33, "a\u0000b c\n\n d"), (34, "日本 語の　文 🎉🎉 ﬁ é"), (35, " "), (None, "one two"), (1, "one two"), (36, "ab " * 40_000), (37, "y" * 3000 + " z")]


def plain(rows):
    a, b = Tokenizer.from_str(A_JSON), sentencepiece.SentencePieceProcessor(model_proto=B_MODEL)
    a.encode_special_tokens = True
    visible = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x]
    byte_of = {chr(x): x for x in visible} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in visible)}
    found, counts = [], Counter()
    for i, text in rows:
        ids = spans = None
        if text:
            ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            spans = [bytes(byte_of[c] for c in a.id_to_token(x)) for x in ids[0]], [bytes([x - 3]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ids[1]]
        if not text or any(b"".join(s) != (" " + text).encode() for s in spans):
            found.append((i, None))
            continue
        ends = []
        for side in spans:
            at, own = 0, {}
            for k, piece in enumerate(side):
                at += len(piece)
                own[at] = k
            ends.append(own)
        groups, links, done = [], [], (0, 0)
        for cut in sorted(ends[0].keys() & ends[1].keys()):
            last = ends[0][cut] + 1, ends[1][cut] + 1
            groups.append("|".join(",".join(map(str, ids[k][done[k] : last[k]])) for k in (0, 1)))
            links.append((ids[0][last[0] - 1], ids[1][last[1] - 1]))
            done = last
        counts.update(links)
        found.append((i, (len(ids[0]), len(ids[1]), groups, links)))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for i, f in found:
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = f
            out.append((i, n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot_pairs", [500_000, 1, 40])
def test_odd_texts_against_offsets(spark, hot_pairs):
    docs = odd_docs(spark, MORE)
    got = align.align_documents(docs.repartition(5), A_JSON, public_tokenizers.PATTERN, B_MODEL, hot_pairs)
    assert sorted(map(tuple, got.collect()), key=repr) == plain([*odd_rows(), *MORE])
    assert align.align_documents(empty_docs(spark), A_JSON, public_tokenizers.PATTERN, B_MODEL, hot_pairs).count() == 0


def test_real_texts_against_offsets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = align.align_documents(docs, A_JSON, public_tokenizers.PATTERN, B_MODEL, 2_000)
    assert sorted(map(tuple, got.collect()), key=repr) == plain([(r.doc_id, r.text) for r in docs.collect()])


def test_words_and_whole_texts_give_the_same_ids():
    """Random mixtures of spaces, letters and signs: encoding by words changes nothing."""
    rng = random.Random(3)
    tokens, whole = align.Tokens(A_JSON, public_tokenizers.PATTERN, B_MODEL), sentencepiece.SentencePieceProcessor(model_proto=B_MODEL)
    texts = ["".join(rng.choice("  ab the▁é\n\tñ日.,<s>0") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    assert tokens.by_word
    assert tokens.encode_b(texts) == whole.encode(texts) == tokens.encode_b(texts)


def test_overlaps(spark):
    """Every overlap of the bytes of two tokens, once, in groups of equal bytes."""
    rows = [*odd_rows(), *MORE]
    tokens = align.Tokens(A_JSON, public_tokenizers.PATTERN, B_MODEL)
    got: dict = {}
    for r in align.overlaps(odd_docs(spark, MORE).where("doc_id not in (1, 11, 12, 36)"), A_JSON, public_tokenizers.PATTERN, B_MODEL).collect():
        got.setdefault(r.doc_id, set()).add((r.a_token, r.b_token, r.a_id, r.b_id, r.group))
    for i, text in rows:
        if i in (None, 1, 11, 12, 36) or not text:
            continue
        a_ids, b_ids = tokens.a.encode_ordinary(" " + text), tokens.encode_b([text])[0]
        a, b = ([k for k, x in enumerate(ids) for _ in table[x]] for ids, table in ((a_ids, tokens.a_bytes), (b_ids, tokens.b_bytes)))
        if b"".join(tokens.b_bytes[x] for x in b_ids) != (" " + text).encode():
            assert i not in got
            continue
        want, group = set(), 0
        for k in range(len(a)):
            if k and a[k] != a[k - 1] and b[k] != b[k - 1]:
                group += 1
            want.add((a[k], b[k], a_ids[a[k]], b_ids[b[k]], group))
        assert got[i] == want
