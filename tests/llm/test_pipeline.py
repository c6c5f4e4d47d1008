"""The corpus pipeline: each stage, and all of them, against plain versions on a table with every odd case."""

import zlib

import numpy as np
import public_tokenizers as P
import pytest

import corpus_pipeline
from tests.llm import brute
from tests.llm.fixtures import empty_docs, odd_docs, odd_rows
from tests.llm.test_edges import plain_verdict


def tables(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def long_rows():
    """Documents that pass the rules, with near copies, shared lines and a shared passage."""
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 9))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(vocabulary, n))
    line, passage, base = prose(12), prose(55), prose(150)
    texts = [base, base, base + " more", prose(90) + "\n" + line, line + "x\n" + prose(90), prose(60) + " " + passage + " " + prose(40), prose(50) + " " + passage, prose(3000)]
    return [(100 + i, t) for i, t in enumerate(texts)]


def plain_stages(rows):
    """What each stage leaves of rows with distinct ids."""
    kept = [(i, t) for i, t in rows if plain_verdict(t)]
    lines = brute.line_verdicts(kept)
    yield kept
    kept = [(i, lines[i][3]) for i, _ in kept]
    yield kept
    groups = brute.near_sets(dict(kept), 5, 80)
    kept = [(i, t) for i, t in kept if groups[i][1] == i]
    yield kept
    ws, flags = brute.covered([t for _, t in kept], 35)
    yield [(i, [x for x, gone in zip(w, f) if not gone]) for (i, _), w, f in zip(kept, ws, flags)]


def test_stages(spark):
    rows = [*odd_rows(), *long_rows()]
    docs, want = odd_docs(spark, long_rows()), list(plain_stages(rows))
    names = docs.columns
    for (name, stage), left in zip(corpus_pipeline.STAGES[:-1], want):
        docs = stage(spark, docs, "")
        assert docs.columns == names
        got = tables(docs)
        if name == "substring dedup":
            assert [(i, brute.words(t)) for i, t in got] == sorted(left, key=repr)
        else:
            assert got == sorted(left, key=repr), name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    found = {}
    for r in sorted(pieces, key=lambda r: r.start):
        found.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    for i, text in tables(docs):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert found.pop(i) == [(s, len(ids[s : s + 1024]), zlib.crc32(ids[s : s + 1024].tobytes())) for s in range(0, len(ids), 1024)]
    assert not found


def test_run(spark, tmp_path):
    rows = [*odd_rows(), *long_rows()]
    odd_docs(spark, long_rows()).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert found == {i for i, _ in list(plain_stages(rows))[-1]}


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_empty_and_blank_tables(spark, stage):
    assert stage(spark, empty_docs(spark), "").count() == 0
    blank = empty_docs(spark).unionByName(spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id long, text string"), allowMissingColumns=True)
    stage(spark, blank, "").collect()


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]])
def test_columns_of_every_name_stay(spark, stage):
    """Columns named as the operators name theirs come back as they were."""
    names = ["_h", "row", "d", "h", "new", "key", "rep", "gone", "exact", "near", "at", "spans", "digest", "first", "a.b"]
    rows = [*long_rows(), (200, long_rows()[0][1] + " again"), (None, long_rows()[3][1])]
    docs = spark.createDataFrame([(i, t, *(f"{c}{i}" for c in names)) for i, t in rows], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    out = stage(spark, docs, "")
    assert out.columns == docs.columns
    found = out.collect()
    assert len(found) >= 4
    for r in found:
        assert tuple(r)[2:] == tuple(f"{c}{r.doc_id}" for c in names)
