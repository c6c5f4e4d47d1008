"""Scoring by the language model: lanes of like length, symbols as bytes."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import lm


def test_no_lane_stands_idle(monkeypatch):
    rng, sizes, outputs = np.random.default_rng(5), [], lm.Outputs.__call__
    monkeypatch.setattr(lm, "SCORE_BATCH", 4)
    monkeypatch.setattr(lm, "HELD", 2)
    monkeypatch.setattr(lm.Outputs, "__call__", lambda self, hs, *rest: sizes.append(len(hs)) or outputs(self, hs, *rest))
    m = lm.Gru.fresh(rng.random(lm.START) * 9)
    docs = [rng.integers(0, lm.START, n).astype(lm.SYMBOL) for n in [10] * 30 + [100, 0]]
    found = lm.Scorer(m).score(docs)
    assert sizes == [128, 128, 128, 16]  # 400 symbols in 4 lanes of 100
    assert found[31] == 0 and found[:31] == pytest.approx([lm.Scorer(m).score([d])[0] for d in docs[:31]], rel=1e-4)
    assert len(lm.Scorer(m).score([])) == 0 and lm.Scorer(m).score([docs[31]]).tolist() == [0]


def test_tails_of_many_words_at_once():
    words = [b"a", b"\xff\xfe", b"word", b"\n", b"zz", b"\xff"]
    assert lm.tails(words).tolist() == [lm.tail(w) for w in words] and len(lm.tails([])) == 0
    known = lm.Vocabulary({b"word": 0}, np.zeros(2), np.array([0, lm.HEAD], np.int32), 0, 0, np.zeros(lm.TAILS))
    place, symbol = known.symbols(words)
    assert place.tolist() == [-1, -1, 0, -1, -1, -1] and symbol.tolist() == [0 if w == b"word" else lm.HEAD + lm.tail(w) for w in words]


@pytest.mark.parametrize("kind", [np.float32, np.float64])
def test_sums_of_runs(kind):
    x, first = np.random.default_rng(3).standard_normal((50, 6)).astype(kind), np.array([0, 1, 20, 49])
    assert lm.run_sums(x, first).dtype == kind and lm.run_sums(x, first) == pytest.approx(np.stack([part.sum(0) for part in np.split(x, first[1:])]), abs=1e-5)


def test_a_step_works_on_one_vector():
    """The same as a step for each array, and the model's arrays are parts of the vector."""
    rng = np.random.default_rng(4)
    m = lm.Gru.fresh(rng.random(lm.START) * 9)
    before, grads = m.flat(), [rng.standard_normal(a.shape).astype(np.float32) for a in m.arrays()]
    adam = lm.Adam(m, 0.01)
    adam.step(grads, 0.5)
    assert all(np.shares_memory(a, adam.flat) for a in m.arrays()) and (m.flat() == adam.flat).all()
    want = np.clip(0.5 * np.concatenate([g.ravel() for g in grads]).astype(float), -1, 1)
    want = 0.01 * want / (np.abs(want) + 1e-5)  # the first step: moments without their decay
    bounded = np.abs(m.to_word) < lm.MOST_WEIGHT
    assert bounded.all() and before - m.flat() == pytest.approx(want, abs=1e-5)


def test_full_windows_are_laid_out_at_once():
    docs = [np.append(lm.START, np.arange(n)).astype(np.int32) for n in (70, 64, 64, 9)]
    blocks = [(block.tolist(), live.tolist()) for block, live in lm.lanes(docs, 2)]
    assert blocks[0] == (np.stack([docs[0][: lm.WINDOW + 1], docs[1][: lm.WINDOW + 1]], 1).tolist(), [0, 1])
    assert blocks[0][0][-1] == blocks[1][0][0] and sum(sum(x >= 0 for row in b[1:] for x in row) for b, _ in blocks) == sum(map(len, docs)) - 2


def test_words_stay_in_arrow():
    """Those of a plain split, with their numbers, also at white space at the ends, in null texts and in bytes that are no UTF-8."""
    raw = [b" a  B b\t", b"", None, b" \r\n ", b"x\x0bY\x0c\r\nz \x1c\xc2\x85\xe2\x80\x83q", "ÀB É".encode(), b"\xff\xfe A\xc3 b", b"w " * 500]
    column = pa.array(raw, pa.binary())
    words, sizes = lm.words_of(pa.Array.from_buffers(pa.string(), len(raw), column.buffers(), column.null_count))
    plain = [(text or b"").lower().split() for text in raw]
    assert words.cast(pa.binary()).to_pylist() == [w for p in plain for w in p] and sizes.tolist() == [*map(len, plain)]
    none, sizes = lm.words_of(pa.array([None, ""], pa.string()))
    assert len(none) == 0 and sizes.tolist() == [0, 0]


@pytest.mark.parametrize("end", [True, False])
def test_rare_words_of_each_text(end):
    texts = [[b"a", b"b", b"a", b"k"], [], [b"k"], [b"b", b"a", b"b", b"b"]]
    words = [w for t in texts for w in t]
    found, times = lm.rare_words(pa.array(words, pa.binary()), np.array([*map(len, texts)]), np.array([w != b"k" for w in words]), end)
    want = [Counter([w for w in t if w != b"k"] + [lm.END] * end) for t in texts]
    assert [dict(zip(*x)) for x in zip(found.to_pylist(), times.to_pylist())] == want
    none, times = lm.rare_words(pa.array([], pa.binary()), np.zeros(2, np.int64), np.zeros(0, bool), False)
    assert none.to_pylist() == times.to_pylist() == [[], []]


def test_words_are_counted_over_groups(spark, monkeypatch):
    """Whatever the size of the groups, each word and each end is counted."""
    docs = spark.createDataFrame([(i, None if i % 5 == 0 else f" w{i % 7} W{i % 3}\n") for i in range(100)], "doc_id long, text string").repartition(2)
    want = Counter(w for i in range(100) for w in ([] if i % 5 == 0 else [f"w{i % 7}", f"w{i % 3}"]) + ["\n"])
    for most in (1, 64 << 20):
        monkeypatch.setattr(lm, "COUNT_BYTES", most)
        assert {bytes(r.token).decode(): r.c for r in lm.token_counts(docs).collect()} == want


def test_weights_are_copied_by_gate():
    m = lm.Gru.fresh(np.ones(lm.START))
    m.bias += 1
    before = m.flat()
    table = lm.input_table(m)
    assert (m.flat() == before).all()
    plain = (m.embed @ m.inward + m.bias).reshape(-1, 3, lm.HIDDEN) * np.array([-1, -1, -2])[:, None]
    assert table == pytest.approx(plain.swapaxes(0, 1), abs=1e-5)


def test_windows_reuse_memory():
    """After a task's first windows, arrays of later ones take no new pages from the system."""
    code = """
import resource, numpy as np
from quillon.llm import lm
lm.keep_memory()
m, ids = lm.Gru.fresh(np.ones(lm.START)), np.random.default_rng(0).integers(0, lm.START, (lm.WINDOW, lm.BATCH))
faults = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_minflt
for k in range(25):
    if k == 5:
        before = faults()
    lm.gradients(m, ids, ids)
print((faults() - before) // 20)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).parents[2], timeout=120, check=True)
    assert int(out.stdout) < 100  # 1360 measured where each window's memory goes back
