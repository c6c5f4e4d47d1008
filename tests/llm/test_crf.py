"""The line field: chains against all labellings, gradients against differences, verdicts against labels held out."""

import itertools
import zlib

import numpy as np
import pytest

from quillon.llm import crf
from tests.llm.fixtures import empty_docs, odd_docs, odd_rows

FOLDER = "/root/testdata/sf0.01"


def test_chains_against_all_labellings():
    rng = np.random.default_rng(1)
    doc = np.repeat([0, 1, 2, 5], [1, 4, 7, 2])
    good, step = rng.normal(size=len(doc)) * 3, rng.normal(size=(2, 2)) * 2
    first, last = crf.ends(doc)
    single, pair, total = crf.forward_backward(good, step, first, last)
    at = 0
    for n in np.unique(doc, return_counts=True)[1]:
        weights = {y: np.exp(sum(good[at + t] * y[t] for t in range(n)) + sum(step[y[t - 1], y[t]] for t in range(1, n))) for y in itertools.product((0, 1), repeat=int(n))}
        z = sum(weights.values())
        assert total[at] == pytest.approx(np.log(z))
        for t in range(n):
            assert np.exp(single[at + t, 1]) == pytest.approx(sum(w for y, w in weights.items() if y[t]) / z)
            for i, j in itertools.product((0, 1), repeat=2):
                if t:
                    assert np.exp(pair[at + t, i, j]) == pytest.approx(sum(w for y, w in weights.items() if (y[t - 1], y[t]) == (i, j)) / z)
        at += n


def test_gradient_against_differences():
    rng = np.random.default_rng(2)
    x, doc, _ = crf.line_features([t.encode() for _, t in odd_rows() if t])
    label = rng.integers(0, 2, doc.max() + 1)[doc]
    w = rng.normal(size=crf.WEIGHTS + 4) * 0.1
    got = crf.loss_and_gradient(w, x, doc, label)
    for k in (0, 5, crf.WIDTH + 3, 2 * crf.WIDTH + 1, crf.WEIGHTS - 1, *range(crf.WEIGHTS, crf.WEIGHTS + 4)):
        e = np.zeros_like(w)
        e[k] = 1e-5
        assert got[1 + k] == pytest.approx((crf.loss_and_gradient(w + e, x, doc, label)[0] - crf.loss_and_gradient(w - e, x, doc, label)[0]) / 2e-5, abs=1e-5)


def test_a_long_chain_is_finite():
    n = 200_001
    good = np.tile([40.0, -40.0, 3.0], n // 3)
    first, last = crf.ends(np.zeros(n, int))
    single, _, total = crf.forward_backward(good, np.array([[3.0, -3.0], [-3.0, 3.0]]), first, last)
    assert np.isfinite(single).all() and np.isfinite(total).all()
    assert np.exp(single).sum(1) == pytest.approx(np.ones(n))


def plain_features(text):
    """Some features of each line, by plain loops."""
    words = [[w for w in line.translate(str.maketrans("\t\v\f\r", "    ")).split(" ") if w] for line in text.split("\n")]
    seen, out = set(), []
    flat = [w for line in words for w in line]
    windows = [tuple(flat[i : i + 3]) for i in range(len(flat) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    at = 0
    for line in words:
        if line:
            chars = sum(map(len, line))
            out.append((chars, len(line), len(set(line)) / len(line), float(tuple(line) in seen), sum(at + k in covered for k in range(len(line))) / len(line), sum(w.count("|") for w in line) / chars))
            seen.add(tuple(line))
            at += len(line)
    return out


def test_features_against_plain_loops():
    texts = [t for i, t in odd_rows() if i not in (11, 12)] + ["a | b\n\n a | b \nc\rd|", "same line here now\nother\nsame  line here now"]
    x, doc, chars = crf.line_features([t if t is None else t.encode() for t in texts])
    want = [(d, *f) for d, t in enumerate(texts) for f in plain_features(t or "")]
    assert x.shape == (len(want), crf.WIDTH)
    distinct, again, covered, bar = crf.WIDTH - 7, crf.WIDTH - 4, crf.WIDTH - 3, 17
    got = [(d, c, round(float(np.expm1(r[2] * 6))), r[distinct], r[again], r[covered], r[bar]) for d, c, r in zip(doc, chars, x)]
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=1e-4)


def test_held_out_documents(spark):
    """Of documents not learned from, nearly all get the verdict of their label."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    held = {r.doc_id for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    marks = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = crf.learn(docs.where(~docs.doc_id.isin(*held)), marks)
    label = {r.doc_id: r.quality for r in marks.collect() if r.doc_id in held}
    found = {r.doc_id: r for r in crf.score_documents(docs, model).collect()}
    assert len(found) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found.values())
    right = sum(found[i].predicted == y for i, y in label.items()) / len(label)
    assert right > 0.97
    bad, good = ([found[i].score for i, y in label.items() if y == k] for k in (0, 1))
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) > 0.99
    # the same rows in other partitions, with columns of other operators' names
    again = crf.learn(docs.where(~docs.doc_id.isin(*held)).repartition(3), marks.withColumn("text", marks.quality).withColumn("x", marks.toxic))
    assert again.weights == pytest.approx(model.weights, abs=1e-9) and again.empty == model.empty
    lines = crf.label_lines(docs, model).collect()
    texts = {r.doc_id: r.text.split("\n") for r in docs.collect()}
    assert len(lines) == sum(bool(x.strip()) for t in texts.values() for x in t)
    assert all(texts[r.doc_id][r.line].strip() and r.good == (r.p_good >= 0.5) for r in lines)


def test_odd_rows_and_labels(spark):
    docs = odd_docs(spark, [(None, "a text"), (1, "another text")])
    marks = spark.createDataFrame([(i, i % 2, "x") for i in range(1, 19)] + [(2, 1, "x"), (3, None, "x"), (9, 7, "x"), (None, 1, "x"), (4, 0, "x")], "doc_id long, quality int, h string")
    model = crf.learn(docs, marks)
    found = sorted(map(tuple, crf.score_documents(docs, model).collect()), key=repr)
    assert len(found) == docs.count()
    empty = {s for i, s, _ in found if i in (4, 5, 6)}
    assert empty == {model.empty} and 0 < model.empty < 1
    assert crf.score_documents(empty_docs(spark), model).count() == 0
    none = spark.createDataFrame([], marks.schema)
    assert {r.score for r in crf.score_documents(docs, crf.learn(docs, none)).collect()} == {0.5}
    one = crf.learn(docs, marks.where("quality = 1"))
    assert all(r.score > 0.8 for r in crf.score_documents(docs, one).collect())
    assert crf.learn(empty_docs(spark), marks).empty == 0.5
