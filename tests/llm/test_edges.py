"""Odd cases of single operators, beside those of test_operators.py."""

import hashlib
import time

import numpy as np
import pytest
import zstandard

from quillon.llm import embed, linededup, minhash, quality, toxicity
from tests.llm import brute
from tests.llm.fixtures import empty_docs, odd_docs, odd_rows


def plain_verdict(text):
    """Whole text and every chunk against the limits of their lengths, without the operator's code."""
    b, raw = quality.Bands(), (text or "").encode()
    if not raw or brute.quality_counts(text)[-1]:
        return False

    def ratio(x):
        return len(zstandard.ZstdCompressor(level=b.level).compress(x)) / len(x)

    def inside(size, r, slack):
        k = sum(end <= size for end in b.below)
        return b.low[k] - slack <= r <= b.high[k] + slack

    bad = total = 0
    if len(raw) > b.chunk:
        for a in range(0, len(raw), b.chunk):
            total += 1
            a = min(a, len(raw) - b.chunk)
            bad += not inside(b.chunk, ratio(raw[a : a + b.chunk]), b.slack)
    return inside(len(raw), ratio(raw), 0) and bad <= b.bad_chunks * total


def test_quality_of_mixed_slices(spark):
    """Slices without chunks, without text and with long texts in one partition: columns keep their types."""
    prose = odd_rows()[11][1]
    rows = [(i, "few words here") for i in range(90_000)] + [(200_000, prose * 3), (200_001, prose[:6000]), (200_002, "ab" * 5000)] + [(300_000 + i, "") for i in range(20)] + [(None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = {r.doc_id: r for r in quality.quality_report(docs).collect()}
    assert len(found) == len(rows)
    for i, t in rows[89_990:]:
        assert found[i].kept == plain_verdict(t), i
    assert found[200_000].worst_low is not None and found[0].worst_low is None and found[300_000].ratio is None


def test_quality_verdicts(spark):
    rows = odd_rows()
    assert {r.doc_id: r.kept for r in quality.quality_report(odd_docs(spark)).collect()} == {i: plain_verdict(t) for i, t in rows}
    stay = quality.quality_filter(odd_docs(spark, [(None, rows[11][1]), (1, rows[0][1])]))
    assert sorted(((r.doc_id, r.text) for r in stay.collect()), key=repr) == sorted(((i, t) for i, t in [*rows, (None, rows[11][1]), (1, rows[0][1])] if plain_verdict(t)), key=repr)
    assert stay.columns == odd_docs(spark).columns
    assert quality.quality_filter(empty_docs(spark)).count() == 0


@pytest.mark.parametrize("edits", [1, 2])
def test_line_dedup_of_templates(spark, monkeypatch, edits):
    """Lines that share all but a few characters: keys stay hot over many rounds."""
    monkeypatch.setattr(linededup, "HOT_LINES", 2)
    rng = np.random.default_rng(edits)
    rows = []
    for i in range(160):
        number = "".join(rng.choice(list("0123"), rng.integers(3, 6)))
        rows.append((i, f"the order with number {number} was shipped today" if i % 3 else f"ends with a number, that is to say {number}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: x[:3] for i, x in brute.line_verdicts(rows, edits=edits).items()}
    assert {r.doc_id: tuple(r)[1:4] for r in linededup.digest(docs, max_edits=edits).collect()} == want
    assert 20 < sum(x[2] for x in want.values())


def test_embeddings_of_repeated_and_missing_ids(spark):
    """Two vectors under one vec_id, and vectors without one, keep the links of their own."""
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [0.01, 1.0]), (None, [1.0, 0.01]), (None, [-1.0, 0.0]), (None, [-1.0, 0.01]), (4, None), (None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted(map(tuple, embed.near_duplicates(df, 0.95).collect()), key=repr)
    want = [(1, 1, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (None, 1, 1, False), (None, 1, None, False), (None, 1, None, False), (4, 0, 4, True), (None, 0, None, False)]
    assert found == sorted(want, key=repr)


def test_near_duplicates_of_repeated_ids(spark):
    """Two texts under one doc_id are judged each, and both stay if they are in different groups."""
    rng = np.random.default_rng(3)
    a, b, c = (" ".join(f"w{x}" for x in rng.integers(0, 10_000, 80)) for _ in range(3))
    rows = [(1, a), (2, a + " more"), (2, b), (3, b), (3, b), (4, c), (4, None), (4, ""), (None, a), (5, a.replace(" ", "  "))]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, digest string")
    found = sorted(map(tuple, minhash.near_duplicates(docs.drop("digest"), 5, 80).select("doc_id", "component_id").collect()), key=repr)
    assert found == sorted([(1, 1), (2, 1), (2, 2), (3, 2), (3, 2), (4, 4), (4, 4), (4, 4), (None, None), (5, 1)], key=repr)
    stay = minhash.keep_one(docs, 5, 80)
    got = sorted(((r.doc_id, r.text) for r in stay.collect()), key=repr)
    assert [x for x in got if x[1]] == sorted([(1, a), (2, b), (4, c), (None, a)], key=repr) and len(got) == 5
    assert stay.columns == docs.columns


def test_toxicity_scores(spark):
    """Scores of real and odd texts against a plain version of the grammar."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    model = toxicity.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    fixed = {w: s for s, ws in ((2, toxicity.TARGET_WORDS), (3, toxicity.NEGATION_WORDS), (4, toxicity.REPORT_WORDS), (5, [x + e for x in toxicity.THREAT_STEMS for e in toxicity.THREAT_ENDINGS])) for w in ws}
    stem = next(iter(model.stems), "")
    extra = [(-1, f"they said you are not {stem}x. I will kill you! {stem}"), (-2, None), (-3, ""), (-4, f"you {stem}, {stem} {stem}"), (None, "quemar te"), (-5, "he did not kill you; kill the process before you leave. she said they kill him")]
    every = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    found = {r.doc_id: r.score for r in toxicity.score_documents(every, model).collect()}
    rows = [(r.doc_id, r.text) for r in every.collect()]
    assert len(found) == len(rows) and model.stems
    for i, t in rows:
        assert found[i] == pytest.approx(brute.toxic_score(t, model, fixed), rel=1e-9), i


def test_threats(spark):
    """Inflected, negated, told and far from a target; and one that only the labels know."""
    scorer = toxicity.Scorer(toxicity.Model(prior=-3.0))
    for text in ("I am killing you", "We will threaten and stab you", "They will shoot him", "not a word, I kill and burn her"):
        assert scorer.score(text.encode()) >= 0.7, text
    for text in ("He did not kill you", "kill the process before you leave", "She said they will kill him", "the threat. you know", "a stable for you"):
        assert scorer.score(text.encode()) < 0.1, text
    rest = "while the rain goes on all day long over the hills and nothing else is heard of a word"
    rows = [(i, f"word {i} we zorgle you {rest}", 1) for i in range(60)] + [(100 + i, f"a blarg day {i} {rest} by you", 1) for i in range(60)] + [(200 + i, f"we see you on day {i} {rest}", 0) for i in range(90)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    assert model.threats and all("zorgle".startswith(x) for x in model.threats) and any("blarg".startswith(x) for x in model.stems)
    learned = toxicity.Scorer(model)
    assert learned.score(b"we zorgle you") > 0.7 > 0.6 > learned.score(b"we never zorgle you")
    assert learned.score(b"they said we zorgle you") == learned.score(b"") == learned.score(b"zorgle the day and then see you")


def test_dense_group_has_few_copies(spark, monkeypatch):
    """A third of all vectors close together: few cells for each, and every link."""
    monkeypatch.setattr(embed, "CELL_ROWS", 20)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 64))
    x[:300] = x[0] + 0.18 * rng.normal(size=(300, 64))
    x[300] = x[1] * 1e200  # of any size
    x[301] = x[2] * 1e-250
    points = embed.unit(x)
    margin = embed.SPREADS * np.sqrt(0.1) / 8 * np.sqrt(2)
    centres = embed.spherical_kmeans(points, 45)
    few = embed.merged(centres, points, margin, 2)
    before, after = (embed.shared_cells(points[:300] @ c.T, margin).sum(1).mean() for c in (centres, few))
    assert after <= 2 < before and 10 < len(few) < len(centres)
    monkeypatch.setattr(embed, "COPIES", 2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {r.vec_id: r.n_links for r in embed.near_duplicates(df, 0.95).collect()}
    want = (points @ points.T >= 0.95).sum(1) - 1
    assert sum(want) > 10_000 and [found[i] for i in range(900)] == want.tolist()


def test_line_dedup_splits_a_text_once(spark):
    """A document of very many lines: time grows with its lines, not with their square."""
    lines = [f"{hashlib.md5(str(i).encode()).hexdigest()} of a long document" for i in range(20_000)]
    docs = spark.createDataFrame([(1, "\n".join([*lines, lines[0], ""])), (2, None), (3, "")], "doc_id long, text string")
    began = time.monotonic()
    found = {r.doc_id: tuple(r)[1:] for r in linededup.digest(docs).collect()}
    assert time.monotonic() - began < 40
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert found == {1: (20_002, 1, 0, digest("\n".join([*lines, ""]))), 2: (0, 0, 0, digest("")), 3: (1, 0, 0, digest(""))}
