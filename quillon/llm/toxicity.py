"""Toxicity: a weighted finite-state pattern grammar over clauses.

The lexicon is learned: stems (beginnings of words) that labelled toxic texts hold far more
often than the other labelled texts, with their log-odds as weights; those that mostly stand right before a
target are threats, beside a fixed list of verbs in their inflections.  Words then become
symbols (offence, threat, target, negation, report, other), transducers for negation, reported speech, insult and
threat are composed into one machine, and each clause of a text
runs through it.  Negation and report act on offences and threats alike; a denied or told threat is none, and a
threat counts only with a target at most two words behind it.  The machine's output is the clause's class; a class has a
weight of its own, again learned from the labelled texts, so a denied or reported offence counts as
much as the labels say.

Null and empty texts have no clause and score the prior.  Repeated rows score alike, and
extra columns, languages, sources and ids never reach a score.  Without any labelled toxic
text the lexicon is empty and every text scores the prior.  Labels other than 0 and 1 are no labels.  Whole texts are
read, however long.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import doc_texts, slices

OTHER, OFFENCE, TARGET, NEGATION, REPORT, THREAT = SYMBOLS = range(6)
#: What machines write for an offence: denied, reported, both; and for a threat that is denied, or told.
DENIED, TOLD, DENIED_TOLD, DENIED_THREAT, TOLD_THREAT = 6, 7, 8, 9, 10
# Second and third persons as targets, negations, verbs of reporting and of threats.
TARGET_WORDS = "you your youre he she they them her him his du dich dir dein deine ihr euch sie er tu toi ton ta vous votre il elle ils usted tú te ti tus ellos ella".split()
NEGATION_WORDS = "not no never isnt arent nor kein keine keinen nicht nie ne pas jamais ni nunca jamás".split()
REPORT_WORDS = "said says say called calls call wrote sagte sagt nannte schrieb dit disait appelle dijo dice llamó escribió".split()
THREAT_STEMS = "kill hurt burn destroy shoot stab murder threat strangl töt umbring verletz erschieß tuer brûler matar quemar".split()
THREAT_ENDINGS = ["", *"s es e d ed ing en ens ened ening bed bing te tet est et ai as a ez ons ont é ás á emos án".split()]

TARGETS = set(TARGET_WORDS)
WORD = re.compile(r"\w+")
CLAUSE = re.compile(r"[.!?;:\n]+")


@dataclass(frozen=True)
class Transducer:
    """A deterministic transducer.  arcs: (state, symbol) to (state, symbol written); where there is none the state stays and
    the symbol is written as it is.  final: what a clause gives that ends in a state (a tuple)."""

    arcs: dict
    final: dict = field(default_factory=dict)
    start: object = 0

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol))


def compose(first: Transducer, second: Transducer, symbols: Iterable[int] = SYMBOLS) -> Transducer:
    """One machine that does what ``second`` does with what ``first`` writes; final tuples are joined."""
    start = (first.start, second.start)
    arcs, todo, seen = {}, [start], {start}
    while todo:
        a, b = state = todo.pop()
        for symbol in symbols:
            after_a, between = first.step(a, symbol)
            after_b, written = second.step(b, between)
            arcs[state, symbol] = (after_a, after_b), written
            if (after_a, after_b) not in seen:
                seen.add((after_a, after_b))
                todo.append((after_a, after_b))
    return Transducer(arcs, {(a, b): first.final.get(a, ()) + second.final.get(b, ()) for a, b in seen}, start)


def negation() -> Transducer:
    """The first offence or threat is denied if a negation stands before it."""
    marks = {OFFENCE: DENIED, THREAT: DENIED_THREAT}
    plain = {(0, x): ("end", x) for x in marks}
    return Transducer({(0, NEGATION): ("n", NEGATION)} | plain | {("n", x): ("end", y) for x, y in marks.items()})


def report() -> Transducer:
    """The first offence or threat, denied or not, is reported if a verb of reporting stands before it."""
    marks = {OFFENCE: TOLD, DENIED: DENIED_TOLD, THREAT: TOLD_THREAT, DENIED_THREAT: TOLD_THREAT}
    plain = {(0, x): ("end", x) for x in marks}
    return Transducer({(0, REPORT): ("r", REPORT)} | plain | {("r", x): ("end", y) for x, y in marks.items()})


def insult() -> Transducer:
    """final: offences (0, 1, 2: more), a target beside one, the first one denied, reported."""
    states = [(n, t, d, r) for n in range(3) for t in range(2) for d in range(2) for r in range(2)]
    marks = {OFFENCE: (0, 0), DENIED: (1, 0), TOLD: (0, 1), DENIED_TOLD: (1, 1)}
    arcs = {}
    for n, t, d, r in states:
        arcs[(n, t, d, r), TARGET] = (n, 1, d, r), TARGET
        for symbol, (denied, told) in marks.items():
            arcs[(n, t, d, r), symbol] = (min(n + 1, 2), t, d | denied, r | told), symbol
    return Transducer(arcs, {(n, t, d, r): (n, int(n > 0 and t), d, r) for n, t, d, r in states}, (0, 0, 0, 0))


#: Words that may stand between a threat and its target.
BETWEEN = 2


def threat() -> Transducer:
    """final: a threat that is neither denied nor told, with a target at most BETWEEN words behind it."""
    every = (OTHER, OFFENCE, NEGATION, REPORT, DENIED, TOLD, DENIED_TOLD, DENIED_THREAT, TOLD_THREAT)
    arcs = {(0, THREAT): (1, THREAT)}
    for k in range(1, BETWEEN + 2):
        arcs |= {(k, THREAT): (1, THREAT), (k, TARGET): ("threat", TARGET)}
        arcs |= {(k, x): ((k + 1) % (BETWEEN + 2), x) for x in every}
    return Transducer(arcs, {k: (0,) for k in range(BETWEEN + 2)} | {"threat": (1,)})


def grammar() -> Transducer:
    """final: offences, target, denied, reported, threat."""
    return compose(compose(compose(negation(), report()), insult()), threat())


@dataclass
class Model:
    prior: float = 0.0
    stems: dict[str, float] = field(default_factory=dict)
    classes: dict[tuple, float] = field(default_factory=dict)
    threats: set[str] = field(default_factory=set)  # stems that threaten
    shortest: int = 4
    longest: int = 10
    threat: float = 4.0  # of a clause with a threat: the labels' odds, this where no labelled text has one


class Scorer:
    """Runs the grammar; one for each task."""

    def __init__(self, model: Model) -> None:
        self.model, self.machine = model, grammar()
        self.fixed = {w: s for s, ws in ((TARGET, TARGET_WORDS), (NEGATION, NEGATION_WORDS), (REPORT, REPORT_WORDS), (THREAT, (s + e for s in THREAT_STEMS for e in THREAT_ENDINGS))) for w in ws}
        self.hostile = {w for w, s in self.fixed.items() if s == THREAT}
        self.clean: set[bytes] = set()

    def stem(self, word: str) -> str | None:
        """The longest stem that the word begins with."""
        stems = self.model.stems
        for n in range(min(len(word), self.model.longest), self.model.shortest - 1, -1):
            if word[:n] in stems:
                return word[:n]
        return None

    def symbol(self, word: str) -> tuple[int, float]:
        """A word's symbol, and what its stem weighs (threats weigh as clauses)."""
        stem = self.stem(word)
        if stem is None:
            return self.fixed.get(word, OTHER), 0.0
        return (THREAT, 0.0) if stem in self.model.threats else (OFFENCE, self.model.stems[stem])

    def hot(self, words: list[bytes]) -> bool:
        """May the text have an offence or a threat?  Verdicts on words are kept, in a store of bounded size."""
        if len(self.clean) > 400_000:
            self.clean.clear()
        for w in set(words).difference(self.clean):
            if len(w) > 256 or any(x in self.hostile or self.stem(x) for x in WORD.findall(w.decode().lower())):
                return True
            self.clean.add(w)
        return False

    def clauses(self, text: str) -> Iterator[tuple[tuple, float]]:
        """Class, and sum of stem weights, of each clause with an offence or a threat."""
        step = self.machine.arcs
        for clause in CLAUSE.split(text.lower()):
            state, total = self.machine.start, 0.0
            for word in WORD.findall(clause):
                symbol, weight = self.symbol(word)
                total += weight
                state = step[state, symbol][0]
            kind = self.machine.final[state]
            if total or kind[-1]:
                yield kind, total

    def clause_weight(self, kind: tuple, total: float) -> float:
        """The class bounds what the stems say; a threat without an offence has its class's weight."""
        if not total:
            return self.model.classes.get(kind, self.model.threat)
        return min(total, self.model.classes.get(kind, total))

    def score(self, text: bytes | None) -> float:
        x = self.model.prior
        if text and self.hot(text.split()):
            found = [self.clause_weight(*c) for c in self.clauses(text.decode())]
            if found:
                x += max(found) + 0.25 * (sum(found) - max(found))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _log_odds(toxic: float, clean: float, n_toxic: int, n_clean: int) -> float:
    return math.log((toxic + 0.5) / (n_toxic + 1) / ((clean + 0.5) / (n_clean + 1)))


def learn(docs: DataFrame, labels: DataFrame, least_texts: int = 3, least_odds: float = 2.5, sample_rows: int = 20_000) -> Model:
    """From the labelled rows given, or about ``sample_rows`` of them, taken by a hash of doc_id.  ``docs``: doc_id, text; ``labels``: doc_id, toxic; a
    document with several label rows counts as toxic if one of them says so.

    Beginnings of words are counted on the executors, once for each text that has them; those with
    too few toxic texts or too low odds are left out there, and the others, no more than the sample's words allow, come to
    the driver."""
    model = Model()
    marks = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, sample_rows / max(1, marks.count()))
    rows = doc_texts(docs).join(F.broadcast(marks.where((F.xxhash64("doc_id") / 2.0**64 + 0.5) < share)), "doc_id")  # the sample's labels: its bound is theirs
    size = {int(r.toxic): r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = size.get(1, 0), size.get(0, 0)
    model.prior = math.log((n_toxic + 0.5) / (n_clean + 0.5))
    if not n_toxic:
        return model
    shortest, longest = model.shortest, model.longest

    def counts(batches):
        found: dict[str, list[int]] = {}
        for batch in batches:
            for part, texts in slices(batch, "text"):
                for text, toxic in zip(texts, part.column("toxic").to_pylist(), strict=True):
                    words = {w for w in WORD.findall((text or b"").decode().lower()) if len(w) >= shortest}
                    for stem in {w[:n] for w in words for n in range(shortest, min(len(w), longest) + 1)}:
                        found.setdefault(stem, [0, 0])[toxic] += 1
                    if len(found) > 300_000:
                        yield _counted(found)
                        found = {}
        if found:
            yield _counted(found)

    counted = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(counts, "stem string, clean long, toxic long").groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1) / ((F.col("clean") + 0.5) / (n_clean + 1)))
    best = counted.where(F.col("toxic") >= least_texts).withColumn("odds", odds).where(F.col("odds") >= least_odds)
    rest = best.collect()
    found = {r.stem: (r.toxic, r.odds) for r in rest}
    # A longer stem stays only where no beginning of it is in already: the shortest is the most general.
    for stem in sorted(found, key=lambda s: (len(s), s)):
        if not any(stem[:n] in model.stems for n in range(shortest, len(stem))):
            model.stems[stem] = found[stem][1]
    model.threats = _threats(rows, model)
    model.classes = _class_weights(rows, model, n_toxic, n_clean)
    plain = [w for kind, w in model.classes.items() if kind[-1] and not kind[0]]
    model.threat = max(plain) if plain else model.threat
    return model


#: A learned stem threatens if so many of its places, and so many times the usual share, have a target right behind.
THREAT_PLACES, THREAT_SHARE, THREAT_LIFT = 10, 0.5, 3.0


def _threats(rows: DataFrame, model: Model) -> set[str]:
    """Learned stems that mostly stand before a target in toxic texts."""

    def places(batches):
        scorer, found = Scorer(model), {}
        for batch in batches:
            for _, texts in slices(batch, "text"):
                for text in texts:
                    for clause in CLAUSE.split((text or b"").decode().lower()):
                        words = WORD.findall(clause)
                        aims = [w in TARGETS for w in words]
                        for k, word in enumerate(words):
                            both = found.setdefault(scorer.stem(word) or "", [0, 0])
                            both[0] += 1
                            both[1] += any(aims[k + 1 : k + 2 + BETWEEN])
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([x[0] for x in found.values()]), pa.array([x[1] for x in found.values()])], ["stem", "n", "aimed"])

    counted = rows.where("toxic = 1").select("text").mapInArrow(places, "stem string, n long, aimed long").groupBy("stem").agg(F.sum("n").alias("n"), F.sum("aimed").alias("aimed")).collect()  # a row for each stem
    usual = sum(r.aimed for r in counted) / max(1, sum(r.n for r in counted))
    return {r.stem for r in counted if r.stem and r.n >= THREAT_PLACES and r.aimed >= r.n * max(THREAT_SHARE, THREAT_LIFT * usual)}


def _counted(found: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(found, pa.string()), pa.array([x[0] for x in found.values()], pa.int64()), pa.array([x[1] for x in found.values()], pa.int64())],
        ["stem", "clean", "toxic"],
    )


def _class_weights(rows: DataFrame, model: Model, n_toxic: int, n_clean: int) -> dict[tuple, float]:
    """Log-odds of each clause class: of the texts that have it, how many are toxic?"""

    def classes(batches):
        scorer, found = Scorer(model), Counter()
        for batch in batches:
            for part, texts in slices(batch, "text"):
                for text, toxic in zip(texts, part.column("toxic").to_pylist(), strict=True):
                    if text and scorer.hot(text.split()):
                        found.update((kind, toxic) for kind in {k for k, _ in scorer.clauses(text.decode())})
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([list(k) for k, _ in found], pa.list_(pa.int32())), pa.array([t for _, t in found], pa.int32()), pa.array(found.values(), pa.int64())], ["kind", "toxic", "n"])

    seen = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(classes, "kind array<int>, toxic int, n long")
    counts = Counter()
    for r in seen.groupBy("kind", "toxic").agg(F.sum("n").alias("n")).collect():  # a few dozen classes
        counts[tuple(r.kind), r.toxic] = r.n
    return {k: _log_odds(counts[k, 1], counts[k, 0], n_toxic, n_clean) for k, _ in counts}


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted, for each row of ``docs``."""

    def run(batches: Iterable[pa.RecordBatch]):
        scorer = Scorer(model)
        for batch in batches:
            for part, texts in slices(batch, "text"):
                scores = [scorer.score(t) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], ["doc_id", "score", "predicted"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, score double, predicted int")
