"""Toxicity by a weighted finite-state pattern grammar over clauses.

Tokens of a clause are mapped to classes (insult, threat, target, negation, report,
other) and run through the composition of three transducers: negation softens the
insults and threats that follow it closely, reported speech softens those after a
verb of saying, and the scoring transducer pays for what is left, more if the clause
aims at someone.  Scores belong to matched clauses, not to words on their own; a
text's features are sums over its clauses, weighed by a small logistic model.

The insult lexicon (words and word stems with log-odds weights) and the logistic
weights are learned from a bounded sample of labelled rows (``SAMPLE_TOXIC`` and
``SAMPLE_CLEAN``, chosen by a hash of their id); a short fixed list stands in where
labels say nothing.  Only the text enters a score.

Labels that disagree about an id count as toxic, and of equal or nearly equal texts the
sample holds the first in order, so that a lost executor changes nothing.

Defined cases: null, empty and wordless texts get the score of a text without
matches; labels without an id or a value are left out; texts are scored whole; repeated rows are scored each; without labels the
fixed list and weights are used; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, tidy
from .shingles import shingle_sets

#: Most labelled rows used to fit, by class.
SAMPLE_TOXIC, SAMPLE_CLEAN = 4000, 8000
STEM_LENGTHS = (4, 5, 6, 7)
#: Toxic texts that must hold an entry.
LEAST_TEXTS = 5
#: Entries that may be there by chance: of all that are tried, so many would pass.
CHANCE_ENTRIES = 0.5
#: Lower bound of the log-odds of an entry.
LEAST_ODDS = 2.5
MOST_ENTRIES = 2000

# Words of the grammar's classes.
INSULTS = "idiot idiots moron morons imbecile scumbag bastard asshole bitch retard dumbass loser losers scum trash stupid pathetic worthless disgusting".split()
THREATS = "kill hurt destroy beat stab shoot burn strangle töten umbringen schlagen tuer frapper matar golpear".split()
TARGETS = frozenset("you your yourself u he she they him her them du dich dir ihr euch tu toi vous tú te usted ustedes vosotros".split())
NEGATIONS = frozenset("not no never n't don't isn't aren't wasn't nicht kein keine nie pas jamais nunca tampoco".split())
REPORTS = frozenset("said says wrote writes called quoted claimed allegedly sagte schrieb nannte dit écrit dijo escribió llamó".split())

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, SOFT_INSULT, SOFT_THREAT, QUOTED = range(9)

#: Weight of an entry without labels.
PRIOR_WEIGHT = 3.0
#: Logistic weights without labels: bias, plain, aimed, negated, reported, threats.
PRIOR_MODEL = np.array([-2.0, 1.5, 1.5, 0.5, 0.4, 1.5])


@dataclass
class Transducer:
    """A deterministic weighted transducer: arcs[state][symbol] = (next, output, weight)."""

    arcs: dict[int, dict[int, tuple[int, int, float]]] = field(default_factory=lambda: defaultdict(dict))
    start: int = 0

    def add(self, state: int, symbols, to: int, output: int | None = None, weight: float = 0.0) -> None:
        for s in symbols:
            self.arcs[state][s] = (to, s if output is None else output, weight)

    def then(self, other: Transducer) -> Transducer:
        """Composition: what this one puts out, ``other`` reads; weights add."""
        made = Transducer()
        number = {(self.start, other.start): 0}
        todo = [(self.start, other.start)]
        while todo:
            a, b = todo.pop()
            for symbol, (a2, mid, w) in self.arcs[a].items():
                b2, out, v = other.arcs[b][mid]
                if (a2, b2) not in number:
                    number[a2, b2] = len(number)
                    todo.append((a2, b2))
                made.arcs[number[a, b]][symbol] = (number[a2, b2], out, w + v)
        return made

    def run(self, symbols) -> Iterator[tuple[int, int, float]]:
        """(position, output, weight) of each step."""
        state = self.start
        for k, s in enumerate(symbols):
            state, out, weight = self.arcs[state][s]
            yield k, out, weight


def _negation(reach: int = 3) -> Transducer:
    """Insults and threats within ``reach`` tokens after a negation come out softened."""
    t = Transducer()
    for state in range(reach + 1):  # tokens for which the negation still holds
        later = max(0, state - 1)
        t.add(state, (OTHER, TARGET, REPORT), later)
        t.add(state, (NEGATION,), reach)
        t.add(state, (INSULT,), later, SOFT_INSULT if state else INSULT)
        t.add(state, (THREAT,), later, SOFT_THREAT if state else THREAT)
    return t


def _reported() -> Transducer:
    """After a verb of saying, what would be an insult or threat is quoted."""
    t = Transducer()
    for state in (0, 1):
        t.add(state, (OTHER, TARGET, NEGATION), state)
        t.add(state, (REPORT,), 1)
        t.add(state, (INSULT, THREAT, SOFT_INSULT, SOFT_THREAT), state, QUOTED if state else None)
    return t


def _scoring(reach: int = 4) -> Transducer:
    """Pays for insults and threats; more within ``reach`` tokens after a target."""
    t = Transducer()
    for state in range(reach + 1):
        later, aimed = max(0, state - 1), state > 0
        t.add(state, (OTHER, NEGATION, REPORT), later)
        t.add(state, (TARGET,), reach)
        t.add(state, (INSULT,), later, None, 1.5 if aimed else 1.0)
        t.add(state, (THREAT,), reach, None, 1.5 if aimed else 0.25)
        t.add(state, (SOFT_INSULT, SOFT_THREAT), later, None, 0.5)
        t.add(state, (QUOTED,), later, None, 0.5)
    return t


GRAMMAR = _negation().then(_reported()).then(_scoring())

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE_END = re.compile(r"[.!?;:\n]+")


class Matcher:
    """Finds lexicon entries (word -> weight, stem + '*' -> weight) and scores clauses."""

    def __init__(self, lexicon: dict[str, float]):
        self.machine = ahocorasick.Automaton()
        self.empty = True
        for entry, weight in lexicon.items():
            self.machine.add_word(entry.rstrip("*"), (len(entry.rstrip("*")), entry.endswith("*"), INSULT, weight))
            self.empty = False
        for word in THREATS:
            if word not in self.machine:
                self.machine.add_word(word, (len(word), False, THREAT, 1.0))
        self.machine.make_automaton()

    def features(self, text: str | None) -> list[float]:
        """Sums over matched clauses: plain, aimed, negated, reported, threats."""
        found = [0.0] * 5
        if not text:
            return found
        low = text.lower()
        hits: dict[int, tuple[int, float]] = {}
        n = len(low)
        for end, (size, stem, kind, weight) in self.machine.iter(low):
            at = end - size + 1
            if at and low[at - 1].isalpha() or not stem and end + 1 < n and low[end + 1].isalpha():
                continue
            if at not in hits or hits[at][1] < weight:
                hits[at] = (kind, weight)
        if not hits:
            return found
        places = sorted(hits)
        ends = [m.span() for m in _CLAUSE_END.finditer(low)]
        firsts, lasts = [0, *(b for _, b in ends)], [*(a for a, _ in ends), n]
        k = 0
        while k < len(places):
            clause = bisect_right(firsts, places[k]) - 1
            self._clause(low, firsts[clause], lasts[clause], hits, found)
            k = max(k + 1, bisect_right(places, lasts[clause]))
        return found

    def _clause(self, low: str, first: int, last: int, hits: dict[int, tuple[int, float]], found: list[float]) -> None:
        kinds, weights = [], []
        for m in _WORD.finditer(low, first, last):
            kind, weight = hits.get(m.start(), (OTHER, 0.0))
            if kind == OTHER:
                word = m[0]
                kind = TARGET if word in TARGETS else NEGATION if word in NEGATIONS or word.endswith("n't") else REPORT if word in REPORTS else OTHER
            kinds.append(kind)
            weights.append(weight)
        if THREAT in kinds and TARGET not in kinds:  # a threat needs someone it is aimed at
            kinds = [OTHER if k == THREAT else k for k in kinds]
        for at, out, pay in GRAMMAR.run(kinds):
            if pay:
                slot = {INSULT: 1 if pay > 1 else 0, SOFT_INSULT: 2, SOFT_THREAT: 2, QUOTED: 3, THREAT: 4}[out]
                found[slot] += pay * weights[at]


def scaled(features: np.ndarray) -> np.ndarray:
    return np.hstack([np.ones((len(features), 1)), np.log1p(features)])


def probability(model: np.ndarray, features: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(scaled(features) @ model, -30, 30)))


def fit_logistic(features: np.ndarray, toxic: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps, pulled to the prior weights."""
    x, w = scaled(features), PRIOR_MODEL.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (toxic - p) - ridge * (w - PRIOR_MODEL))
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic of the sample; its size is bounded, so its ids are broadcast."""
    usable = labels.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    part = lambda t, n: usable.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = part(1, SAMPLE_TOXIC).unionByName(part(0, SAMPLE_CLEAN))
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic").where("text is not null")


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) -> also the least shingle hash, which copies and most near copies share."""
    for batch in batches:
        least = np.zeros(batch.num_rows, np.uint64)
        for i, found in shingle_sets(batch.column(0)):
            least[i] = found[0] if len(found) else 0
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least.view(np.int64))], names=["text", "toxic", "least"])


def _stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entry, toxic, clean): texts of this task with a word or stem; clean-only entries go as long as they may matter."""
    counts: dict[str, list[int]] = {}
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = set(_WORD.findall(text.lower()))
            for entry in words | {w[:k] + "*" for w in words for k in STEM_LENGTHS if len(w) >= k}:
                counts.setdefault(entry, [0, 0])[1 - toxic] += 1
    # names once, as columns
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], names=["entry", "toxic", "clean"]
    )


def learn(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], np.ndarray]:
    """The lexicon and the logistic weights."""
    prior = dict.fromkeys(INSULTS, PRIOR_WEIGHT)
    # one of a group of copies, so that its chance words do not count as many
    rows = training_rows(docs, labels).mapInArrow(_sketched, "text string, toxic int, least long").groupBy("least", "toxic").agg(F.min("text").alias("text")).select("text", "toxic").persist()
    try:
        sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
        if not sizes.get(1) or not sizes.get(0):
            return prior, PRIOR_MODEL
        t, c = F.col("toxic"), F.col("clean")
        odds = F.log((t + 0.5) / (sizes[1] + 1.0)) - F.log((c + 0.5) / (sizes[0] + 1.0))
        share = sizes[1] / (sizes[0] + sizes[1])  # of the texts that are toxic
        surprise = t * F.log(t / (t + c) / share) + F.when(c > 0, c * F.log(c / (t + c) / (1 - share))).otherwise(0.0)
        tried = rows.mapInArrow(_stems, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        tried = tried.where(t + c >= LEAST_TEXTS).persist()
        # Chernoff bound of the binomial tail, for each of the entries that are tried
        least = math.log(max(1, tried.count()) / CHANCE_ENTRIES)
        entries = (
            tried.where(t >= LEAST_TEXTS)
            .withColumn("surprise", F.round(surprise, 6))
            .where(F.col("surprise") >= least)
            .withColumn("odds", odds)
            .where(F.col("odds") >= LEAST_ODDS)
            .where(t >= 4 * c * sizes[1] / sizes[0])
            .orderBy(F.desc("surprise"), F.desc(F.length("entry")), "entry")
            .limit(MOST_ENTRIES)
            .collect()
        )
        tried.unpersist()
        lexicon: dict[str, float] = {}
        stems: dict[str, str] = {}
        for r in entries:  # the surest first: an entry that a kept one covers adds nothing
            base = r["entry"].rstrip("*")
            if any(base[:k] in stems for k in range(2, len(base) + 1)) or any(kept.startswith(base) for kept in stems):
                continue
            stems[base] = r["entry"]
            lexicon[r["entry"]] = min(6.0, r["odds"])
        lexicon = {**{w: v for w, v in prior.items() if not any(w.startswith(s) for s in stems)}, **lexicon}
        features = rows.mapInArrow(_featured(matcher_of(lexicon)), "toxic int, f array<double>").toArrow()
        x = np.array(features.column(1).to_pylist(), dtype=float).reshape(-1, 5)
        return lexicon, fit_logistic(x, features.column(0).to_numpy().astype(float))
    finally:
        rows.unpersist()


def matcher_of(lexicon: dict[str, float]):
    """A maker of matchers that travels to the executors as plain data."""
    made: list[Matcher] = []

    def get() -> Matcher:
        if not made:
            made.append(Matcher(lexicon))
        return made[0]

    return get


def _featured(matcher):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([m.features(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64()))], names=["toxic", "f"])

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score, predicted of each row of ``docs`` (doc_id, text)."""
    prepare(docs.sparkSession)
    lexicon, model = learn(docs, labels)
    matcher = matcher_of(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher()
        for batch in batches:
            x = np.array([m.features(t) for t in batch.column(1).to_pylist()], dtype=float).reshape(-1, 5)
            p = probability(model, x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def score_held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return score(docs, labels).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score under 0.5, with all their columns."""
    prepare(docs.sparkSession)
    lexicon, model = learn(docs, labels)
    matcher = matcher_of(lexicon)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher()
        for batch in batches:
            x = np.array([m.features(t) for t in batch.column(at).to_pylist()], dtype=float).reshape(-1, 5)
            yield batch.filter(pa.array(probability(model, x) < 0.5))

    return docs.mapInArrow(tidy(run), docs.schema)
