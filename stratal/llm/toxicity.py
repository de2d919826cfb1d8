"""Toxicity: a weighted finite-state grammar over clauses, with its insult stems and final weights learned from labels.

Five transducers read a clause word by word, each with states of its own. The insult transducer accepts a clause with
an insulting word and emits that word's weight. The threat transducer accepts an intent followed within ``REACH`` words
by a violent verb, or such a verb followed by a target; a violent verb alone is nothing. The target, negation and
reported-speech transducers emit factors: a target raises what is emitted from there on, a negation lowers that of the
next ``REACH`` words, reported speech that of the rest of the clause. They are composed into one machine before any text is
read, by the usual product of states. Clauses are read whole, from one mark of punctuation to the next, however long.
A document's accepted clauses give features (sums, the two largest, numbers of what was emitted how, and of the different words that did) to a logistic
regression; what stands in no accepted clause counts for nothing but the document's length.

Learning: insult stems are word beginnings of 4 to 8 letters and whole words that stand in far more toxic than other
documents; all that pass the test are taken, with weights of 6 at most. The regression is fitted on the grammar's features.
Both use one sample of about ``sample_rows`` labelled rows, chosen by a hash of doc_id; it is the only bounded thing
here. Scores use the text alone.

Nulls and odd rows: a null or empty text has no clause and gets the score of a document without matches. Rows that
repeat get equal scores. Labels that are null are ignored; without labels of both kinds only the fixed words count,
with fixed weights. Empty tables give empty results; further columns pass through, but for one named toxicity.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of, written
from .lean import lean
from .shingles import CACHE, pieces, words

# Words of the grammar's classes, in the languages of the corpus.
INSULTS = "idiot moron stupid loser trash scum pathetic worthless disgusting clown imbecile dumb fool bastard".split()
VERBS = "kill hurt destroy strangle shoot stab punish beat burn murder".split()
INTENTS = "will gonna going shall must want wanna should let ll i'll we'll you'll werde will vais voy".split()
TARGETS = "you your yours yourself u ur he she they them him her du dich dir ihr euch tu te toi vous usted ustedes".split()
NEGATIONS = "not no never none nobody isnt isn't dont don't doesn't wasn't without nicht kein keine nie ne pas jamais nunca".split()
REPORTS = "said says say wrote writes called calls claimed quoted according sagte sagt dit dijo disent".split()
STOPS = b".!?;:,|"

OTHER, TARGET, NEGATION, REPORT, INTENT, VERB, INSULT = KINDS = range(7)
#: Words that a negation and an intent reach.
REACH = 3
#: What an accepted threat weighs.
THREAT = 3.0
NOTHING, INSULTED, THREATENED = range(3)
FEATURES = ("total", "most", "second", "insults", "threats", "targeted", "negated", "reported", "clauses", "density", "kinds")

#: An arc of a transducer: the next state, what it emits and the factor on what others emit.
Arc = tuple[int, int, float]
Transducer = dict[tuple[int, int], Arc]


def _insult() -> Transducer:
    return {(s, k): (1, INSULTED, 1.0) if k == INSULT else (s, NOTHING, 1.0) for s in range(2) for k in KINDS}


#: States of the threat transducer: nothing, REACH steps of an intent, a violent verb, and an accepted threat.
_VIOLENT, _ACCEPTED = REACH + 1, REACH + 2


def _threat() -> Transducer:
    def arc(s: int, k: int) -> Arc:
        if k == VERB:
            return (_ACCEPTED, THREATENED, 1.0) if 0 < s <= REACH or s == _ACCEPTED else (_VIOLENT, NOTHING, 1.0)
        if s == _VIOLENT:
            return (_ACCEPTED, THREATENED, 1.0) if k == TARGET else (s, NOTHING, 1.0)
        if s == _ACCEPTED:
            return s, NOTHING, 1.0
        return (REACH if k == INTENT else max(0, s - 1)), NOTHING, 1.0

    return {(s, k): arc(s, k) for s in range(REACH + 3) for k in KINDS}


def _target() -> Transducer:
    return {(s, k): (1, NOTHING, 1.5) if s or k == TARGET else (0, NOTHING, 1.0) for s in range(2) for k in KINDS}


def _negation() -> Transducer:
    return {(s, k): (REACH if k == NEGATION else max(0, s - 1), NOTHING, 0.4 if s else 1.0) for s in range(REACH + 1) for k in KINDS}


def _report() -> Transducer:
    return {(s, k): (1 if k == REPORT else s, NOTHING, 0.5 if s else 1.0) for s in range(2) for k in KINDS}


PARTS = (_insult(), _threat(), _target(), _negation(), _report())


def composed(parts: tuple[Transducer, ...]) -> tuple[list[list[tuple[int, int, float]]], list[tuple[int, ...]]]:
    """The product of transducers, as arcs by state and kind of word, and the states of the parts in each state. An arc
    emits what one part emits; its factor is the product of theirs."""
    states = list(product(*[sorted({s for s, _ in p}) for p in parts]))
    number, arcs = {s: i for i, s in enumerate(states)}, []
    for state in states:
        row = []
        for kind in KINDS:
            steps = [p[s, kind] for p, s in zip(parts, state, strict=True)]
            row.append((number[tuple(s for s, _, _ in steps)], max(e for _, e, _ in steps), float(np.prod([f for _, _, f in steps]))))
        arcs.append(row)
    return arcs, states


MACHINE, STATES = composed(PARTS)
_KINDS = {w: k for k, ws in ((INTENT, INTENTS), (VERB, VERBS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws}
_EDGES = ".,;:!?|\"'()[]{}*%&#$-"


class Grammar:
    """Word classes and weights of the composed machine. stems: beginnings of words, or whole words ending in ``$``."""

    def __init__(self, stems: dict[str, float]) -> None:
        self.stems = stems
        self.longest = max(map(len, stems), default=1)
        #: word: its class, weight and whether its clause ends with it
        self.known: dict[bytes, tuple[int, float, bool]] = {}

    def word(self, raw: bytes) -> tuple[int, float, bool]:
        w, stop = raw.decode("utf-8", "replace").lower().strip(_EDGES), raw[-1:] in STOPS
        if w in _KINDS:
            return _KINDS[w], 0.0, stop
        weight = max([self.stems.get(w[:n], 0.0) for n in range(1, min(len(w), self.longest) + 1)] + [self.stems.get(w + "$", 0.0)])
        return (INSULT if weight else OTHER), weight, stop

    def clause(self, words: list[tuple[int, float, bool]]) -> tuple[float, list[int], list[int]]:
        """The score of a clause; how often an insult, a threat, and something of a target, under a negation and as
        reported was emitted; and at which words. Nothing unless it is accepted."""
        state, score, counts, places = 0, 0.0, [0] * 5, []
        for place, (kind, weight, _) in enumerate(words):
            before = state
            state, emitted, factor = MACHINE[state][kind]
            if emitted:
                score += factor * (weight if emitted == INSULTED else THREAT)
                counts[emitted - 1] += 1
                places.append(place)
                counts[2] += STATES[state][2] > 0
                counts[3] += STATES[before][3] > 0
                counts[4] += STATES[before][4] > 0
        return score, counts, places

    def features(self, ws: list[bytes]) -> list[float]:
        known = self.known
        if len(known) > CACHE:
            known.clear()
        for w in set(ws).difference(known):
            known[w] = self.word(w)
        told = list(map(known.__getitem__, ws))
        total = most = second = 0.0
        count, clauses, done, kinds = [0] * 5, 0, 0, set()
        for i in [i for i, (k, _, _) in enumerate(told) if k >= VERB]:
            if i < done:
                continue
            a = b = i
            while a > done and not told[a - 1][2]:
                a -= 1
            while b < len(told) - 1 and not told[b][2]:
                b += 1
            done = b + 1
            score, counts, places = self.clause(told[a:done])
            if score:
                clauses, total = clauses + 1, total + score
                most, second = max(most, score), max(min(most, score), second)
                count = [x + y for x, y in zip(count, counts, strict=True)]
                kinds.update(ws[a + x] for x in places)
        log = lambda x: float(np.log1p(x))
        return [log(total), most, second, *map(log, count), log(clauses), 10 * total / (len(ws) + 20), log(len(kinds))]


def in_fold(modulus: int, remainder: int) -> Column:
    """Whether crc32 of doc_id as text leaves this remainder."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word beginnings with the number of toxic and other documents that have them."""
    found: tuple[Counter, Counter] = (Counter(), Counter())
    for part in pieces(batches, "text"):
        for text, label in zip(part.column("text").to_pylist(), part.column("label").to_pylist(), strict=True):
            each = {w.decode("utf-8", "replace").lower().strip(_EDGES) for w in set(words(text))}
            found[label].update({w[:n] for w in each for n in range(4, 9) if len(w) >= n} | {w + "$" for w in each if len(w) >= 3})
    keys = list(found[0].keys() | found[1].keys())
    for at in range(0, len(keys), 50_000):
        some = keys[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([found[1][k] for k in some], pa.int64()), pa.array([found[0][k] for k in some], pa.int64())], names=["stem", "d1", "d0"])


def _measure(shared):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = shared.value
        for part in pieces(batches, "text"):
            rows = [grammar.features(words(t)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), part.column("label")], names=["x", "label"])

    return measure


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method; the last weight is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    def __init__(self, grammar: Grammar, weights: np.ndarray) -> None:
        self.grammar, self.weights = grammar, weights

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.grammar.features(words(t)) for t in texts], dtype=float).reshape(len(texts), len(FEATURES))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _sampled(rows: DataFrame, wanted: int) -> DataFrame:
    """About so many rows, by a hash of doc_id."""
    n = rows.count()
    return rows if n <= wanted else rows.where(F.xxhash64("doc_id") < int(-(2**63) + (wanted / n) * 2**64))


def learn(labelled: DataFrame, sample_rows: int = 6000) -> Model:
    """A model from rows of doc_id, text and label (0 or 1). sample_rows bounds the rows that are used."""
    spark = labelled.sparkSession
    rows = _sampled(labelled.where(F.col("label").isin(0, 1)), sample_rows)
    plain = written(rows.select(text_of().alias("text"), F.col("label").cast("int").alias("label")), "labelled")
    n0, n1 = plain.select(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).first()
    stems = {f"{w}$": 3.0 for w in INSULTS}
    if not (n0 and n1):
        return Model(Grammar(stems), np.array([0.5, 0.2, 0.1, 0.5, 0.5, 0.3, -0.3, -0.3, 0.3, 0.3, 0.3, -3]))
    counts = plain.mapInArrow(lean(_starts), "stem string, d1 long, d0 long").groupBy("stem").agg(F.sum("d1").alias("d1"), F.sum("d0").alias("d0"))
    weight = F.log((F.col("d1") + 0.5) / (n1 + 1)) - F.log((F.col("d0") + 0.5) / (n0 + 1))
    least = max(3.0, 0.008 * n1)
    # at most words of the sample's toxic rows
    stems |= {r["stem"]: min(6.0, r["weight"]) for r in counts.where(F.col("d1") >= least).withColumn("weight", weight).where(F.col("weight") >= 2.0).collect()}
    grammar = Grammar(stems)
    shared = spark.sparkContext.broadcast(grammar)
    kind = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType())])
    found = plain.mapInArrow(lean(_measure(shared)), kind).collect()  # eleven numbers for each of the sample's rows
    return Model(grammar, _fit(np.array([r["x"] for r in found]), np.array([r["label"] for r in found], dtype=float)))


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in pieces(batches, "__text"):
            s = model.scores(part.column("__text").to_pylist())
            keep = [n for n in part.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*[part.column(n) for n in keep], pa.array(s, pa.float64())], names=[*keep, "toxicity"])

    return score


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column toxicity between 0 and 1."""
    own = [f for f in docs.schema.fields if f.name not in ("toxicity", "__text")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[F.col(f"`{f.name}`") for f in own], text_of().alias("__text"))
    return rows.mapInArrow(lean(_scorer(shared)), T.StructType([*own, T.StructField("toxicity", T.DoubleType())]))


def learn_from(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, sample_rows: int = 6000) -> Model:
    """A model from the labels.toxic of documents outside the held-out fold. sample_rows bounds the labels that are used:
    they are chosen first, so that only their documents' texts move."""
    known = labels.where(F.col("toxic").isNotNull() & ~in_fold(modulus, held_out)).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    return learn(docs.select("doc_id", "text").join(_sampled(known, sample_rows), "doc_id"), 2 * sample_rows)
