"""Toxicity by a weighted finite-state pattern grammar over clauses.

A clause becomes a string of word classes: insult, threat, target, negation, reported
speech, other. Five small transducers read it and are composed into one machine: the insult and threat
transducers emit a match, negation and report mark the matches in their reach, and the target transducer marks a match
that has a target before it or after it. The arcs' weights are those of the marks, and a clause is scored once: its heaviest
stem, and each mark's weight once (a clause counts as negated or reported only if all its matches are). Ten hits in a clause are one matched clause.

A text's score comes from its heaviest clause and from the logarithm of the number of clauses that stand
(an insult that is neither negated nor reported, or a threat to a target); no count is cut off.

Insult stems are learned from clauses, each different clause counting once, so that copies of a text add nothing:
prefixes of words by how many clauses of toxic texts they explain that no stem before explained, times their log odds. The marks' weights are
fitted by logistic regression around the grammar's own, on each text's heaviest clause.
Both use at most ``PER_CLASS`` labelled texts of each label, those of the smallest hash of their id;
everything else covers all rows. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import heapq
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import by_bytes, durable, table, worker_tables

#: Labelled texts of each label in the fit, at most.
PER_CLASS = 4000
#: Clauses of toxic training texts that a candidate stem occurs in, at least, and its log odds over clauses.
MIN_SUPPORT, MIN_ODDS = 5, 2.0
#: What a stem must explain: clauses of toxic texts times log odds.
MIN_GAIN = 40.0
STEM_MIN, STEM_MAX = 4, 14
#: Bytes of texts held at once, and of clauses whose stems are counted together.
HELD_BYTES, COUNTED_BYTES = 2 << 20, 1 << 19

# The grammar's own words (English, German, French, Spanish).
INSULTS = "idiot moron stupid loser scum trash pathetic worthless disgusting clown imbecile dumb fool bastard idiota imbécile dummkopf estúpid abschaum".split()
#: Threats as whole words, and as stems of words.
THREATS = "kill hurt destroy murder stab shoot beat burn töte umbringen".split()
THREAT_STEMS = "umbring umzubring umgebracht erschieß verprügel frapper matar golpear tuer".split()
TARGETS = "you your u he she they them him her these those people du dich ihr euch sie tu vous toi ils tú usted ustedes vosotros ellos".split()
NEGATIONS = "not never no n't isn't aren't don't nicht kein keine nie pas jamais ne nunca jamás tampoco".split()
REPORTS = "said says wrote writes called quoted quote reported claimed sagte schrieb nannte dit écrit appelé dijo escribió llamó".split()
#: Weights before any training: bias, stem weight, what each mark adds, and the logarithm of the number of clauses that stand.
PRIOR = {"bias": -3.0, "stem": 1.0, "directed": 0.7, "negated": -1.0, "reported": -1.0, "threat": 0.3, "threat_directed": 2.5, "more": 1.0}
SEED_WEIGHT = 3.0
#: How firmly the fit holds to the grammar's own weights, and how often heaviest clauses are chosen anew.
HOLD, ROUNDS = 4.0, 4
_END = re.compile(r"[.!?;:,\n|()\"“”«»]")
_WORD = re.compile(r"\w+(?:'\w+)?")
_LETTERS = re.compile(r"[^\W\d_]+")
FEATURES = ["bias", "stem", "directed", "negated", "reported", "threat", "threat_directed", "more"]


class Transducer:
    """A finite-state transducer given by ``step(state, symbol) -> (state, mark)``; marks are sets of flags."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def compose(self, other: Transducer) -> Transducer:
        """Both over the same string: the product machine, whose mark is the union of both marks."""

        def step(state, symbol):
            a, x = self.step(state[0], symbol)
            b, y = other.step(state[1], symbol)
            return (a, b), x | y

        return Transducer((self.start, other.start), step)

    def compiled(self, symbols: str = "OITVNR") -> Transducer:
        """The same machine as a table of all reachable states."""
        numbers, todo, table_ = {self.start: 0}, [self.start], {}
        while todo:
            s = todo.pop()
            for c in symbols:
                t, mark = self.step(s, c)
                if t not in numbers:
                    numbers[t] = len(numbers)
                    todo.append(t)
                table_[numbers[s], c] = (numbers[t], mark)
        return Transducer(0, lambda s, c: table_[s, c])

    def run(self, text: str) -> list[frozenset]:
        out, s = [], self.start
        for c in text:
            s, mark = self.step(s, c)
            out.append(mark)
        return out


_NONE: frozenset = frozenset()


def within(opener: str, reach: int, flag: str) -> Transducer:
    """Marks insults and threats up to ``reach`` words after an ``opener``."""
    mark = frozenset([flag])

    def step(left, symbol):
        if symbol == opener:
            return reach, _NONE
        return max(0, left - 1), mark if left and symbol in "IV" else _NONE

    return Transducer(0, step)


def emitter(symbol_: str, flag: str) -> Transducer:
    mark = frozenset([flag])
    return Transducer(0, lambda s, symbol: (0, mark if symbol == symbol_ else _NONE))


def near(opener: str, before: int, after: int, flag: str) -> Transducer:
    """Marks a clause in which an ``opener`` stands up to ``before`` words before an insult or threat, or up to ``after`` words after it."""
    mark = frozenset([flag])

    def step(state, symbol):
        opened, matched = state
        if symbol == opener:
            return (before, max(0, matched - 1)), mark if matched else _NONE
        if symbol in "IV":
            return (max(0, opened - 1), after), mark if opened else _NONE
        return (max(0, opened - 1), max(0, matched - 1)), _NONE

    return Transducer((0, 0), step)


#: The five machines, and their composition. Matches are marked where they stand, a target's mark also where the target follows.
PARTS = [emitter("I", "insult"), emitter("V", "threat"), within("N", 3, "negated"), within("R", 8, "reported"), near("T", 4, 3, "directed")]


def composed(parts: list[Transducer]) -> Transducer:
    out = parts[0]
    for x in parts[1:]:
        out = out.compose(x)
    return out.compiled()


MACHINE = composed(PARTS)


def clause_marks(string: str, machine: Transducer = MACHINE) -> frozenset:
    """The marks of a clause: those of any place, but negated and reported only if all its matches are."""
    places = machine.run(string)
    matches = [m for m in places if m & {"insult", "threat"}]
    some = frozenset().union(*places)
    return some - {f for f in ("negated", "reported") if not all(f in m for m in matches)}


class Model:
    """Stems with weights, and the weights of a match's marks."""

    def __init__(self, stems: dict[str, float], weights: dict[str, float]):
        self.stems, self.weights = stems, weights
        self.key = uuid.uuid4().hex


class Grammar:
    """Finds the matches of a model's grammar in texts; one is kept in each worker."""

    def __init__(self, model: Model):
        import ahocorasick

        self.model = model
        self.automaton = ahocorasick.Automaton()
        for w in THREATS:
            self.automaton.add_word(w, ("V", w, 0.0, True))
        for w in THREAT_STEMS:
            self.automaton.add_word(w, ("V", w, 0.0, False))
        for w, x in model.stems.items():
            self.automaton.add_word(w, ("I", w, x, False))
        self.automaton.make_automaton()
        self.classes = {w: "T" for w in TARGETS} | {w: "N" for w in NEGATIONS} | {w: "R" for w in REPORTS}

    def matches(self, text: str) -> Iterator[tuple[str, float, frozenset, int, int]]:
        """(stem, weight, marks, start, end) of each clause with a word that starts with a stem; the stem is its heaviest."""
        low = text.lower()
        found: dict[int, tuple[str, str, float]] = {}
        for end, (kind, stem, weight, whole) in self.automaton.iter(low):
            start = end - len(stem) + 1
            if start and (low[start - 1].isalnum() or low[start - 1] == "_"):
                continue
            if whole and len(low) > end + 1 and low[end + 1].isalnum():
                continue
            if start not in found or found[start][2] < weight:
                found[start] = (kind, stem, weight)
        right = -1
        for start in sorted(found):
            if start < right:
                continue  # in the clause before
            left, right = self.clause(low, start, max(right, 0))
            words = list(_WORD.finditer(low, left, right))
            kinds = [found[m.start()][0] if m.start() in found else self.classes.get(m[0], "O") for m in words]
            hits = [found[m.start()] for m in words if m.start() in found]
            if hits:
                _, stem, weight = max(hits, key=lambda h: h[2])
                yield stem, weight, clause_marks("".join(kinds)), left, right

    @staticmethod
    def clause(text: str, at: int, since: int = 0) -> tuple[int, int]:
        """The clause around a position, whatever its length; it starts at ``since`` or later."""
        back = _END.search(text[since:at][::-1])
        m = _END.search(text, at)
        return at - back.start() if back else since, m.start() if m else len(text)

    def clauses(self, text: str | None) -> list[tuple[tuple[float, ...], int]]:
        """The different feature vectors of a text's matched clauses (stem to threat_directed), each with its number of clauses."""
        seen: Counter = Counter()
        for _, weight, marks, _, _ in self.matches(text or ""):
            seen[vector(weight, marks)] += 1
        return list(seen.items())

    def score(self, text: str | None) -> float:
        w = np.array([self.model.weights[k] for k in FEATURES])
        return float(1 / (1 + np.exp(-w @ text_features(self.clauses(text), w))))


def vector(weight: float, marks: frozenset) -> tuple[float, ...]:
    """What a clause's marks are worth, in the order of ``FEATURES`` from stem to threat_directed."""
    insult, directed = "insult" in marks, "directed" in marks
    threat = "threat" in marks
    return (weight if insult else 0.0, float(insult and directed), float("negated" in marks), float("reported" in marks), float(threat and not directed), float(threat and directed))


def text_features(clauses: list[tuple[tuple[float, ...], int]], w: np.ndarray) -> np.ndarray:
    """Bias, the heaviest clause's vector under weights ``w``, and the logarithm of the number of clauses that stand."""
    f = np.zeros(len(FEATURES))
    f[0] = 1.0
    if clauses:
        f[1:-1] = max((v for v, _ in clauses), key=lambda v: (float(w[1:-1] @ v), v))
        stand = sum(n for v, n in clauses if v[5] or (v[0] and not v[2] and not v[3]))
        f[-1] = np.log(max(1, stand))
    return f


def grammar(model: Model) -> Grammar:
    """The worker's grammar of a model."""
    return worker_tables(f"grammar {model.key}", lambda: Grammar(model))


def prior_model() -> Model:
    return Model(dict.fromkeys(INSULTS, SEED_WEIGHT), dict(PRIOR))


def stems_of(text: str) -> set[str]:
    """Prefixes of a text's words."""
    return {w[:n] for w in set(_LETTERS.findall(text.lower())) for n in range(STEM_MIN, min(len(w), STEM_MAX) + 1)}


def different_clauses(rows: DataFrame) -> DataFrame:
    """(clause, toxic) of each different clause of ``rows`` (text, toxic), its words lowered; toxic if any text that has it is."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_bytes([whole], 0, HELD_BYTES):
                seen: dict[str, int] = {}
                for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for c in _END.split((text or "").lower()):
                        if len(c := " ".join(_LETTERS.findall(c))) >= STEM_MIN:
                            seen[c] = max(toxic, seen.get(c, 0))
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int32())], names=["clause", "toxic"])

    return rows.mapInArrow(cut, "clause string, toxic int").groupBy("clause").agg(F.max("toxic").alias("toxic"))


def fit(rows: DataFrame) -> Model:
    """Learn from ``rows`` (text, toxic): a bounded sample, as the caller took it (see ``sample``)."""
    rows = durable(rows.select("text", F.col("toxic").cast("int").alias("toxic")), "toxicity-sample")
    clauses = durable(different_clauses(rows), "toxicity-clauses")
    size = {r["toxic"]: r["n"] for r in clauses.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_tox, n_clean = size.get(1, 0), size.get(0, 0)
    if not n_tox or not n_clean:
        return prior_model()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_bytes([whole], 0, COUNTED_BYTES):  # what a part holds is summed with the others' in the shuffle
                seen = (Counter(), Counter())
                for clause, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    seen[toxic].update(stems_of(clause))
                stems = list(seen[0].keys() | seen[1].keys())
                counts = [pa.array([c[x] for x in stems], pa.int64()) for c in (seen[1], seen[0])]
                yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), *counts], names=["stem", "tox", "clean"])

    odds = F.log((F.col("tox") + 0.5) / (n_tox + 1.0)) - F.log((F.col("clean") + 0.5) / (n_clean + 1.0))
    marks_toxic = (F.col("tox") >= MIN_SUPPORT) & (F.col("odds") >= MIN_ODDS) & (F.col("tox") * F.col("odds") >= MIN_GAIN)
    known = (
        clauses.mapInArrow(counted, "stem string, tox long, clean long")
        .groupBy("stem").agg(F.sum("tox").alias("tox"), F.sum("clean").alias("clean"))
        .withColumn("odds", odds).filter(marks_toxic | F.col("stem").isin(INSULTS)).collect()
    )
    candidates = {r["stem"]: (r["tox"], r["clean"], r["odds"]) for r in sorted(known, key=lambda r: r["stem"])}
    toxic = clauses_hit(clauses.filter("toxic = 1"), list(candidates))
    stems = choose(candidates, [(r["toxic"], r["hits"]) for r in toxic.collect()])
    for w in INSULTS:
        tox, clean, o = candidates.get(w, (0, 0, 0.0))
        stems.setdefault(w, float(np.clip(o, 0, SEED_WEIGHT)) if tox + clean >= MIN_SUPPORT else SEED_WEIGHT)
    model = Model(stems, dict(PRIOR))
    seen = rows.select("toxic", clause_vectors(F.col("text"), model).alias("v")).collect()
    y = np.array([r["toxic"] for r in seen], float)
    found = [[(tuple(c["vector"]), c["n"]) for c in r["v"]] for r in seen]
    w = np.array([PRIOR[k] for k in FEATURES])
    for _ in range(ROUNDS):
        w = logistic(np.array([text_features(c, w) for c in found]), y)
    return Model(stems, dict(zip(FEATURES, map(float, w), strict=True)))


def clauses_hit(clauses: DataFrame, stems: list[str]) -> DataFrame:
    """(toxic, hits) of the clauses that have any of the given stems."""
    return clauses.select("toxic", stem_hits(F.col("clause"), stems).alias("hits")).filter("size(hits) > 0")


def stem_hits(col: Column, stems: list[str]) -> Column:
    """Which of the given stems a text's words start with."""
    at = {s: k for k, s in enumerate(stems)}

    @F.arrow_udf("array<int>")
    def hit(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            yield pa.array([sorted(at[s] for s in stems_of(t.as_py() or "") & at.keys()) for t in a], pa.list_(pa.int32()))

    return hit.asNondeterministic()(col)  # evaluated once, though a filter reads it too: else each task holds two Python workers, which stay


def choose(candidates: dict[str, tuple[int, int, float]], hits: Iterable[tuple[int, list[int]]]) -> dict[str, float]:
    """Stems with their log odds, one by one: each time the one with the most toxic clauses not yet explained, times its log odds.

    ``candidates`` holds (toxic clauses, clean ones, log odds) by stem, ``hits`` (1, places of the candidates) of toxic clauses.
    Of stems that occur in the same clauses the longest is taken, then the first in order.
    """
    names = list(candidates)
    clauses: list[list[int]] = [[] for _ in names]
    for k, h in enumerate(h for t, h in hits if t == 1):
        for c in h:
            clauses[c].append(k)
    done: set[int] = set()
    gain = lambda c: sum(k not in done for k in clauses[c]) * candidates[names[c]][2]
    heap = [(-gain(c), -len(names[c]), c) for c in range(len(names))]
    heapq.heapify(heap)
    out: dict[str, float] = {}
    while heap:
        old, size, c = heapq.heappop(heap)
        if (now := -gain(c)) > -MIN_GAIN:
            continue
        if now > old:  # others explained some of it meanwhile
            heapq.heappush(heap, (now, size, c))
            continue
        out[names[c]] = float(candidates[names[c]][2])
        done.update(clauses[c])
    return out


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Weights by Newton's method, drawn to the grammar's own by ``HOLD``."""
    w0 = np.array([PRIOR[k] for k in FEATURES])
    w = w0.copy()
    hold = np.full(len(w), HOLD)
    hold[0] = 0.1
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(hold), x.T @ (p - y) + hold * (w - w0))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def clause_vectors(col: Column, model: Model) -> Column:
    """The different vectors of a text's matched clauses, with their numbers, as an array of structs."""

    @F.arrow_udf("array<struct<vector array<double>, n int>>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        g = grammar(model)
        kind = pa.list_(pa.struct([("vector", pa.list_(pa.float64())), ("n", pa.int32())]))
        for a in batches:
            yield pa.array([[{"vector": list(v), "n": n} for v, n in g.clauses(t.as_py())] for t in a], kind)

    return found(col)


def toxicity(col: Column | str, model: Model) -> Column:
    """Score of a text column, 0 to 1. Null and empty texts get the score of a text without a match."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        g = grammar(model)
        for a in batches:
            out: list[float] = []
            for part in by_bytes([pa.RecordBatch.from_arrays([a], ["t"])], 0, HELD_BYTES):
                out += [g.score(t) for t in part.column(0).to_pylist()]
            yield pa.array(out, pa.float64())

    return scored.asNondeterministic()(col)  # evaluated once, though two columns use it


def with_toxicity(df: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``df`` with ``score`` and ``predicted`` (1 from ``threshold`` on).

    Nulls and empty texts: see ``toxicity``. Texts are read whole, repeated rows each keep a row, columns of these
    names are replaced and others pass untouched, an empty table gives an empty table.
    """
    out = df.withColumn("score", toxicity(F.col(text_col).cast("string"), model))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(text, toxic) of at most ``per_class`` labelled documents of each label, those of the smallest hash of their id.

    A document labelled more than once counts as toxic if any label says so. The ids are few by that bound, so they are broadcast.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by_hash = [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id")]
    ids = known.filter("toxic = 1").orderBy(*by_hash).limit(per_class).unionByName(known.filter("toxic = 0").orderBy(*by_hash).limit(per_class))
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id", "toxic").agg(F.max("text").alias("text")).select("text", "toxic")  # an id on many rows gives one


def production_model(spark: SparkSession, sf_dir: str) -> Model:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return fit(sample(docs, labels.select("doc_id", "toxic").filter(~held_out())))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = with_toxicity(docs, production_model(spark, sf_dir))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {"op1_toxicity": op1_toxicity}
