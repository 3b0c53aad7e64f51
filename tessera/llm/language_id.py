"""Language of whole texts, with the spans of mixed ones.

Each word's script (from fixed code point ranges) leaves the languages that use it as
candidates. A word's score for a candidate is its log probability under the language's
character trigrams, relative to the best candidate and floored. A Viterbi search over the
words of a text, with a penalty for each switch, labels every word; runs of one label are
the spans, and the language with the most letters is the text's. The score is its share of
the letters. The score only compares languages; the fit tells whether the text is in any of them: the share
of its words' trigrams (by letters) that the label's language was seen to use.

The trigram tables are fitted on a bounded sample of labelled rows: at most ``PER_LANGUAGE``
texts of each language, those of the smallest hash of their id. Everything else covers all rows.
Scoring needs no shuffle: it follows the input splits.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import by_bytes, table, with_fields, worker_tables

#: Labelled texts of each language in the fit, at most.
PER_LANGUAGE = 1500
SWITCH_PENALTY = 12.0
#: A word's score relative to the best language is no lower than this.
FLOOR = -6.0
#: A script's share of a language's letters that makes the language a candidate for it.
SCRIPT_SHARE = 0.001
#: Words remembered in a worker, about, and words scored together.
CACHE_WORDS, WORDS_AT_ONCE = 200_000, 8192
HELD_BYTES = 1 << 20
UNKNOWN = "und"

#: Scripts by code point ranges (Unicode blocks), others are "other".
SCRIPTS = [
    ("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F),
    ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF),
    ("tamil", 0xB80, 0xBFF), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF),
    ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0xF900, 0xFAFF), ("arabic", 0xFB50, 0xFDFF),
]
_WORD = re.compile(r"[^\W\d_]+")


def script_of(char: str) -> str:
    c = ord(char)
    return next((name for name, a, b in SCRIPTS if a <= c <= b), "other")


def grams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[k : k + 3] for k in range(len(w) - 2)]


def codes_of(text: str) -> np.ndarray:
    """The trigram at each position as a number: three code points of 21 bits."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype("int64")
    return (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]


class Model:
    """Trigram log probabilities and scripts of the learned languages."""

    def __init__(self, counts: dict[str, Counter], scripts: dict[str, Counter], docs: dict[str, int]):
        self.langs = sorted(counts)
        n = len(self.langs)
        vocabulary = set().union(*counts.values()) if counts else set()
        floors = np.array([-np.log(sum(counts[x].values()) + len(vocabulary) + 1.0) for x in self.langs])
        self.floors = floors
        row = {g: k for k, g in enumerate(sorted(vocabulary))}
        #: Trigrams as 63-bit numbers in order; the last row of gain is for any other.
        self.codes = np.append(codes_of("".join(row))[::3], [np.iinfo("int64").max])
        self.gain = np.zeros((len(self.codes), n), "float32")
        for j, x in enumerate(self.langs):
            for g, c in counts[x].items():
                self.gain[row[g], j] = np.log(c + 1.0)
        self.allowed: dict[str, np.ndarray] = {}
        self.by_letter: dict[str, np.ndarray] = {}
        names = set().union(*scripts.values()) if scripts else set()
        for s in names:
            ok = np.array([scripts[x][s] >= SCRIPT_SHARE * max(1, sum(scripts[x].values())) for x in self.langs], bool)
            if ok.any():
                self.allowed[s] = ok
        self.first = int(np.argmax([docs.get(x, 0) for x in self.langs])) if n else 0

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of words: at most 0, the best candidate's is 0; all 0 where nothing is known of a script. And the share of each word's trigrams that each language has."""
        lower = [w.lower() for w in words]
        lens = np.array([len(w) for w in lower], "int64")
        codes = codes_of("^" + "$^".join(lower) + "$")
        starts = np.cumsum(lens + 2) - lens - 2
        keep = np.ones(len(codes), bool)  # trigrams that cross from one word to the next go
        keep[starts[1:] - 1] = keep[starts[1:] - 2] = False
        codes = codes[keep]
        at = np.searchsorted(self.codes, codes)
        at = np.where(self.codes[at] == codes, at, len(self.codes) - 1)
        gain = self.gain[at]
        total = np.add.reduceat(gain, np.cumsum(lens) - lens) + lens[:, None] * self.floors
        seen = np.add.reduceat(gain > 0, np.cumsum(lens) - lens, dtype="float32") / lens[:, None]
        ok = np.array([self.candidates(next(filter(str.isalpha, w), "")) for w in words]).reshape(len(words), len(self.langs))
        best = np.where(ok, total, -np.inf).max(1, keepdims=True)
        scores = np.maximum(np.where(ok, total - best, -np.inf), np.where(ok, FLOOR, 2 * FLOOR))
        return np.where(ok.any(1, keepdims=True), scores, 0).astype("float32"), seen.astype("float32")

    def candidates(self, letter: str) -> np.ndarray:
        if (ok := self.by_letter.get(letter)) is None:
            none = np.zeros(len(self.langs), bool)
            ok = self.by_letter[letter] = self.allowed.get(script_of(letter), none) if letter else none
        return ok


class Labeller:
    """Labels words of many texts at once; each worker keeps one per model."""

    def __init__(self, model: Model, penalty: float):
        self.model, self.penalty = model, penalty
        self.index: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.index.clear()
        self.table = np.zeros((1024, len(self.model.langs)), "float32")
        self.seen = self.table.copy()
        self.letters = np.zeros(1024, "int64")

    def learn(self, words: set[str]) -> None:
        need = len(self.index) + len(words)
        if need > len(self.letters):
            more = max(need, 2 * len(self.letters)) - len(self.letters)
            self.table = np.vstack([self.table, np.zeros((more, self.table.shape[1]), "float32")])
            self.seen = np.vstack([self.seen, np.zeros((more, self.table.shape[1]), "float32")])
            self.letters = np.append(self.letters, np.zeros(more, "int64"))
        new = list(words)
        for k in range(0, len(new), WORDS_AT_ONCE):
            part, start = new[k : k + WORDS_AT_ONCE], len(self.index)
            end = start + len(part)
            self.table[start:end], self.seen[start:end] = self.model.words(part)
            self.letters[start:end] = [len(w) if w.isalpha() else sum(map(str.isalpha, w)) for w in part]
            self.index.update(zip(part, range(start, end), strict=True))

    def label(self, texts: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each list of words: the label of each word, its letters, and the share of its trigrams that the label's language has."""
        if len(self.index) > CACHE_WORDS:
            self.clear()
        index = self.index
        if texts:
            self.learn(set().union(*texts).difference(index.keys()))
        table, letters = self.table, self.letters
        out, hard = [], []
        for k, words in enumerate(texts):
            ids = np.fromiter(map(index.__getitem__, words), "int64", len(words))
            s = table[ids]
            path = self.constant(s)
            if path is None:
                hard.append((k, s))
            out.append([path, letters[ids], ids])
        for (k, _), path in zip(hard, self.viterbi([s for _, s in hard]), strict=True):
            out[k][0] = path
        return [(path, n, self.seen[ids, path]) for path, n, ids in out]

    def constant(self, s: np.ndarray) -> np.ndarray | None:
        """The path without a switch, if no stretch of any other language gains more than half of what a switch costs.

        Then it is the best path: m stretches need m - 1 switches at least, which two or more can't pay, and one that covers all gains nothing.
        """
        if not len(s):
            return np.zeros(0, "int64")
        best = int(s.sum(0, dtype="float64").argmax())
        gain = np.cumsum(s - s[:, best : best + 1], axis=0, dtype="float64")
        low = np.minimum(np.minimum.accumulate(gain, axis=0), 0)
        low = np.vstack([np.zeros((1, s.shape[1])), low[:-1]])
        return np.full(len(s), best) if (gain - low).max() <= self.penalty / 2 else None

    def viterbi(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """Best paths of many texts, one word position of all of them at a time."""
        if not scores:
            return []
        order = sorted(range(len(scores)), key=lambda k: -len(scores[k]))
        lens = np.array([len(scores[k]) for k in order])
        flat = np.concatenate([scores[k] for k in order])
        starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
        n_langs = flat.shape[1]
        stay = np.ones(flat.shape, bool)
        source = np.zeros(len(flat), "int16")
        value = flat[starts].astype("float64")
        active = np.searchsorted(-lens, -np.arange(lens[0]), "left")  # texts longer than the position
        for t in range(1, lens[0]):
            n = active[t]
            at = starts[:n] + t
            v = value[:n]
            frm = v.argmax(1)
            sw = v[np.arange(n), frm] - self.penalty
            kept = v >= sw[:, None]
            stay[at] = kept
            source[at] = frm
            value[:n] = np.where(kept, v, sw[:, None]) + flat[at]
        path = np.zeros(len(flat), "int64")
        state = value.argmax(1)
        for t in range(lens[0] - 1, -1, -1):
            n = active[t]
            at = starts[:n] + t
            path[at] = state[:n]
            if t:
                state[:n] = np.where(stay[at, state[:n]], state[:n], source[at])
        out: list = [None] * len(scores)
        for k, a, n in zip(order, starts, lens, strict=True):
            out[k] = path[a : a + n]
        assert n_langs
        return out


def fit(rows: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from ``rows`` (doc_id, text, lang): at most ``per_language`` texts of each non-null lang, by hash of doc_id."""
    known = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    docs = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not docs:
        return Model({}, {}, {})
    space = 1 << 30
    share = F.create_map(*[F.lit(x) for k, n in docs.items() for x in (k, int(space * min(1.0, per_language / n)))])
    sample = known.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(space)) < share[F.col("lang")]).select("lang", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)
        for b in (part for whole in batches for part in by_bytes([whole], 1, HELD_BYTES)):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w, n in Counter(_WORD.findall(text.lower())).items():
                    c = seen[lang]
                    for g in grams(w):
                        c["g" + g] += n
                    for ch in w:
                        if ch.isalpha():
                            c["s" + script_of(ch)] += n
        for lang, c in seen.items():
            keys = list(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys, pa.string()), pa.array([c[k] for k in keys], pa.int64())], names=["lang", "gram", "n"])

    totals = sample.mapInArrow(counted, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts: dict[str, Counter] = {x: Counter() for x in docs}
    scripts: dict[str, Counter] = {x: Counter() for x in docs}
    for r in totals.collect():  # every trigram and script of the bounded sample
        (counts if r["gram"][0] == "g" else scripts)[r["lang"]][r["gram"][1:]] = r["n"]
    return Model(counts, scripts, docs)


def labeller(key: str, model: Model, penalty: float) -> Labeller:
    """The worker's labeller of a model: one is kept, with the words it has met."""
    return worker_tables(f"labeller {key}", lambda: Labeller(model, penalty))


def identify(col: Column | str, model: Model, penalty: float = SWITCH_PENALTY, spans: bool = False) -> Column:
    """A struct of ``lang``, ``score`` and ``fit`` of a text column; with ``spans`` also ``spans``, an array of (start, end, lang) in code points.

    Null texts and texts without a letter are ``und`` with score and fit 0, as is every text if no language was learned.
    A text whose scripts no learned language uses gets the most frequent language with score 0.
    """
    key = uuid.uuid4().hex
    schema = "struct<lang string, score double, fit double" + (", spans array<struct<start int, end int, lang string>>>" if spans else ">")

    @F.arrow_udf(schema)
    def labelled(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        mine = labeller(key, model, penalty)
        for a in batches:
            rows: list = []
            for part in by_bytes([pa.RecordBatch.from_arrays([a], ["t"])], 0, HELD_BYTES):
                rows += one(mine, part.column(0).to_pylist())
            cols = list(zip(*rows, strict=True)) if rows else [()] * (3 + spans)
            fields = [("lang", pa.string()), ("score", pa.float64()), ("fit", pa.float64())]
            if spans:
                fields.append(("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])

    def one(mine: Labeller, texts: list[str | None]) -> list[tuple]:
        langs = model.langs
        words = [_WORD.findall(t) if t else [] for t in texts]
        out = []
        for text, (path, letters, seen) in zip(texts, mine.label(words) if langs else [(None, np.zeros(0), None)] * len(texts), strict=True):
            total = int(letters.sum())
            if not total:
                out.append((UNKNOWN, 0.0, 0.0, []) if spans else (UNKNOWN, 0.0, 0.0))
                continue
            by = np.bincount(path, letters, len(langs))
            k, score = int(by.argmax()), float(by.max() / total)
            if not any(script_of(c) in model.allowed for c in set(text) if c.isalpha()):
                k, score = model.first, 0.0
            fit = float(letters @ seen / total)
            out.append((langs[k], score, fit, list(runs(text, path))) if spans else (langs[k], score, fit))
        return out

    def runs(text: str, path: np.ndarray) -> Iterator[dict]:
        found = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        start = 0
        for k in range(1, len(path) + 1):
            if k == len(path) or path[k] != path[start]:
                yield {"start": found[start][0], "end": found[k - 1][1], "lang": model.langs[path[start]]}
                start = k

    return labelled.asNondeterministic()(col)  # evaluated once, though two of its fields are used


def with_language(df: DataFrame, model: Model, text_col: str = "text", penalty: float = SWITCH_PENALTY, spans: bool = False) -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` and ``fit`` (and ``spans``).

    See ``identify`` for nulls and empty texts. Texts of any length are read whole, repeated rows each keep a row,
    columns of these names are replaced and others pass untouched, an empty table gives an empty table.
    """
    names = {"lang_pred": "lang", "score": "score", "fit": "fit"} | ({"spans": "spans"} if spans else {})
    return with_fields(df, identify(F.col(text_col).cast("string"), model, penalty, spans), names)


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def production_model(spark: SparkSession, sf_dir: str) -> Model:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return fit(docs.filter(~F.coalesce(held_out(), F.lit(True))))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = with_language(docs, production_model(spark, sf_dir))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op7_language_id": op7_language_id}
