"""Language identification: word-first backoff.

A word that the model knows is scored by its log frequency in each language. An unseen word is scored by its character
n-grams (with marks at both ends), the longest length first; the first length at which any n-gram is known decides.
Scores become a posterior over the languages per word, held above a floor so that one word can't rule out a language;
a text's scores are the sums over its words, and its score is tempered alike at every length (see WORTH).

The model is fitted on a bounded sample of the labelled rows: `per_language` documents of each language, those with the
least hash of the id. Word and n-gram tables hold at most `words` and `grams` entries a language.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import batches, plain_words, remainder, separators, stored

UNDETERMINED = "und"
LENGTHS = (5, 4, 3, 2, 1)
FLOOR = -6.0
#: Entries of a worker's table of words; beyond it the table starts anew.
TABLE = 200_000
#: A text's words aren't independent: n of them count as n * WORTH / (n + WORTH).
WORTH = 200
WORD, SPACED = re.compile(r"[^\W\d_]+"), separators("")


def letters_of(run: str) -> list[str]:
    """The runs of letters in a run of letters and numerals such as superscripts."""
    return "".join([c if c.isalpha() else " " for c in run]).split()


def words_of(text: str) -> list[str]:
    """Runs of letters, lower case."""
    low = text.lower()
    if (found := plain_words(low, SPACED)) is not None:
        return found
    found = WORD.findall(low)
    mixed = {w: letters_of(w) for w in set(found) if not w.isalpha()}
    return [x for w in found for x in mixed.get(w, (w,))] if mixed else found


def grams_of(word: str, n: int) -> list[str]:
    marked = f"^{word}$" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Backoff:
    """Log frequencies of words and n-grams: a place for each, and a row of one matrix over the languages at that place."""

    def __init__(self, counts: dict[str, Counter], words: int, grams: int):
        self.languages = sorted(counts)
        self.rows = np.zeros((0, len(counts)), np.float32)
        self.known = self.placed(counts, words)
        self.grams = []
        for n in LENGTHS:
            of = {}
            for lang, c in counts.items():
                g: Counter = Counter()
                for w, k in c.items():
                    for x in grams_of(w, n):
                        g[x] += min(k, 3)  # types rather than tokens: frequent words have entries of their own
                of[lang] = g
            self.grams.append(self.placed(of, grams))

    def placed(self, counts: dict[str, Counter], most: int, least: int = 2) -> dict[str, int]:
        keep = sorted({w for c in counts.values() for w, k in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:most] if k >= least})
        if not keep:
            return {}
        n = np.array([[counts[lang][w] for lang in self.languages] for w in keep], float) + 0.1
        size = np.array([sum(counts[lang].values()) for lang in self.languages]) + 0.1 * len(keep)
        first = len(self.rows)
        self.rows = np.concatenate([self.rows, np.log(n / size).astype(np.float32)])
        return dict(zip(keep, range(first, len(self.rows))))

    def places(self, word: str) -> list[int]:
        """Rows that a word's score is the mean of: its own, or those of its longest known n-grams; none if nothing is known."""
        if (at := self.known.get(word)) is not None:
            return [at]
        for n, table in zip(LENGTHS, self.grams):
            if found := [table[g] for g in grams_of(word, n) if g in table]:
                return found
        return []

    def posteriors(self, words: list[str]) -> np.ndarray:
        """Log posterior of each language given each word alone, each at least FLOOR."""
        at = [self.places(w) for w in words]
        n = np.array(list(map(len, at)))
        v = np.zeros((len(words), len(self.languages)))
        if some := [k for x in at for k in x]:
            v[n > 0] = np.add.reduceat(self.rows[some], np.r_[0, np.cumsum(n[n > 0])[:-1]], axis=0, dtype=float) / n[n > 0, None]
        v -= v.max(1, keepdims=True)
        return np.maximum(v - np.log(np.exp(v).sum(1, keepdims=True)), FLOOR).astype(np.float32)


class Scorer:
    """Predicts with a model; keeps the rows of words that it has met."""

    def __init__(self, model: Backoff):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.model.languages)), np.float32)

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, score) of each text; words that are new to the batch are looked up together."""
        found = list(map(words_of, texts))
        if not self.model.languages:
            return [(UNDETERMINED, 0.0)] * len(texts)
        if len(self.at) > TABLE:
            self.clear()
        if new := list(set().union(*found).difference(self.at)):
            self.at.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.rows = np.concatenate([self.rows, self.model.posteriors(new)])
        out, at, rows = [], self.at.__getitem__, self.rows
        for words in found:
            if not words:
                out.append((UNDETERMINED, 0.0))
                continue
            total = rows[list(map(at, words))].sum(axis=0, dtype=np.float64)
            best = int(total.argmax())  # a tie goes to the first language by name
            p = np.exp((total - total[best]) * (WORTH / (len(words) + WORTH)))
            out.append((self.model.languages[best], float(1 / p.sum())))
        return out


def trained(labelled: DataFrame, per_language: int = 1000, words: int = 50_000, grams: int = 30_000) -> bytes:
    """A pickled Backoff from labelled rows (doc_id, text, lang); rows with null text or language teach nothing.

    Ids are chosen first, from the id and language alone: those under a hash limit that leaves about twice as many as
    wanted of each language, whatever its size, and of these the least. The scan for their texts is dealt as any other;
    what it finds goes to one task, whose input is thus bounded, and only the model comes to the driver.
    """
    rows = labelled.select("doc_id", "text", "lang").filter("doc_id is not null and lang is not null")
    whole = 1 << 30
    h = F.pmod(F.xxhash64("doc_id"), F.lit(whole))
    sizes = stored(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    few = rows.select("doc_id", "lang", h.alias("h")).join(sizes, "lang").filter(F.col("h") < F.lit(float(whole * (2 * per_language + 100))) / F.col("n"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = few.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_language)
    ids = [r[0] for r in chosen.select("doc_id").distinct().collect()]

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: defaultdict[str, Counter] = defaultdict(Counter)
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts[lang].update(words_of(text or ""))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Backoff(dict(counts), words, grams))], pa.binary())], ["model"])

    sample = rows.filter(F.col("doc_id").isin(ids)).select("text", "lang").repartition(1)
    found = sample.mapInArrow(train, "model binary").collect() if ids else []
    return bytes(found[0][0]) if found else pickle.dumps(Backoff({}, words, grams))


_scorers: dict[str, Scorer] = {}


def predictor(spark, model: bytes):
    """A function of a text column: struct(lang, score). The model is broadcast; its size is bound by its parameters."""
    shared, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(pickle.loads(shared.value))
        found = [x for part in batches(texts) for x in _scorers[key].predict(part)]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["lang", "score"])

    return predict


def teaches() -> Column:
    """Whether a document may teach the model: the remainder of its id isn't 1."""
    return remainder("doc_id", 3) != 1


def languages(docs: DataFrame, per_language: int = 1000) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs (doc_id, text, lang; other columns are left out).

    A null text, an empty one and one without a letter (at any length) are `und` with score 0. A null id is held out. Repeated rows
    each have their row; with no labelled row at all every text is `und`.
    """
    model = trained(docs.filter(teaches()), per_language)
    predict = predictor(docs.sparkSession, model)
    return docs.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(True)).alias("held_out"), predict("text").alias("p")).select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
