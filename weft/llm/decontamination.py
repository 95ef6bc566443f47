"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are passages; their TF-IDF matrix, with document frequencies counted over the whole corpus, gets a
randomised SVD that is computed over the partitions of the items: each adds up its share of A'AX for a random X, then of
the small Gram matrix in the range found. Every text is slid over by windows of 32, 64, 128, ... words (as the items' lengths
need) in steps of 16; a window's vector is the sum of its terms' latent vectors, and items whose cosine reaches a threshold
are candidates. A candidate is checked by the longest common subsequence of words. A share of 0.8 of the item's words is a
copy. From 0.5 on it is a paraphrase, if the item's answer (its last sentence, or its last words) is there too.
"""

from __future__ import annotations

import math
import pickle
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import batches, plain_words, separators

WORD, SPACED = re.compile(r"[^\W_]+"), separators("0123456789")
STEP = 16
COSINE, COPY, PARAPHRASE, ANSWER = 0.4, 0.8, 0.5, 0.8
#: Windows looked at together.
WINDOWS = 4096
#: Items of fewer words are found by their exact sequence of words only.
LEAST_WORDS = 8
#: Items, and their words, searched for in one pass over the texts: what is broadcast is bound by them; more take more passes.
BLOCK, BLOCK_WORDS = 5000, 500_000
#: Blocks whose terms are counted in one pass over the texts.
COUNTED = 10


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, lower case."""
    low = text.lower()
    found = plain_words(low, SPACED)
    return WORD.findall(low) if found is None else found


def answer_of(text: str) -> list[str]:
    """Words of the last sentence; where it has under 3, the last 8 words of the text."""
    words = words_of(text)
    last = words_of([s for s in re.split(r"[.!?]+\s*", text) if WORD.search(s)][-1]) if words else []
    return last if len(last) >= 3 else words[-8:]


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a bit of a for each step: words of b update all of a at once."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        if m := at.get(y):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def window_of(words: int) -> int:
    """Words of the windows that hold a passage of that many words wholly: a step less than the window at most."""
    w = 2 * STEP
    while words > w - STEP + 1:
        w *= 2
    return w


class Words:
    """The words of a batch of texts that items have too, in blocks of STEP words; every text begins a block of its own."""

    def __init__(self, lists: list[list[str]], terms: dict[str, int]):
        get, n = terms.get, np.array(list(map(len, lists)), np.int64)
        ids = np.fromiter(chain.from_iterable(map(get, ws, repeat(-1)) for ws in lists), np.int32, n.sum())
        self.blocks = n // STEP + 1
        self.begin = np.cumsum(self.blocks) - self.blocks
        self.end = self.begin + self.blocks
        place = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
        known = np.flatnonzero(ids >= 0)
        self.ids, self.at = ids[known], (np.repeat(self.begin, n) + place // STEP)[known]

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first block, block after the last) of the windows of n blocks, a block apart; a short text is one window."""
        count = np.maximum(1, self.blocks - n + 1)
        text = np.repeat(np.arange(len(count)), count)
        first = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + self.begin[text]
        return text, first, np.minimum(first + n, self.end[text])


class Searcher:
    """Finds the items of one latent space in batches of texts."""

    def __init__(self, every: dict[str, int], terms: dict[str, int], vectors: np.ndarray, items: list[tuple[int, list[str], list[str]]], latent: np.ndarray):
        self.local = np.full(len(every), -1, np.int32)  # our number of a term of the pass
        self.local[[every[w] for w in terms]] = list(terms.values())
        self.vectors = vectors.astype(np.float32)  # idf times latent vector, by term; a zero row for terms of no weight
        self.ids = [i for i, _, _ in items]
        self.words = [[terms[w] for w in ws] for _, ws, _ in items]
        self.answers = [[terms[w] for w in an] for _, _, an in items]
        self.heavy = np.abs(self.vectors).sum(1) > 0
        #: For each item a row of bits by term, for terms that it has at least once, twice, ...: together its words.
        self.masks = [np.zeros((len(items), (len(terms) + 63) // 64 * 8), np.uint8) for _ in range(max(Counter(ws).most_common(1)[0][1] for ws in self.words))]
        for k, ws in enumerate(self.words):
            for t, n in Counter(ws).items():
                for m in self.masks[:n]:
                    m[k, t >> 3] |= 1 << (t & 7)
        self.masks = [m.view(np.uint64) for m in self.masks]
        self.again = np.array([len(ws) - len(set(ws)) for ws in self.words])
        self.groups: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for w in {window_of(len(x)) for x in self.words}:
            at = np.array([k for k, x in enumerate(self.words) if window_of(len(x)) == w])
            self.groups[w] = at, np.ascontiguousarray(latent[at].T.astype(np.float32)), PARAPHRASE * np.array([len(self.words[k]) for k in at])

    def find(self, words: Words) -> dict[tuple[int, int], tuple[float, float, int]]:
        """{(text, item): (share of its words in the longest common subsequence, cosine, first word of the window)}."""
        ids = self.local[words.ids]
        ids, at = ids[ids >= 0], words.at[ids >= 0]
        weighty = self.heavy[ids]
        if not weighty.any():
            return {}
        block, heavy = at[weighty], ids[weighty]
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        nth = np.arange(len(block)) - np.repeat(starts, np.diff(np.r_[starts, len(block)]))
        total = np.zeros((words.end[-1] + 1, self.vectors.shape[1]))
        for k in range(nth.max() + 1):  # the k-th word of every block at once
            own = np.flatnonzero(nth == k)
            total[block[own] + 1] += self.vectors[heavy[own]]
        np.cumsum(total, axis=0, out=total)
        best: dict[tuple[int, int], tuple[float, float, int]] = {}
        for w, (items, latent, least) in self.groups.items():
            text, first, stop = words.windows(w // STEP)
            for lo in range(0, len(first), WINDOWS):
                f, e = first[lo : lo + WINDOWS], stop[lo : lo + WINDOWS]
                v = total[e] - total[f]
                size = np.sqrt(np.einsum("ij,ij->i", v, v))
                along = v.astype(np.float32) @ latent
                rows, cs = np.nonzero((along >= COSINE * size[:, None]) & (size > 1e-6)[:, None])
                if not len(rows):
                    continue
                # the window and a block on either side, within its text
                left, right = np.maximum(f - 1, words.begin[text[lo : lo + WINDOWS]]), np.minimum(e + 1, words.end[text[lo : lo + WINDOWS]])
                good = self.enough(rows, items[cs], least[cs], left, right, ids, at)
                begin, end = np.searchsorted(at, left), np.searchsorted(at, right)
                last, listed = -1, []
                for r, c in zip(rows[good].tolist(), cs[good].tolist()):
                    k, t = int(items[c]), int(text[lo + r])
                    if (t, k) in best and best[t, k][0] >= 1.0:
                        continue
                    if r != last:
                        last, listed = r, ids[begin[r] : end[r]].tolist()
                    share = lcs(self.words[k], listed) / len(self.words[k])
                    if share < PARAPHRASE or share < COPY and lcs(self.answers[k], listed) < ANSWER * len(self.answers[k]):
                        continue
                    if (t, k) not in best or share > best[t, k][0]:
                        best[t, k] = share, float(along[r, c] / size[r]), int(f[r] - words.begin[t]) * STEP
        return best

    def enough(self, rows: np.ndarray, items: np.ndarray, least: np.ndarray, left: np.ndarray, right: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For pairs of window and item, whether as many of the item's words are there at all: no common subsequence is longer."""
        hit, place = np.unique(rows, return_inverse=True)
        lo, hi = left[hit[0]], right[hit].max()
        own = slice(*np.searchsorted(at, (lo, hi)))
        here = np.zeros((hi - lo, self.masks[0].shape[1] * 64), bool)
        here[at[own] - lo, ids[own]] = True
        bits = np.packbits(here, axis=1, bitorder="little").view(np.uint64)
        begin, last = left[hit] - lo, right[hit] - lo - 1
        there = bits[begin]
        for d in range(1, (last - begin).max() + 1):
            there |= bits[np.minimum(begin + d, last)]
        out = np.zeros(len(rows), bool)
        for k in range(0, len(rows), 8192):
            part = slice(k, k + 8192)
            n = np.bitwise_count(there[place[part]] & self.masks[0][items[part]]).sum(1, dtype=np.int32)
            some = np.flatnonzero(n + self.again[items[part]] >= least[part])  # others lack too many different words
            has = there[place[part][some]]
            for m in self.masks[1:]:
                n[some] += np.bitwise_count(has & m[items[part][some]]).sum(1, dtype=np.int32)
            out[k + some] = n[some] >= least[part][some]
        return out


class Short:
    """Finds items of fewer than LEAST_WORDS words by their exact sequence of words."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.by_first: dict[str, list[tuple[int, list[str]]]] = {}
        for i, ws in items:
            self.by_first.setdefault(ws[0], []).append((i, ws))

    def find(self, words: list[str]) -> list[tuple[int, float, float, int, bool]]:
        """As of a Searcher: share and cosine are 1, first_word is the item's own first word."""
        best: dict[int, int] = {}
        get = self.by_first.get
        for at, w in enumerate(words):
            for i, ws in get(w, ()):
                if i not in best and words[at : at + len(ws)] == ws:
                    best[i] = at
        return [(i, 1.0, 1.0, at, True) for i, at in sorted(best.items())]


class Pass:
    """All searchers of one pass over the texts."""

    def __init__(self, terms: dict[str, int], searchers: list[Searcher], short: Short):
        self.terms, self.searchers, self.short = terms, searchers, short

    def find(self, texts: list[str]) -> list[list[tuple[int, float, float, int, bool]]]:
        """For each text (item, share of its words in the longest common subsequence, cosine, first word of the window, whether a copy)."""
        lists = list(map(words_of, texts))
        out = list(map(self.short.find, lists)) if self.short.by_first else [[] for _ in lists]
        if self.searchers:
            words = Words(lists, self.terms)
            for s in self.searchers:
                for (t, k), (share, cosine, at) in sorted(s.find(words).items()):
                    out[t].append((s.ids[k], share, cosine, at, share >= COPY))
        return out


def rows_of(batches: Iterator[pa.RecordBatch], terms: dict[str, int], idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows (unit length) of the items in a partition."""
    out = []
    for b in batches:
        for text in b.column(0).to_pylist():
            row = np.zeros(len(terms))
            for w, n in Counter(words_of(text or "")).items():
                if w in terms:
                    row[terms[w]] = n * idf[terms[w]]
            out.append(row / (np.linalg.norm(row) or 1.0))
    return np.array(out).reshape(-1, len(terms))


def decomposed(items: DataFrame, terms: dict[str, int], idf: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Right singular vectors (terms by k) of the items' TF-IDF matrix, by a randomised range finder over partitions."""
    width = min(len(terms), k + 10)
    start = np.random.default_rng(seed).standard_normal((len(terms), width))

    def added(make, shape: tuple[int, int]) -> np.ndarray:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array([make(rows_of(batches, terms, idf)).tobytes()], pa.binary())], ["part"])

        return sum((np.frombuffer(r[0]).reshape(shape) for r in items.select("text").mapInArrow(work, "part binary").toLocalIterator()), np.zeros(shape))

    q = start
    for _ in range(2):
        base = q
        q, _ = np.linalg.qr(added(lambda a: a.T @ (a @ base), start.shape))
    small = added(lambda a: (a @ q).T @ (a @ q), (width, width))
    values, turn = np.linalg.eigh(small)
    keep = [i for i in np.argsort(values)[::-1][:k] if values[i] > 1e-9 * max(values.max(), 1e-30)]
    return q @ turn[:, keep]


def counted(docs: DataFrame, terms: dict[str, int]) -> tuple[int, np.ndarray]:
    """Number of documents, and in how many each term is, over all documents. The driver gets a sum per term."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(len(terms), np.int64)
        known = terms.keys()
        for b in batches:
            for text in b.column(0):
                n += 1
                if t := text.as_py():
                    df[[terms[w] for w in known & set(words_of(t))]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at], pa.int64()), pa.array(np.r_[n, df[at]], pa.int64())], ["term", "n"])

    df = np.zeros(len(terms), np.int64)
    total = 0
    for t, n in docs.select("text").mapInArrow(work, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        if t < 0:
            total = n
        else:
            df[t] = n
    return total, df


def blocks_of(items: DataFrame, most: int) -> Iterator[list[tuple[int, str, list[str]]]]:
    """The distinct items (id, text, words) in blocks of at most `most` items and BLOCK_WORDS words, or one item; the driver holds some blocks at a time."""
    held, n = [], 0
    rows = items.select("item_id", "text").filter("item_id is not null and text is not null").distinct().orderBy("item_id", "text")
    for i, text in rows.toLocalIterator():
        if not (ws := words_of(text)):
            continue
        if held and (len(held) == most or n + len(ws) > BLOCK_WORDS):
            yield held
            held, n = [], 0
        held.append((i, text, ws))
        n += len(ws)
    if held:
        yield held


def prepared(docs: DataFrame, items: DataFrame, dimensions: int = 128) -> Iterator[bytes]:
    """Pickled Pass of each block of items (item_id, text) with words.

    A searcher has no more items than dimensions, so that its latent space holds every item whole however many there
    are. Document frequencies are counted for COUNTED blocks at a time.
    """
    blocks = blocks_of(items, BLOCK)
    while some := list(islice(blocks, COUNTED)):
        every = {w: k for k, w in enumerate(sorted({w for part in some for _, _, ws in part if len(ws) >= LEAST_WORDS for w in ws}))}
        n, df = counted(docs, every) if every else (0, np.zeros(0))
        for part in some:
            short, long = [(i, ws) for i, _, ws in part if len(ws) < LEAST_WORDS], [x for x in part if len(x[2]) >= LEAST_WORDS]
            terms = {w: k for k, w in enumerate(sorted({w for _, _, ws in long for w in ws}))}
            own = df[[every[w] for w in terms]]
            searchers = [searcher_of(docs.sparkSession, long[at : at + dimensions], terms, n, own, dimensions) for at in range(0, len(long), dimensions)]
            yield pickle.dumps(Pass(terms, searchers, Short(short)))


def searcher_of(spark, part: list[tuple[int, str, list[str]]], every: dict[str, int], n: int, df: np.ndarray, dimensions: int) -> Searcher:
    """The searcher of a block of items; n documents, df of them with each term of every."""
    terms = {w: k for k, w in enumerate(sorted({w for _, _, ws in part for w in ws}))}
    df = df[[every[w] for w in terms]]
    idf = np.log(1 + n / np.maximum(df, 1))
    common = df > 0.1 * n
    heavy = ~common
    for _, _, ws in part:  # an item of common words alone keeps them all
        at = [terms[w] for w in ws]
        if (~common[at]).sum() < 5:
            heavy[at] = True
    idf = np.where(heavy, idf, 0.0)
    frame = spark.createDataFrame([(t,) for _, t, _ in part], "text string").repartition(min(8, len(part)))
    v = decomposed(frame, terms, idf, min(dimensions, len(part)))
    vectors = idf[:, None] * v
    latent = np.array([vectors[[terms[w] for w in ws]].sum(0) for _, _, ws in part])
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    return Searcher(every, terms, vectors, [(i, ws, answer_of(t)) for i, t, ws in part], latent)


_searchers: dict[str, Pass] = {}
FOUND = "array<struct<item_id:long,share:double,cosine:double,first_word:long,copy:boolean>>"


def finder(spark, searchers: bytes):
    """A function of a text column: the items found. The searchers of a pass are broadcast; BLOCK and BLOCK_WORDS bound their size."""
    shared, key = spark.sparkContext.broadcast(searchers), uuid.uuid4().hex
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("share", pa.float64()), ("cosine", pa.float64()), ("first_word", pa.int64()), ("copy", pa.bool_())]))

    @F.arrow_udf(FOUND)
    def find(texts: pa.Array) -> pa.Array:
        if key not in _searchers:
            _searchers.clear()
            _searchers[key] = pickle.loads(shared.value)
        names = ("item_id", "share", "cosine", "first_word", "copy")
        return pa.array([[dict(zip(names, x)) for x in found] for part in batches(texts) for found in _searchers[key].find(part)], kind)

    return find


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, share, cosine, first_word, copy) for each document and benchmark item found in it.

    docs: doc_id, text; items: item_id, text; other columns are left out. Null and empty texts have nothing; items with
    a null id or text, or without words, aren't searched for. Repeated documents each have their rows; of
    repeated items one is searched for.
    """
    out = None
    for s in prepared(docs, items):
        found = docs.select("doc_id", F.explode(finder(docs.sparkSession, s)("text")).alias("x")).select("doc_id", "x.*")
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, share double, cosine double, first_word long, copy boolean") if out is None else out


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the documents in which a benchmark item is found; rows and columns are as they were."""
    for s in prepared(docs, items):
        docs = docs.filter(F.size(finder(docs.sparkSession, s)("text")) == 0)
    return docs
