"""BPE encoding and decoding by a pair occurrence index.

The words that a batch of texts needs and that are not known yet are laid out one after the other as one
array of symbols. An index maps each mergeable pair (by its rank) to all positions at which it occurs. Active
ranks are applied in ascending order; a merge updates the lists of the two pairs beside it. Words never share
a pair, so merging everywhere at once gives each word the ids that it would get alone. Results of words and of
chunks between white space are kept per worker process, in tables of bounded size.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections import defaultdict
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import batches

#: Entries of a worker's tables of words and of chunks; beyond it a table starts anew.
TABLE = 250_000
#: White space of the regular expression dialect; Python's split() also has U+001C to U+001F.
WHITE = "\t-\r \x85\xa0  -     　"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A word BPE of a tokenizers file: lower case, split by a pattern, byte letters, a suffix at word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], [x["type"] for x in spec["normalizer"]["normalizers"]]
        if steps != ["NFC", "Replace", "Lowercase"] or model.get("unk_token") or spec.get("decoder") or spec.get("post_processor"):
            raise ValueError(f"{path}: not a word BPE of the form that this encoder follows")
        self.vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.name = {i: t for t, i in self.vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.name |= {i: t for t, i in self.special.items()}
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        letters = byte_letters()
        #: Symbols of the 256 bytes inside a word, then of those that end one.
        self.first = np.array([self.vocab[x + end] for end in ("", suffix) for x in letters], np.int64)
        self.parts: list[tuple[int, int, int]] = []
        #: For each symbol, the rank of its pair with the symbol after it, and with the one before it.
        self.after: defaultdict[int, dict[int, int]] = defaultdict(dict)
        self.before: defaultdict[int, dict[int, int]] = defaultdict(dict)
        for r, pair in enumerate(model["merges"]):
            a, b = (self.vocab[x] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.parts.append((a, b, self.vocab[self.name[a] + self.name[b]]))
            self.after[a].setdefault(b, r)
            self.before[b].setdefault(a, r)
        #: Ranks whose new symbol takes part in a pair of lower rank.
        self.early = {r for r, (_, _, new) in enumerate(self.parts) if any(q < r for side in (self.after, self.before) for q in side.get(new, {}).values())}
        #: Ranks of the pairs of byte symbols; a symbol that ends a word has no pair after it.
        self.start = np.full((256, 512), -1, np.int32)
        for i, a in enumerate(self.first[:256].tolist()):
            for j, b in enumerate(self.first.tolist()):
                self.start[i, j] = self.after.get(a, {}).get(b, -1)
        self.said = [str(i) for i in range(max(self.name) + 1)]
        self.words: dict[str, tuple[str, str]] = {}
        self.chunks: dict[str, tuple[str, str]] = {}
        self.blank: set[str] = set()

    def merged(self, words: list[str]) -> tuple[list[int], list[int]]:
        """(ids of all words, one after the other; where each word's ids end), by the pair occurrence index over all of them."""
        raws = [w.encode("utf-8", "surrogatepass") for w in words]
        ends = np.cumsum([len(x) + 1 for x in raws]) - 1  # one place more after each word: no pair has it, so words stay apart
        at = np.frombuffer(b"\0".join(raws) + b"\0", np.uint8).astype(np.int64)
        at[ends - 1] += 256
        held = self.first[at]
        held[ends] = -1
        n = len(held)
        r = np.full(n, -1, np.int32)
        inside = at[:-1] < 256
        inside[ends[:-1]] = inside[ends - 1] = False
        r[:-1][inside] = self.start[at[:-1][inside], at[1:][inside]]
        found = np.flatnonzero(r >= 0)
        found = found[np.argsort(r[found], kind="stable")]
        ranks, begin = np.unique(r[found], return_index=True)
        where: dict[int, list[int]] = {k: x.tolist() for k, x in zip(ranks.tolist(), np.split(found, begin[1:]))}
        sym, after, before = held.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        parts, early, push = self.parts, self.early, heapq.heappush
        active = list(where)
        heapq.heapify(active)
        none: dict[int, int] = {}
        while active:
            r = heapq.heappop(active)
            places = where.pop(r)
            a, b, new = parts[r]
            if a == b:
                places.sort()  # of overlapping pairs the first counts
            if r in early and len(places) > 1:  # a lower rank may become active and then comes first: one at a time
                where[r] = places[1:]
                push(active, r)
                del places[1:]
            right, left = self.after.get(new, none).get, self.before.get(new, none).get
            for i in places:
                if sym[i] != a or sym[j := after[i]] != b:
                    continue  # an earlier merge took one of the two
                sym[i], sym[j] = new, -2
                after[i] = e = after[j]
                before[e] = i
                if (q := right(sym[e])) is not None:
                    if q in where:
                        where[q].append(i)
                    else:
                        where[q] = [i]
                        push(active, q)
                if i and (q := left(sym[p := before[i]])) is not None:
                    if q in where:
                        where[q].append(p)
                    else:
                        where[q] = [p]
                        push(active, q)
        done = np.array(sym)
        ids = done[done >= 0]
        return ids.tolist(), np.cumsum(done >= 0)[ends].tolist()

    def learn(self, chunks: set[str]) -> None:
        """Put the ids of unknown chunks (text without white space and special tokens) into the table."""
        if len(self.words) > TABLE:
            self.words = {}
        split: dict[str, list[str]] = {}
        pairs: list[tuple[str, str, str]] = []  # chunk, its one word, the marks after it or ""
        need: set[str] = set()
        for c in chunks:
            if m := self.plain(c):
                word, marks = m.groups()
                pairs.append((c, word := word.lower(), marks))
                need.add(word)
            else:
                split[c] = self.pieces("".join(map(str.lower, unicodedata.normalize("NFC", c))))
                need.update(split[c])
        need.update({x[2] for x in pairs})
        need.discard("")
        new = list(need.difference(self.words))
        if new:
            ids, ends = self.merged(new)
            said, names = list(map(self.said.__getitem__, ids)), list(map(self.name.__getitem__, ids))
            self.words.update(zip(new, [(" ".join(said[a:b]), " ".join(names[a:b])) for a, b in zip([0, *ends], ends)]))
        words, table = self.words, self.chunks
        for c, w, marks in pairs:
            if marks:
                (x, y), (u, v) = words[w], words[marks]
                table[c] = f"{x} {u}", f"{y} {v}"
            else:
                table[c] = words[w]
        for c, ws in split.items():
            table[c] = " ".join([words[w][0] for w in ws]), " ".join([words[w][1] for w in ws])
            if not ws:
                self.blank.add(c)

    #: A word of Latin letters (one code point each, in lower case too), and marks that are one piece of the pattern.
    plain = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f]+)([-.,;:!?#$%&*+/=^_|~()\\[\\]{}@\"]*)").fullmatch
    white = regex.compile(f"[{WHITE}]+")
    odd = regex.compile("[\x1c-\x1f]")

    def split(self, text: str) -> list[str]:
        return text.split() if not self.odd.search(text) else [x for x in self.white.split(text) if x]

    def cut(self, text: str) -> list[str]:
        """Chunks between white space; special tokens are chunks of their own."""
        if not self.special_at or "<|" not in text:
            return self.split(text)
        return [c for k, part in enumerate(self.special_at.split(text)) for c in ([part] if k % 2 else self.split(part))]

    def encode(self, texts: list[str]) -> list[tuple[str, int, str]]:
        """(ids joined by a space, their number, the decoded text) of each text.

        The table of chunks starts anew before a batch, never within one, so a batch's own chunks are all in it.
        """
        if len(self.chunks) > TABLE:
            self.chunks, self.blank = {}, set()
        cut = [self.cut(t) for t in texts]
        if not self.chunks:
            self.chunks = {c: (str(i), c) for c, i in self.special.items()}
        if need := set().union(*cut).difference(self.chunks):
            self.learn(need)
        out, get, said, text = [], self.chunks.__getitem__, itemgetter(0), itemgetter(1)
        for cs in cut:
            if self.blank and not self.blank.isdisjoint(cs):
                cs = [c for c in cs if c not in self.blank]
            found = list(map(get, cs))
            ids = " ".join(map(said, found))
            out.append((ids, ids.count(" ") + 1 if ids else 0, " ".join(map(text, found))))
        return out

    def ids(self, text: str) -> list[int]:
        return [int(x) for x in self.encode([text])[0][0].split()]

    def decode(self, ids: list[int]) -> str:
        """As the library without a decoder: token strings joined by a space, special tokens kept."""
        return " ".join(self.name[i] for i in ids)


@lru_cache(maxsize=4)
def loaded(path: str) -> WordBpe:
    return WordBpe(path)


def encoded(docs: DataFrame, tokenizer: str, keep: list[str] | None = None, ids: bool = False) -> DataFrame:
    """docs with n_tokens, ids_sha256 (of the decimal ids), decoded_sha256 (of the round trip's text) and, if wanted, ids.

    keep: columns to carry (default doc_id). A null text is empty: no ids, digests of the empty string. Every row
    gives a row, whatever its id. No shuffle; decoded texts stay in the worker.
    """
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    kinds = {"n": pa.int64(), "a": pa.string(), "b": pa.string()} | ({"ids": pa.list_(pa.int32())} if ids else {})

    @F.arrow_udf("struct<n:long,a:string,b:string" + (",ids:array<int>>" if ids else ">"))
    def coded(column: pa.Array) -> pa.Array:
        bpe = loaded(tokenizer)
        n, a, b, listed = [], [], [], []
        for part in batches(column):
            for said, k, text in bpe.encode(part):
                n.append(k)
                a.append(sha(said))
                b.append(sha(text))
                if ids:
                    listed.append(np.fromstring(said, np.int32, sep=" "))
        held = [n, a, b] + ([listed] if ids else [])
        return pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(held, kinds.values())], list(kinds))

    keep = ["doc_id"] if keep is None else keep
    made = {"n_tokens": "n", "ids_sha256": "a", "decoded_sha256": "b"} | ({"ids": "ids"} if ids else {})
    return docs.select(*keep, coded("text").alias("__bpe")).select(*keep, *[F.col(f"__bpe.{c}").alias(name) for name, c in made.items()])
