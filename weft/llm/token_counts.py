"""Token counts with a sentencepiece model, by overlap resynchronisation.

A document of at most `chunk` code points is encoded at once. A longer one is cut into chunks of that
length that overlap; each is encoded apart, token ends are turned into offsets in the document, and two
neighbours are spliced at a boundary inside their overlap that is proven stable. Memory for one document
is then that of a chunk, whatever its length.

Proof of a stable boundary: a BPE merge only ever makes pieces of the vocabulary. Where the two code points
beside a position stand side by side in no piece, no token can span the position in any encoding, so both
sides are encoded as if the other did not exist. Both encodings must show the boundary as well; where the
overlap has no such place the overlap is doubled, up to the rest of the document.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"  # the model's mark for a space


class PieceCounter:
    """Counts tokens of one model; one per worker process."""

    def __init__(self, path: str, chunk: int = 16384, overlap: int = 128):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap, self.widened = chunk, overlap, 0
        n = self.model.vocab_size()
        self.width = np.zeros(n, np.int64)  # code points that a piece stands for; of a byte, 1 if it begins a code point
        self.joined: set[str] = set()
        for i in range(n):
            if self.model.is_byte(i):
                self.width[i] = (int(self.model.id_to_piece(i)[3:5], 16) & 0xC0) != 0x80
            elif not self.model.is_control(i):
                piece = self.model.id_to_piece(i)
                self.width[i] = len(piece)
                if not self.model.is_unknown(i):
                    self.joined.update(piece[k : k + 2] for k in range(len(piece) - 1))

    def stable(self, text: str, at: int) -> bool:
        return text[at - 1 : at + 1].replace(" ", SPACE) not in self.joined

    def ends(self, text: str, begin: int, end: int) -> np.ndarray:
        """Offsets in text at which tokens of text[begin:end] end, the model's leading mark left out."""
        ids = np.asarray(self.model.encode(text[begin:end]), np.int64)
        # a later byte of a code point has no width: its end is that of the first
        return np.cumsum(self.width[ids]) - 1 + begin

    def count(self, text: str) -> int:
        if len(text) <= self.chunk:
            return len(self.model.encode(text))
        total, begin, kept_from = 0, 0, None
        end = min(self.chunk, len(text))
        ends = self.ends(text, 0, end)
        while end < len(text):
            overlap, cut = self.overlap, None
            while end < len(text):
                start = max(begin, end - overlap)
                nxt = min(start + self.chunk, len(text))
                following = self.ends(text, start, nxt)
                here, there = set(ends.tolist()), set(following.tolist())
                # not the edges of the overlap: there the cut itself makes a boundary
                cut = next((p for p in range(max(start + 1, (kept_from or 0) + 1), end) if p in here and p in there and self.stable(text, p)), None)
                if cut is not None:
                    break
                # no agreement: the first chunk grows too, so the overlap does
                self.widened += 1
                end = min(end + overlap, len(text))
                overlap *= 2
                ends = self.ends(text, begin, end)
            if cut is None:  # the chunk has grown to the end of the document
                break
            total += int(np.count_nonzero(ends <= cut)) - (0 if kept_from is None else int(np.count_nonzero(ends <= kept_from)))
            begin, end, ends, kept_from = start, nxt, following, cut
        return total + len(ends) - (0 if kept_from is None else int(np.count_nonzero(ends <= kept_from)))


@lru_cache(maxsize=4)
def counter(path: str, chunk: int, overlap: int) -> PieceCounter:
    return PieceCounter(path, chunk, overlap)


def token_counts(docs: DataFrame, model: str, limit: int = 4096, chunk: int = 16384, overlap: int = 128) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs (doc_id, text; other columns are left out).

    A null text counts as empty: 0 bytes, 0 tokens, not over the limit. Rows with equal or null ids are all
    counted; an empty table gives none. No shuffle: one pass over the scan's partitions.
    """

    @F.arrow_udf("long")
    def tokens(texts: pa.Array) -> pa.Array:
        count = counter(model, chunk, overlap).count
        return pa.array([count(t.as_py()) for t in texts], pa.int64())

    text = F.coalesce(F.col("text"), F.lit(""))
    return (
        docs.select("doc_id", text.alias("text"))
        .select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), tokens("text").alias("n_tokens"))
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
