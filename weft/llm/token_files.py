"""Token-id files: one zstandard frame per document with a shared dictionary.

A shard file holds documents in ascending id order:

    magic "WFT1" | frames, one per document | index | footer

Each frame is the document's ids as little-endian unsigned integers (16 or 32 bits, by the vocabulary), compressed
with the dictionary. The index has for each document its id, the frame's offset and length and the number of ids, as
four little-endian int64 columns. The footer is a JSON object (number of documents, offset of the index, bytes an id,
SHA-256 of the dictionary) followed by its length as int32. One short document is thus read with two small reads.

The dictionary is trained on the serialized ids of a bounded sample and is written beside the shards under its hash.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.bpe import byte_letters
from weft.llm.common import batches, fresh_dir

MAGIC = b"WFT1"
#: Entries of a worker's tables of words; beyond it a table starts anew, and the one before is kept to look words up in.
TABLE = 400_000


class ByteBpe:
    """Ids of texts by the tokenizers library, with a table of what it gave for text between single spaces.

    A single space or line feed between two characters that aren't white space always begins a new token of the byte-level
    pattern (a token holds at most one leading space, and such a line feed is one by itself), so the ids of a text are those
    of its parts, each with its space or line feed, side by side. Texts with other runs of white space, and those with
    special tokens, go to the library whole. A new part of letters alone is one piece of the pattern, so the library's model
    gets it without the steps before.
    """

    #: Latin letters, one code point each, and marks that are a run of their own in the pattern. (An apostrophe may begin a contraction.)
    plain = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+)([-.,;:!?#$%&*+/=^_|~()\\[\\]{}@\"]*)").fullmatch

    def __init__(self, path: str, end: int | None = 0):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.model = self.lib.model.tokenize
        self.word = np.dtype("<u2" if self.lib.get_vocab_size() <= 1 << 16 else "<u4")
        self.end = b"" if end is None else np.array([end], "<u4").tobytes()
        self.letters = dict(enumerate(byte_letters()))
        #: Ids of a part with its space before it, and of one that begins a text or line.
        self.table, self.heads = Parts(self, " "), Parts(self, "")
        self.tails: dict[str, bytes] = {"": b"", "\n": self.raw("\n")}

    def raw(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def part(self, p: str, table: Parts) -> bytes | None:
        """Ids of a new part of a table: those of its word and of the marks after it, or of its lines; None if a text with it goes to the library whole."""
        if m := self.plain(p):
            core, tail = m.groups()
            if tail:
                if tail not in self.tails:
                    self.tails[tail] = self.raw(tail)
                return table[core] + self.tails[tail]
            piece = core if core.isascii() else core.encode().decode("latin-1").translate(self.letters)
            return array("I", [t.id for t in self.model("Ġ" + piece if table.space else piece)]).tobytes()
        if not p or p[0].isspace() or p[-1].isspace() or "<|" in p:
            return None
        if "\n" in p:
            first, *rest = p.split("\n")
            each = [table[first], *map(self.heads.__getitem__, rest)]
            return None if None in each else self.tails["\n"].join(each)
        return self.raw(table.space + p)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, the end id last."""
        if len(self.tails) > TABLE:
            self.tails = {"": b"", "\n": self.tails["\n"]}
        out = []
        for t in texts:
            table, heads = self.table.trimmed(), self.heads.trimmed()
            head, *parts = t.split(" ")
            try:
                out.append(heads[head] + b"".join(map(table.__getitem__, parts)) + self.end)
            except TypeError:  # a part of it has None
                out.append(self.raw(t) + self.end)
        return out


class Parts(dict):
    """A table of parts that makes missing entries, and looks for them in the table before, of which it is rid at times."""

    def __init__(self, code: ByteBpe, space: str):
        self.code, self.space, self.before = code, space, {}

    def __missing__(self, p: str) -> bytes | None:
        ids = self[p] = self.before.get(p) or self.code.part(p, self)
        return ids

    def trimmed(self) -> Parts:
        """Itself, anew if it has more than TABLE entries."""
        if len(self) > TABLE:
            self.before = dict(self)
            self.clear()
        return self


@lru_cache(maxsize=2)
def encoder(path: str, end: int | None) -> ByteBpe:
    return ByteBpe(path, end)


def write_shard(ids: list[int], docs: list[bytes], dictionary: bytes, word: np.dtype, level: int) -> bytes:
    """A shard's bytes. docs: ids as little-endian unsigned 32-bit integers."""
    import zstandard

    z = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    out, at, rows = [MAGIC], len(MAGIC), []
    for i, raw in zip(ids, docs):
        frame = z.compress(np.frombuffer(raw, "<u4").astype(word).tobytes())
        rows.append((i, at, len(frame), len(raw) // 4))
        out.append(frame)
        at += len(frame)
    out.append(np.array(rows, "<i8").reshape(-1, 4).T.tobytes())
    footer = json.dumps({"n": len(rows), "index": at, "word": word.itemsize, "dictionary": hashlib.sha256(dictionary).hexdigest()}).encode()
    return b"".join([*out, footer, len(footer).to_bytes(4, "little")])


class Shard:
    """A shard's documents, each by its place; only the index and the frames asked for are decoded."""

    def __init__(self, data: bytes, dictionary: bytes):
        import zstandard

        n = int.from_bytes(data[-4:], "little")
        foot = json.loads(bytes(data[-4 - n : -4]))
        if bytes(data[:4]) != MAGIC or foot["dictionary"] != hashlib.sha256(dictionary).hexdigest():
            raise ValueError("not a token file, or another dictionary")
        self.data, self.word = data, np.dtype(f"<u{foot['word']}")
        self.ids, self.at, self.size, self.tokens = np.frombuffer(data, "<i8", 4 * foot["n"], foot["index"]).reshape(4, -1)
        self.z = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def __getitem__(self, k: int) -> np.ndarray:
        raw = self.z.decompress(self.data[self.at[k] : self.at[k] + self.size[k]], max_output_size=int(self.tokens[k]) * self.word.itemsize)
        return np.frombuffer(raw, self.word).astype("<u4")


def trained(docs: DataFrame, tokenizer: str, end: int | None, sample: int, size: int) -> bytes:
    """A zstandard dictionary from the serialized ids of `sample` documents, those with the least hash of the id.

    Texts and training stay on one executor; only the dictionary (at most `size` bytes) comes to the driver. Where
    the sample is too small to train on, the dictionary is empty and frames are plain.
    """

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        code = encoder(tokenizer, end)
        ids = [np.frombuffer(x, "<u4").astype(code.word).tobytes() for b in batches for x in code.encode([t or "" for t in b.column(0).to_pylist()])]
        try:
            out = zstandard.train_dictionary(size, ids).as_bytes()
        except zstandard.ZstdError:
            out = b""
        yield pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], ["dictionary"])

    # ids first, from the id alone; the scan for their texts is dealt as any other, and what it finds goes to one task
    ids = [r[0] for r in docs.filter("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    few = docs.filter(F.col("doc_id").isin(ids))
    rows = few.select("text").repartition(1).mapInArrow(train, "dictionary binary").collect() if ids else []
    return next((bytes(r[0]) for r in rows if r[0]), b"")


def token_files(docs: DataFrame, tokenizer: str, out: str | None = None, end: int | None = 0, level: int = 3, shard_bytes: int = 16 << 20, sample: int = 1000, dict_size: int = 1 << 16) -> str:
    """Write docs (doc_id, text; other columns are left out) as token files in a folder that all executors share.

    Documents stand in ascending doc_id order over the shards (null ids first; repeated ids by text), dealt by range,
    so that no task gets more than its share. Shards are closed at shard_bytes of ids. Each attempt of a task writes
    files of names of its own; the manifest (Parquet, written by Spark's committer) names those that count. A null
    text is empty and has the end id alone. Returns the folder; an empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    out = out or fresh_dir(spark, "tokens")
    docs = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    dictionary = trained(docs, tokenizer, end, sample, dict_size)
    name = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(name, bytearray(dictionary))], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{out}/dictionary")
    shared = spark.sparkContext.broadcast(dictionary)  # at most dict_size bytes
    folder = f"{out}/shards"
    spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(folder))

    def write(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        code, part, k = encoder(tokenizer, end), TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        raws: list[bytes] = []
        held = 0

        def closed() -> pa.RecordBatch:
            nonlocal ids, raws, held, k
            store, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
            file = f"{part:06d}-{k:06d}-{uuid.uuid4().hex}.wft"
            with store.open_output_stream(f"{path}/{file}") as f:
                f.write(write_shard([-1 << 63 if i is None else i for i in ids], raws, shared.value, code.word, level))
            row = pa.RecordBatch.from_pydict({"part": [part], "seq": [k], "file": [file], "docs": [len(ids)], "tokens": [held // 4]}, pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))
            ids, raws, held, k = [], [], 0, k + 1
            return row

        for b in arrived:
            keys = iter(b.column(0).to_pylist())
            for raw in (x for some in batches(b.column(1)) for x in code.encode(some)):
                ids.append(next(keys))
                raws.append(raw)
                held += len(raw)
                if held >= shard_bytes:
                    yield closed()
        if ids:
            yield closed()

    dealt = docs.repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    dealt.mapInArrow(write, "part long, seq long, file string, docs long, tokens long").write.parquet(f"{out}/manifest")
    return out


def read_token_files(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read back from a folder of token files.

    start: ids of all documents before it. Only one row per shard takes part in the running sum; a file that the
    manifest doesn't name (of an attempt that was lost) is not read.
    """
    dictionary = spark.sparkContext.broadcast(bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"]))
    manifest = spark.read.parquet(f"{path}/manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    places = manifest.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wft").load(f"{path}/shards")
    held = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").join(places, "file").select("content", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content, start in zip(b.column(0), b.column(1).to_pylist()):
                shard = Shard(memoryview(content.as_buffer()), dictionary.value)
                crc = [zlib.crc32(shard[k].tobytes()) for k in range(len(shard.ids))]
                n = shard.tokens.astype(np.int64)
                first = start + np.cumsum(n) - n
                ids = pa.array(shard.ids, pa.int64(), mask=shard.ids == -1 << 63)
                yield pa.RecordBatch.from_arrays([ids, pa.array(first), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return held.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
