"""SimHash near-duplicates by pigeonhole blocks.

Two uses of one scheme: split fingerprints into blocks so that close pairs share some, join on the shared blocks, verify
the Hamming distance, and take connected components of the links.

`linked` takes 64-bit fingerprints over 3-word shingles and links at 2 or fewer differing bits. Of four blocks of 16 bits
two must then be equal, so six tables, each keyed by two blocks (32 bits), hold every link. Buckets with many
fingerprints aren't paired: two fingerprints differ in at most 2 bits exactly if some value is within one bit of both, so
the members of large buckets are linked through those values, 65 for each fingerprint, to the least member of each value.

`near_copies` finds documents whose 5-word shingle sets have a Jaccard similarity of 0.8 or more. That lies 27 degrees apart,
too far for a pigeonhole over 64 bits, and sets of words lie further apart still where an edit is in one piece. Candidates
therefore share one of 26 bands of 6 minima over the shingles: a pair at 0.8 does with probability 1 - (1 - 0.8^6)^26 = 0.9996,
whatever was edited. A 512-bit fingerprint over the shingles leaves out pairs far below, and the shingles themselves decide.
Members of large buckets are compared by how they differ from a hub, so edits of one template aren't paired with each other.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.common import stored
from weft.llm.components import components

ONES = np.uint64(0x0101010101010101)


def votes(h: np.ndarray) -> np.ndarray:
    """For (n, lanes) hashes, how many of the n have each bit set: (lanes, 8 bytes, 8 bits).

    Eight counters of 8 bits ride in one word, over at most 255 rows at a time.
    """
    starts = np.arange(0, len(h), 255)
    out = np.empty((h.shape[1], 8, 8), np.int64)
    for j in range(8):
        part = np.add.reduceat((h >> np.uint64(j)) & ONES, starts, axis=0)
        out[:, :, j] = part.view(np.uint8).reshape(len(starts), h.shape[1], 8).sum(axis=0, dtype=np.int64)
    return out


def majority(h: np.ndarray) -> bytes:
    """The fingerprint of (n, lanes) hashes, little-endian: a bit is 1 if set in over half of them; zero without hashes."""
    if not len(h):
        return bytes(8 * h.shape[1])
    return np.packbits(votes(h) * 2 > len(h), axis=2, bitorder="little").tobytes()


def shingles(words: list[bytes], k: int) -> list[bytes]:
    """Runs of k words joined by a space, repeats included; a shorter sequence is one shingle, none has none."""
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(k)))))


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def fingerprint(text: str, k: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint over k-word shingles, as a signed integer."""
    h = np.array([xxhash.xxh64_intdigest(s, seed) for s in shingles(words_of(text), k)], np.uint64)
    return int.from_bytes(majority(h.reshape(-1, 1)), "little", signed=True)


@F.arrow_udf(T.LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint(t.as_py() or "") for t in texts], pa.int64())


def block_keys(fp: Column, radius: int = 2, blocks: int = 4) -> Column:
    """Keys of the tables that every pair within radius shares one of: each choice of blocks - radius blocks."""
    width = 64 // blocks
    keys = []
    for t, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << width) - 1) << (width * b) for b in chosen)
        keys.append(F.struct(F.lit(t).alias("t"), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("key")))
    return F.array(*keys)


def links(fps: DataFrame, large: int = 64) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) at 2 or fewer differing bits.

    All are found among themselves for buckets of up to `large` members; of larger buckets enough are given to connect
    what is linked. Work is in proportion to the fingerprints in both cases.
    """
    rows = fps.select("fp", F.explode(block_keys(F.col("fp"))).alias("b")).select("fp", "b.t", "b.key")
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    held = stored(rows.join(sizes, ["t", "key"]), "blocks")
    some = held.filter(F.col("n") <= large).select("t", "key", "fp")
    a, b = some.withColumnRenamed("fp", "u"), some.withColumnRenamed("fp", "v")
    near = a.join(b, ["t", "key"]).filter((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2)).select("u", "v")
    many = held.filter(F.col("n") > large).select("fp").distinct()
    flips = F.array(F.lit(0), *[F.lit(1 << b if b < 63 else -(1 << 63)) for b in range(64)])
    by = many.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m.cast("long")))).alias("at"))
    least = by.groupBy("at").agg(F.min("fp").alias("u"), F.count("*").alias("n")).filter("n > 1").select("at", "u")
    spread = by.join(least, "at").filter("fp <> u").select("u", F.col("fp").alias("v"))
    return near.unionByName(spread).distinct()


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id of every row of docs (doc_id, text).

    Other columns are left out. A null text is empty; texts without words have fingerprint zero and are linked like any
    other. component_id is the least id among the documents that links reach; null ids don't count, and a component of
    null ids alone has a null. Copies share a fingerprint, so they are never paired: links are made between distinct
    fingerprints and joined back.
    """
    fp = stored(docs.select("doc_id", fingerprints("text").alias("fp")), "fingerprints")
    distinct = stored(fp.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    to = components(links(distinct)).withColumnRenamed("u", "fp")
    root = distinct.join(to, "fp", "left").select("fp", "first", F.coalesce("m", "fp").alias("root"))
    least = root.groupBy("root").agg(F.min("first").alias("component_id"))
    place = root.join(least, "root").select("fp", "component_id")
    return fp.join(place, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Bands of minima, and minima in each.
BLOCKS, ROWS = 26, 6
LANES = 8
SPREAD = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) % (1 << 64) for i in range(LANES)], np.uint64)
_drawn = np.random.default_rng(42)
TIMES, PLUS = (_drawn.integers(0, 1 << 32, BLOCKS * ROWS, np.uint32) for _ in range(2))
TIMES |= np.uint32(1)


def hashes_of(text: str, k: int = 5) -> np.ndarray:
    """Hashes of the distinct shingles."""
    return np.unique(np.array([xxhash.xxh3_64_intdigest(s) for s in set(shingles(words_of(text), k))], np.uint64))


def wide(text: str) -> tuple[list[int], list[int]]:
    """(26 band keys, 8 words of the shingle fingerprint)."""
    own = hashes_of(text)
    least = np.full(BLOCKS * ROWS, (1 << 32) - 1, np.uint32)
    short = (own >> np.uint64(32)).astype(np.uint32)[:, None]
    for at in range(0, len(short), 1024):  # bounds what a long text takes
        np.minimum(least, (short[at : at + 1024] * TIMES + PLUS).min(0), out=least)
    bands = least.reshape(BLOCKS, ROWS)
    keys = [xxhash.xxh3_64_intdigest(x.tobytes()) for x in bands]
    h = own[:, None] * SPREAD
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.array(keys, np.uint64).view(np.int64).tolist(), np.frombuffer(majority(h), np.int64).tolist()


@F.arrow_udf(T.StructType().add("blocks", T.ArrayType(T.LongType())).add("fp", T.ArrayType(T.LongType())))
def wides(texts: pa.Array) -> pa.Array:
    found = [wide(t.as_py() or "") for t in texts]
    return pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.list_(pa.int64())), pa.array([x[1] for x in found], pa.list_(pa.int64()))], ["blocks", "fp"])


def digest() -> Column:
    """16 bytes that stand for a text; a null text is empty."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def radius_of(similarity: float, bits: int) -> int:
    """Differing bits that two shingle sets at that Jaccard similarity practically never exceed: the mean and 5 deviations.

    Sets of few shingles lie further apart than the angle says: 3 bits in 16 for 4 shingles and one more.
    """
    p = max(math.acos(2 * similarity / (1 + similarity)) / math.pi, 3 / 16)
    return round(bits * p + 5 * math.sqrt(bits * p * (1 - p)))


@F.arrow_udf(T.BinaryType())
def shingle_sets(texts: pa.Array) -> pa.Array:
    return pa.array([hashes_of(t.as_py() or "").tobytes() for t in texts], pa.binary())


def alike(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two shingle sets; 1 for two empty ones."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


@F.arrow_udf(T.DoubleType())
def jaccard(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([alike(x.as_py(), y.as_py()) for x, y in zip(a, b)], pa.float64())


def sets_of(docs: DataFrame, facts: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, own): the shingle sets of the digests in classes (cls), written out; only their texts are read."""
    key = F.coalesce("doc_id", F.lit(-1)).alias("key")
    # one row stands for all copies of a text
    need = facts.join(classes.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(F.min(F.coalesce("doc_id", F.lit(-1))).alias("key"))
    texts = docs.select(key, digest().alias("cls"), "text").join(need, ["key", "cls"], "left_semi").dropDuplicates(["cls"])
    return stored(texts.select("cls", shingle_sets("text").alias("own")), "sets")


def confirmed(pairs: DataFrame, docs: DataFrame, facts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of digests whose shingle sets reach the similarity; only texts of pairs are read."""
    sets = sets_of(docs, facts, pairs.select(F.explode(F.array("u", "v")).alias("cls")))
    both = pairs.join(sets.select(F.col("cls").alias("u"), F.col("own").alias("x")), "u").join(sets.select(F.col("cls").alias("v"), F.col("own").alias("y")), "v")
    return both.filter(jaccard("x", "y") >= similarity).select("u", "v")


@F.arrow_udf(T.StructType().add("n", T.LongType()).add("shared", T.LongType()).add("m", T.LongType()).add("extra", T.ArrayType(T.LongType())))
def beside(own: pa.Array, hub: pa.Array) -> pa.Array:
    """Of two shingle sets: the first's size, what they share, the second's size, what only the first has."""
    n, shared, m, extra = [], [], [], []
    for a, b in zip(own, hub):
        x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
        more = np.setdiff1d(x, y, assume_unique=True)
        n.append(len(x))
        shared.append(len(x) - len(more))
        m.append(len(y))
        extra.append(more.view(np.int64))
    parts = [pa.array(v, pa.int64()) for v in (n, shared, m)] + [pa.array(extra, pa.list_(pa.int64()))]
    return pa.StructArray.from_arrays(parts, ["n", "shared", "m", "extra"])


def apart(x: str, y: str) -> Column:
    """Differing bits of two wide fingerprints."""
    return sum((F.bit_count(F.element_at(x, i + 1).bitwiseXOR(F.element_at(y, i + 1))) for i in range(LANES)), F.lit(0))


def crowded(rows: DataFrame) -> DataFrame:
    """The members (b, cls) of buckets of two and more, with the bucket's size n."""
    return rows.join(rows.groupBy("b").agg(F.count("*").alias("n")).filter("n > 1"), "b")


def hubs_of(held: DataFrame) -> DataFrame:
    """(b, hub): of each bucket the member whose buckets are largest together, which is likest to most others."""
    score = held.groupBy("cls").agg(F.sum("n").alias("score"))
    return held.join(score, "cls").groupBy("b").agg(F.max(F.struct("score", "cls")).alias("top")).select("b", F.col("top.cls").alias("hub"))


def within_hub(members: DataFrame, similarity: float, radius: int) -> DataFrame:
    """Pairs (u, v) of members that can reach the similarity by shingles of their hub alone.

    Such a pair shares at most the lesser of what its two texts share with the hub, so each has a greatest size (`most`)
    of a partner. If both reach the hub itself, they are linked already; if u doesn't, its partners are smaller than the
    hub. Pairs meet by the ranges of both sizes, in steps of a sixteenth of the hub.
    """
    step = F.greatest(F.lit(1.0), F.col("m") / 16)
    cell = lambda n: F.floor(n / step)
    sized = members.withColumn("most", F.floor(F.col("shared") * ((1 + similarity) / similarity) - F.col("n") + 1e-6)).withColumn("fewest", F.floor(F.col("n") * similarity))
    sized = sized.filter("most >= fewest").withColumn("own", cell(F.col("n"))).withColumn("other", F.explode(F.sequence(cell(F.col("fewest")), cell(F.col("most")))))
    facts = F.struct("cls", "c", "n", "most", "fp")
    a = sized.filter("most < m").select("hub", F.col("own").alias("p"), F.col("other").alias("q"), facts.alias("a"))
    b = sized.filter("n < m").select("hub", F.col("other").alias("p"), F.col("own").alias("q"), facts.alias("b"))
    met = a.join(b, ["hub", "p", "q"]).filter((F.col("a.c") != F.col("b.c")) & (F.col("b.n") <= F.col("a.most")) & (F.col("a.n") <= F.col("b.most")) & (apart("a.fp", "b.fp") <= radius))
    return met.select(F.least("a.cls", "b.cls").alias("u"), F.greatest("a.cls", "b.cls").alias("v"))


def beyond_hub(members: DataFrame, similarity: float) -> DataFrame:
    """Buckets (b, cls): members of a hub that share a shingle which it hasn't.

    Of each member's shingles beyond the hub, the rarest in the group first, only so many count that a pair which shares
    none of them keeps too few in common to reach the similarity.
    """
    rows = members.select("hub", "cls", "n", F.explode("extra").alias("s")).withColumn("f", F.count("*").over(Window.partitionBy("hub", "s")))
    rank = F.row_number().over(Window.partitionBy("hub", "cls").orderBy("f", "s"))
    rare = rows.withColumn("rank", rank).filter(F.col("rank") <= F.floor(F.col("n") * (1 - similarity) + 1e-6) + 1)
    return rare.filter("f > 1").select(F.xxhash64("hub", "s").alias("b"), "cls").distinct()


def near_copies(docs: DataFrame, similarity: float = 0.8, large: int = 64) -> DataFrame:
    """(doc_id, cls, root) of every distinct pair of id and text: cls is a digest of the text, root its group's.

    Exact copies are one vertex, so a text's copies are never paired. Members of a bucket are first linked to its hub; then
    only members that this leaves in different components are looked at. In buckets of up to `large` members they are
    compared pairwise. A larger bucket is a template and its edits, most of whose pairs lie below the similarity; its members
    are compared by how they differ from the hub: a pair reaches the similarity either by shingles of the hub alone, which
    the sizes bound (`within_hub`), or shares a rare shingle beyond it (`beyond_hub`), and these make the buckets of
    the next level, with twice the limit. Both ways are exact: no link between different components is lost. Null texts are
    empty; all texts without words are copies.
    """
    facts = stored(docs.select("doc_id", digest().alias("cls"), wides("text").alias("w")).select("doc_id", "cls", "w.*"), "wide")
    ids = facts.select("doc_id", "cls").distinct()
    one = stored(facts.groupBy("cls").agg(F.first("blocks").alias("blocks"), F.first("fp").alias("fp")), "classes")
    fps = one.select("cls", "fp")
    radius = radius_of(similarity, 64 * LANES)
    held = stored(crowded(one.select("cls", F.posexplode("blocks").alias("t", "key")).select(F.xxhash64("t", "key").alias("b"), "cls")), "blocks")
    near = to = None
    pairs = []
    while True:
        # each member against the hub of its buckets; after the first level only in large ones
        linking = held if near is None else held.filter(F.col("n") > large)
        if near is None or not linking.isEmpty():
            hubs = stored(hubs_of(linking), "hubs")
            ends = linking.join(hubs, "b").select(F.col("cls").alias("u"), F.col("hub").alias("v")).filter("u <> v").distinct()
            met = ends.join(fps.select(F.col("cls").alias("u"), F.col("fp").alias("x")), "u").join(fps.select(F.col("cls").alias("v"), F.col("fp").alias("y")), "v").filter(apart("x", "y") <= radius)
            found = stored(confirmed(stored(met.select("u", "v"), "candidates"), docs, facts, similarity), "near")
            near = found if near is None else near.unionByName(found)
            to = components(near).withColumnRenamed("u", "cls")
        # then, in buckets where that left several components, members of different ones against each other
        part = held.join(to, "cls", "left").select("b", "n", "cls", F.coalesce("m", "cls").alias("c"))
        split = part.groupBy("b").agg(F.min("c").alias("least"), F.max("c").alias("most")).filter("least <> most").select("b")
        rest = stored(part.join(split, "b").join(fps, "cls"), "rest")
        few = rest.filter(F.col("n") <= large)
        a = few.select("b", F.col("cls").alias("u"), F.col("c").alias("cu"), F.col("fp").alias("x"))
        b = few.select("b", F.col("cls").alias("v"), F.col("c").alias("cv"), F.col("fp").alias("y"))
        pairs.append(a.join(b, "b").filter((F.col("cu") < F.col("cv")) & (apart("x", "y") <= radius)).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))
        many = rest.filter(F.col("n") > large)
        if many.isEmpty():
            break
        # buckets of one hub are one group
        group = stored(many.join(hubs, "b").select("hub", "cls", "c", "fp").dropDuplicates(["hub", "cls"]), "group")
        sets = sets_of(docs, facts, group.select(F.explode(F.array("hub", "cls")).alias("cls")))
        both = group.join(sets, "cls").join(sets.select(F.col("cls").alias("hub"), F.col("own").alias("base")), "hub")
        members = stored(both.select("hub", "cls", "c", "fp", beside("own", "base").alias("d")).select("hub", "cls", "c", "fp", "d.*"), "members")
        pairs.append(within_hub(members, similarity, radius))
        held = stored(crowded(beyond_hub(members, similarity)), "blocks")
        large *= 2
    across = stored(reduce(DataFrame.unionByName, pairs).distinct(), "candidates")
    across = confirmed(across, docs, facts, similarity)
    to = components(near.unionByName(across)).withColumnRenamed("u", "cls")
    return ids.join(to, "cls", "left").select("doc_id", "cls", F.coalesce("m", "cls").alias("root"))


def one_of_each(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """docs with one document of each group of near copies: the least id (a null id last), then the least digest.

    Whole rows, all columns as they were; of repeated rows with the same id and text one stays.
    """
    names = docs.columns
    # a struct keeps the row's own columns clear of ours
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "doc_id", digest().alias("cls"))
    groups = near_copies(docs, similarity)
    kept = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "cls")).alias("k")).select("k.doc_id", "k.cls")
    stay = whole.withColumn("key", F.coalesce("doc_id", F.lit(-1))).join(kept.select(F.coalesce("doc_id", F.lit(-1)).alias("key"), "cls"), ["key", "cls"], "left_semi")
    return stay.dropDuplicates(["key", "cls"]).select(*[F.col(f"row.`{c}`").alias(c) for c in names])
