"""SimHash document fingerprints, in DataFrame operations only.

The terms of a text are its pairs of neighbouring words, lower case, repeats included; a term weighs 1 to 4, by its
length, so that pairs of short function words count least. Each term's 64-bit hash votes on 64 signed bits with its
weight; a bit of the fingerprint is set where the ones outweigh the zeros. Two counters of 32 bits ride in one sum, so
32 sums carry the votes, and one explode of the terms feeds them within a task.

`within` finds all fingerprints within a Hamming radius by permuted block tables: fingerprints are split into blocks,
each table is keyed by one choice of as many blocks as any pair within the radius must share, and candidates that meet
in a table are verified.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import stored

LOW = (1 << 63) * -1


def terms(text: Column) -> Column:
    """Array of (h, w): hash and weight of each pair of neighbouring words; the last word stands alone as well."""
    words = F.filter(F.split(F.translate(F.lower(text), "\n\t\r", "   "), " "), lambda w: w != "")
    shifted = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    return F.zip_with(
        words, shifted,
        lambda a, b: F.struct(F.xxhash64(a, b).alias("h"), F.least(F.lit(4), 1 + F.shiftright(F.length(a) + F.coalesce(F.length(b), F.lit(0)), 2)).cast("long").alias("w")),
    )


def tally(h: Column, w: Column) -> list[Column]:
    """The sums that carry the votes: bit j in the low half of sum j, bit j + 32 in its high half; and the weight of all."""
    return [F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(0x100000001)) * w).alias(f"s{j}") for j in range(32)] + [F.sum(w).alias("all")]


def decided() -> Column:
    """The fingerprint from the sums; zero without terms."""
    def bit(j: int) -> Column:
        votes = F.col(f"s{j}").bitwiseAND(F.lit(0xFFFFFFFF)) if j < 32 else F.shiftrightunsigned(F.col(f"s{j - 32}"), 32)
        return F.when(votes * 2 > F.col("all"), F.lit((1 << j) if j < 63 else LOW)).otherwise(F.lit(0)).cast("long")

    out = bit(0)
    for j in range(1, 64):
        out = out.bitwiseOR(bit(j))
    return out


def shown(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Estimated cosine of the weighted term vectors of two fingerprints, 0 to 1; equal fingerprints give 1."""
    return F.greatest(F.lit(0.0), F.cos(F.bit_count(a.bitwiseXOR(b)) * F.lit(3.141592653589793 / 64)))


def in_order(docs: DataFrame, rows: int = 1000) -> DataFrame:
    """docs (doc_id, text) dealt into buckets of about `rows` ascending ids, with each row's place and following text.

    Columns bucket, place, ghost, doc_id, text, next_text. Bounds are quantiles of the ids, at most 1,024 of them, with
    equal steps between two. The first row of each bucket is copied to the end of the bucket before (that of the first to
    the end of the last) as a ghost, so every row finds its follower in its own bucket, and texts are shuffled once.
    Null ids come first; rows with one id stand in order of their text. A single row follows itself.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(LOW)).cast("long")
    docs = docs.select(key.alias("k"), "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n = docs.count()
    quantiles = max(1, min(1024, n // rows))
    steps = max(1, n // (rows * quantiles))
    bounds = (docs.select(F.percentile_approx("k", [i / quantiles for i in range(1, quantiles)] or [0.5], 10_000)).first()[0] or []) if quantiles > 1 else []
    bounds = sorted(set(bounds))
    edges = F.array(*[F.lit(b).cast("long") for b in bounds]).cast("array<long>")
    q = F.size(F.filter(edges, lambda b: b <= F.col("k")))
    lo, hi = F.get(edges, q - 1).cast("double"), F.get(edges, q).cast("double")
    step = F.when((F.lit(steps) > 1) & lo.isNotNull() & hi.isNotNull(), F.floor((F.col("k") - lo) / (hi - lo) * steps)).otherwise(0)
    held = docs.withColumn("bucket", q.cast("long") * steps + F.least(F.lit(steps - 1), F.greatest(F.lit(0), step)).cast("long"))
    firsts = stored(held.groupBy("bucket").agg(F.min("k").alias("k")), "firsts")  # a row per bucket
    order = Window.orderBy("bucket")
    last = F.max("bucket").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = stored(firsts.select("k", F.coalesce(F.lag("bucket").over(order), last).alias("bucket")), "before")
    ghosts = docs.select("k", "text").join(before, "k").groupBy("k", "bucket").agg(F.min("text").alias("text")).select("bucket", F.lit(True).alias("ghost"), "k", F.lit(None).cast("long").alias("doc_id"), "text")
    rows_ = held.select("bucket", F.lit(False).alias("ghost"), "k", F.col("doc_id").cast("long").alias("doc_id"), "text").unionByName(ghosts)
    along = Window.partitionBy("bucket").orderBy("ghost", "k", "text")
    return rows_.select("bucket", F.row_number().over(along).alias("place"), "ghost", "doc_id", "text", F.lead("text").over(along).alias("next_text"))


def within(all_fps: DataFrame, queries: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(q, fp): every fp of all_fps (distinct fp) within radius bits of each q of queries (distinct q), itself included.

    Of `blocks` blocks a pair shares at least blocks - radius; each choice of that many is a table. Exact: no bucket is
    capped.
    """
    cut = [64 * i // blocks for i in range(blocks + 1)]

    def keyed(df: DataFrame, c: str) -> DataFrame:
        keys = []
        for t, chosen in enumerate(combinations(range(blocks), blocks - radius)):
            mask = sum((1 << cut[b + 1]) - (1 << cut[b]) for b in chosen)
            keys.append(F.struct(F.lit(t).alias("t"), F.col(c).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("key")))
        return df.select(c, F.explode(F.array(*keys)).alias("b")).select(c, "b.t", "b.key")

    met = keyed(all_fps, "fp").join(keyed(queries, "q"), ["t", "key"])
    return met.filter(F.bit_count(F.col("q").bitwiseXOR(F.col("fp"))) <= radius).select("q", "fp").distinct()


def fingerprinted(docs: DataFrame, radius: int = 3, every: int = 50) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_within of every row.

    docs: doc_id, text; other columns are left out. The edited text has its last quarter (floor) replaced by as many
    first code points of the next document. n_within: for ids divisible by `every`, the number of rows, itself included,
    whose fingerprint is within radius bits; null for others. A null text is empty, has fingerprint zero and keeps being
    empty when edited.
    """
    n, quarter = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring("text", 1, n - quarter), F.substring("next_text", F.lit(1), quarter))
    rows = in_order(docs).select("bucket", "place", "ghost", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    both = rows.select("bucket", "place", "ghost", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("sha"), F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))).alias("x"))
    both = both.filter("not ghost or x.kind = 0")
    cast = both.select("bucket", "place", "ghost", "doc_id", "n_chars", "sha", "x.kind", F.explode_outer(terms(F.col("x.t"))).alias("v"))
    # all keys include the bucket, by which the rows are dealt already: no shuffle from here on
    fp = cast.groupBy("bucket", "place", "ghost", "doc_id", "n_chars", "sha", "kind").agg(*tally(F.col("v.h"), F.col("v.w"))).select("bucket", "place", "ghost", "doc_id", "n_chars", "sha", "kind", decided().alias("fp"))
    of = lambda k: F.max(F.when(F.col("kind") == k, F.col("fp")))
    one = fp.groupBy("bucket", "place", "ghost", "doc_id", "n_chars", "sha").agg(of(0).alias("fp"), of(1).alias("efp"))
    nxt = F.lead("fp").over(Window.partitionBy("bucket").orderBy("place"))
    done = stored(one.withColumn("nfp", nxt).filter("not ghost").select("bucket", "place", "doc_id", "n_chars", "sha", "fp", "efp", "nfp"), "fingerprints")
    asked = done.filter(F.col("doc_id") % every == 0).select("bucket", "place", F.col("fp").alias("q"))
    sizes = done.groupBy("fp").agg(F.count("*").alias("n"))
    found = within(sizes.select("fp"), asked.select("q").distinct(), radius).join(sizes, "fp").groupBy("q").agg(F.sum("n").alias("n_within"))
    counts = asked.join(found, "q").select("bucket", "place", "n_within")
    return done.join(counts, ["bucket", "place"], "left").select(
        "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), shown(F.col("fp")).alias("fingerprint"), shown(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("nfp")).alias("near_next"), "n_within",
    )
