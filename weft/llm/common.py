"""Shared helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark (any store that Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, empty when null."""
    return F.coalesce(F.col(column), F.lit(""))


def remainder(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="weft-"))
    return sc.getCheckpointDir().rstrip("/")


def fresh_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/weft-{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df as a written table in the shared folder: lineage ends there, and a lost executor loses nothing."""
    path = fresh_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def batches(values, most: int = 1_000_000):
    """Lists of texts of about `most` code points together, so that a batch's lists stay small."""
    held, n = [], 0
    for v in values:
        t = v.as_py() or ""
        held.append(t)
        n += len(t)
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


#: UTF-8 bytes of ASCII and of the letters from U+00C0 to U+00FF.
PLAIN = bytes([*range(0x80), *range(0x80, 0xC0), 0xC3])


def separators(kept: str) -> bytes:
    """A table for bytes.translate: ASCII characters other than letters and those kept become spaces."""
    return bytes(b if b >= 0x80 or chr(b).isalpha() or chr(b) in kept else 0x20 for b in range(256))


def plain_words(text: str, table: bytes) -> list[str] | None:
    """Runs of letters, and of what the table keeps, in a text of ASCII and letters up to U+00FF; None for other texts."""
    raw = text.encode("utf-8", "surrogatepass")
    if len(raw) > len(text) and (raw.translate(None, PLAIN) or b"\xc3\x97" in raw or b"\xc3\xb7" in raw):  # two signs stand among the letters
        return None
    return raw.translate(table).decode().split()
