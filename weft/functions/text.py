"""Scalar functions over paths, names and file contents, in the JVM but for running sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft import model

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    return F.translate(c, UPPER, LOWER)


def like(c: Column, pattern: str) -> Column:
    """LIKE that ignores the case of A-Z; % and _ are wildcards, a backslash is itself."""
    return ascii_lower(c).like(pattern.translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    """The folder of a path, `.` at the root."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) == 1, F.lit(".")).otherwise(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"))


def detect_lang(path: Column) -> Column:
    """Label of the language by extension (case matters); null for others and for names without one."""
    ext = F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)
    table = F.create_map(*[F.lit(x) for kv in model.EXTENSIONS.items() for x in kv])
    return F.try_element_at(table, ext)


def manifest_kind(path: Column) -> Column:
    """The build system whose manifest a path is; null if none."""
    name = basename(path)
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in model.MANIFESTS.items() for x in kv]), name)
    for suffix, kind in model.MANIFEST_SUFFIXES.items():
        found = F.coalesce(found, F.when(name.endswith(suffix), F.lit(kind)))
    return found


def indexable(content: Column) -> Column:
    """Whether binary content is at most 2 MiB and has no NUL among its first 8,192 bytes."""
    return (F.octet_length(content) <= model.MAX_FILE) & ~F.contains(F.substring(content, 1, model.PROBE), F.lit(bytes(1)))


@F.arrow_udf(T.ArrayType(T.LongType()))
def line_offsets(texts: pa.Array) -> pa.Array:
    """Byte offset of each line: 0 and the place after each newline. (A running sum in Spark's own functions copies the array for every line.)"""
    found = [None if t is None else np.r_[0, np.flatnonzero(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8) == 10) + 1] for t in texts.to_pylist()]
    return pa.array(found, pa.list_(pa.int64()))


def deltas(offsets: Column) -> Column:
    """Differences of neighbours, the first kept."""
    return F.zip_with(offsets, F.concat(F.array(F.lit(0).cast("long")), F.slice(offsets, 1, F.size(offsets) - 1)), lambda a, b: a - b)


@F.arrow_udf(T.ArrayType(T.LongType()))
def undeltas(d: pa.Array) -> pa.Array:
    """Running sums of each array."""
    return pa.array([None if x is None else np.cumsum(x, dtype=np.int64) for x in d.to_pylist()], pa.list_(pa.int64()))


def byte_span(offsets: Column, size: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """[from, to) of lines start to end, both within the file."""
    lo = F.when(start < 1, F.lit(None)).otherwise(F.get(offsets, (start - 1).cast("int")))
    return F.least(F.coalesce(lo, F.lit(0)), size), F.least(F.coalesce(F.get(offsets, end.cast("int")), size), size)


def tokens(row: Column) -> Column:
    """Estimated cost of a line of output: a token for every four bytes, and one."""
    return F.floor(F.octet_length(row) / 4) + 1


def cut_line(line: Column) -> Column:
    """A line without white space at its ends, of 200 characters at most."""
    t = F.regexp_replace(line, r"^\s+|\s+$", "")
    return F.when(F.length(t) > model.LINE_CAP, F.concat(F.substring(t, 1, model.LINE_CAP), F.lit("…"))).otherwise(t)
