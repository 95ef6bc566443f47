"""Repositories as sources: files under a folder, precise indexes, git."""

from __future__ import annotations

import fnmatch
import os
import re
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft import model
from weft.functions.text import detect_lang, dirname, indexable, manifest_kind

IGNORE_FILES = (".gitignore", ".weftignore")


class Rules:
    """Ignore rules of a tree: gitignore syntax, from files anywhere in it; the last match of the deepest file decides."""

    def __init__(self, files: dict[str, str]):
        self.rules: list[tuple[str, re.Pattern, bool, bool]] = []  # folder, pattern, negated, folders only
        for path in sorted(files, key=lambda p: p.count("/")):
            base = path.rsplit("/", 1)[0] + "/" if "/" in path else ""
            for line in files[path].splitlines():
                line = line.rstrip()
                if not line or line.startswith("#"):
                    continue
                negated, line = line.startswith("!"), line.removeprefix("!")
                folder, line = line.endswith("/"), line.rstrip("/")
                anchored, line = "/" in line, line.removeprefix("/")
                self.rules.append((base, re.compile(("" if anchored else "(?:.*/)?") + self.pattern(line)), negated, folder))

    @staticmethod
    def pattern(glob: str) -> str:
        out = []
        for part in re.split(r"(\*\*/|/\*\*|\*|\?|\[[^\]]+\])", glob):
            out.append({"**/": "(?:.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}.get(part) or (fnmatch.translate(part)[4:-3] if part[:1] == "[" else re.escape(part)))
        return "".join(out)

    def ignored(self, path: str) -> bool:
        """Whether a file, or a folder above it, is ignored."""
        parts = path.split("/")
        for k in range(1, len(parts) + 1):
            at, verdict = "/".join(parts[:k]), False
            for base, pattern, negated, folder in self.rules:
                if at.startswith(base) and not (folder and k == len(parts)) and pattern.fullmatch(at[len(base) :]):
                    verdict = not negated
            if verdict:
                return True
        return False


SCANNED = "path string, content binary, size long, mtime_ns long"
NAMES = "path string, size long, mtime_ns long"


def opened(root: str):
    """(file system, folder) of a path or URI."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(root) if ":/" in root else (fs.LocalFileSystem(), os.path.abspath(root))
    return store, base.rstrip("/")


def listed(root: str, hidden: bool = False, most: int = model.MAX_FILE, only: list[str] | None = None) -> list[tuple[str, int, int]]:
    """(path, size, mtime_ns) of the files under a folder, or of those named in `only`, without ignored ones and those of over `most` bytes.

    Names are listed on the driver: Spark's own file index leaves out names that begin with a dot or an underscore. Hidden
    names are left out unless wanted, `.git` always. For `only`, rules are read from the folders above the names alone.
    """
    from pyarrow import fs

    store, base = opened(root)
    if only is None:
        found = store.get_file_info(fs.FileSelector(base, recursive=True))
        rulers = [x.path for x in found if x.path.rsplit("/", 1)[-1] in IGNORE_FILES]
    else:
        above = {"/".join(p.split("/")[:k]) for p in only for k in range(p.count("/") + 1)}
        asked = [f"{base}/{d}/{n}".replace("//", "/") for d in above for n in IGNORE_FILES]
        rulers = [x.path for x in (store.get_file_info(asked) if asked else []) if x.type == fs.FileType.File]
        found = store.get_file_info([f"{base}/{p}" for p in only]) if only else []
    names = [(x.path[len(base) + 1 :], x.size, x.mtime_ns) for x in found if x.type == fs.FileType.File]
    names = [x for x in names if ".git" not in x[0].split("/")]
    rules = Rules({p[len(base) + 1 :]: store.open_input_stream(p).read().decode("utf-8", "replace") for p in rulers if "/.git/" not in p})
    return [x for x in names if x[1] <= most and (hidden or not re.search(r"(^|/)\.", x[0])) and not rules.ignored(x[0])]


def contents(names: DataFrame, root: str) -> DataFrame:
    """Names (path, size, mtime_ns) with their contents, read by the executors; files that can't be read are passed over."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base = opened(root)
        for b in batches:
            for path, size, mtime in zip(*(b.column(i).to_pylist() for i in range(3))):
                try:
                    with at.open_input_stream(f"{base}/{path}") as f:
                        content = f.read()
                except OSError:
                    continue
                yield pa.RecordBatch.from_pydict({"path": [path], "content": [content], "size": [size], "mtime_ns": [mtime]}, pa.schema([("path", pa.string()), ("content", pa.binary()), ("size", pa.int64()), ("mtime_ns", pa.int64())]))

    return names.select("path", "size", "mtime_ns").mapInArrow(read, SCANNED)


def named(spark: SparkSession, names: list[tuple[str, int, int]]) -> DataFrame:
    return spark.createDataFrame(names, NAMES).repartition(max(1, min(1000, len(names) // 64)))


def scan(spark: SparkSession, root: str, hidden: bool = False, most: int = model.MAX_FILE) -> DataFrame:
    """Files (path, content, size, mtime_ns) under a folder that all executors reach; see `listed` for which."""
    return contents(named(spark, listed(root, hidden, most)), root)


def manifest_dirs(names: DataFrame) -> DataFrame:
    """Folders (dir) that hold a build manifest."""
    return names.filter(manifest_kind(F.col("path")).isNotNull()).select(dirname(F.col("path")).alias("dir")).distinct()


def units(names: DataFrame, dirs: DataFrame) -> DataFrame:
    """(path, index_unit): the nearest folder above each path that is a manifest's, `.` if none."""
    parts = F.split(dirname(F.col("path")), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    found = names.select("path", F.explode(above).alias("dir")).join(dirs, "dir").groupBy("path").agg(F.max_by("dir", F.length("dir")).alias("index_unit"))
    return names.select("path").join(found, "path", "left").select("path", F.coalesce("index_unit", F.lit(".")).alias("index_unit"))


def facts(files: DataFrame) -> DataFrame:
    """Source files (path, content, size, mtime_ns, lang, language, content_hash, line_count) of a scan; contents are read once.

    Files of an unknown language, of over 2 MiB and with a NUL near their start are left out.
    """
    some = files.withColumn("language", detect_lang(F.col("path"))).filter(F.col("language").isNotNull() & indexable(F.col("content")))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return some.select("path", text.alias("content"), "size", "mtime_ns", model.code_of(F.col("language"), model.LANGUAGES).alias("lang"), "language", F.sha2("content", 256).alias("content_hash"), F.size(F.split(text, "\n", -1)).cast("long").alias("line_count"))


def indexed(files: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Source files of a scan (see `facts`) with index_unit, the nearest folder above with a manifest.

    names: all paths of the scan, so that manifests and units are found without reading contents again.
    """
    names = files.select("path") if names is None else names.select("path")
    return facts(files).join(units(names, manifest_dirs(names)), "path")


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if b < 0x80:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message; groups don't occur."""
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            n, at = varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        yield number, value


def decode_index(data: bytes) -> Iterator[tuple[str, str, int, str, int, int]]:
    """(project_root, relative_path, ordinal, symbol, line0, roles) of each occurrence in a precise index.

    By the public schema: Index {metadata 1, documents 2}, Metadata {project_root 3}, Document {relative_path 1,
    occurrences 2}, Occurrence {range 1, symbol 2, symbol_roles 3}.
    """
    top = list(fields(data))
    root = next((v.decode() for n, m in top if n == 1 for k, v in fields(m) if k == 3), "")
    for number, doc in top:
        if number != 2:
            continue
        parts = list(fields(doc))
        path = next((v.decode() for k, v in parts if k == 1), "")
        for i, occurrence in enumerate(v for k, v in parts if k == 2):
            line, symbol, roles = None, "", 0
            for k, v in fields(occurrence):
                if k == 1 and line is None:
                    line = varint(v, 0)[0] if isinstance(v, bytes) and v else v if isinstance(v, int) else None
                elif k == 2:
                    symbol = v.decode()
                elif k == 3:
                    roles = v
            if line is not None:
                yield root, path, i, symbol, line, roles


def precise_index(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Occurrences of precise index files, each with its index_file, decoded by the executors, a file to a task."""
    schema = pa.schema([("index_file", pa.string()), ("project_root", pa.string()), ("relative_path", pa.string()), ("ordinal", pa.int64()), ("symbol", pa.string()), ("line0", pa.int64()), ("roles", pa.int64())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows = [(path, *row) for row in decode_index(content.as_py())]
                for lo in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[lo : lo + 10_000]), schema)], schema=schema)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(decode, "index_file string, project_root string, relative_path string, ordinal long, symbol string, line0 long, roles long")


def git_output(root: str, *args: str) -> list[str]:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=True).stdout.splitlines()


def git_head(root: str) -> str | None:
    """The commit that a local checkout is at; None where root isn't the top of one."""
    try:
        top = git_output(root, "rev-parse", "--show-toplevel", "HEAD")
    except (subprocess.CalledProcessError, OSError):
        return None
    return top[1] if len(top) == 2 and os.path.realpath(top[0]) == os.path.realpath(root) else None


def git(spark: SparkSession, root: str, since: str | None = None) -> DataFrame:
    """(source, line) of git's reports on a local checkout: committed changes since a commit, and the working tree."""
    rows = [("diff", x) for x in (git_output(root, "diff", "--name-status", since, "HEAD") if since else [])] + [("status", x) for x in git_output(root, "status", "--porcelain", "--untracked-files=all")]
    return spark.createDataFrame(rows, "source string, line string")
