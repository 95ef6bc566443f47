"""Queries over a small tree of files that is written to the shared folder: scanning, indexing, precise edges, reconciling.

The tree's contents are fixed, so the rows are known and stand as SQL values.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft import model
from weft.engine import Index
from weft.plans import cases
from weft.plans.store import Store, shared_dir
from weft.sources import scan

#: A tree with a build unit, ignore rules, and files that an index leaves out: ignored, hidden, binary, too long, of no language.
TREE: dict[str, bytes] = {
    "Cargo.toml": b"", "src/a.rs": b"fn leaf() {}\nfn mid() { leaf() }\n", "src/keep.gen.rs": b"fn kept() { leaf() }\n", "src/drop.gen.rs": b"fn generated() {}\n",
    "web/package.json": b"{}", "web/app/b.ts": b"export function page() { return mid() }\n", ".gitignore": b"out/\n*.gen.rs\n!keep.gen.rs\n", "out/x.rs": b"fn hidden() {}\n",
    ".hidden.rs": b"fn no() {}\n", "src/bin.rs": b"fn binary() {}\0", "src/long.rs": b"//" + b" " * model.MAX_FILE, "notes.md": b"fn no() {}\n",
}


def put(root: str, files: dict[str, bytes]) -> None:
    store, base = scan.opened(root)
    for path, data in files.items():
        store.create_dir(f"{base}/{path}".rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(f"{base}/{path}") as f:
            f.write(data)


def removed(root: str, path: str) -> None:
    store, base = scan.opened(root)
    store.delete_file(f"{base}/{path}")


def planted(spark: SparkSession, files: dict[str, bytes]) -> str:
    """A new folder that driver and executors share, with these files."""
    root = f"{shared_dir(spark)}/weft-tree-{uuid.uuid4().hex}"
    put(root, files)
    return root


def message(*fields: tuple[int, int | bytes]) -> bytes:
    """A protocol buffer message of short fields."""
    return b"".join(bytes([n << 3, v]) if isinstance(v, int) else bytes([n << 3 | 2, len(v)]) + v for n, v in fields)


def precise_bytes(project: str, path: str, occurrences: list[tuple[int, str, int]]) -> bytes:
    """A precise index of one document: occurrences of (line from 0, symbol, roles)."""
    told = [(2, message((1, bytes([line, 0, 3])), (2, symbol.encode()), (3, roles))) for line, symbol, roles in occurrences]
    return message((1, message((3, project.encode()))), (2, message((1, path.encode()), *told)))


def scan_tree(spark: SparkSession, d: str) -> DataFrame:
    """What a scan finds; the index leaves out some of it later."""
    return scan.scan(spark, planted(spark, TREE)).select("path", "size")


def values(names: str, rows: list[tuple]) -> str:
    told = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"CAST({v} AS BIGINT)" for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {told}) t({names})"


SCANNED = [(p, len(TREE[p])) for p in ("Cargo.toml", "src/a.rs", "src/keep.gen.rs", "web/package.json", "web/app/b.ts", "src/bin.rs", "notes.md")]


def indexed(spark: SparkSession, files: dict[str, bytes], precise: bytes | None = None) -> Index:
    root = planted(spark, files)
    ix = Index(spark, root, f"{root}-index")
    if precise is not None:
        put(f"{root}-precise", {"a.scip": precise})
    ix.build([f"{root}-precise/a.scip"] if precise is not None else None)
    return ix


def languages() -> dict[str, bytes]:
    return {f"src/{name}.{ext}": source.replace("{n}", "7").encode() for name, (ext, source) in cases.SOURCES.items()}


def full_index(spark: SparkSession, d: str) -> DataFrame:
    """An index over one file in each language."""
    ix = indexed(spark, languages())
    return ix.symbol.join(ix.file.select("file_id", "path", "index_unit"), "file_id").select("path", "index_unit", "name_path", model.labelled(F.col("kind"), model.KINDS).alias("kind"), "start_line", "end_line")


FULL = [(f"src/{name}.{ext}", ".", p.replace("{n}", "7"), k, a, b) for name, (ext, _) in cases.SOURCES.items() for p, k, a, b in cases.expected(name) if k != "call"]


def named_edges(ix: Index) -> DataFrame:
    ends = ix.symbol.join(ix.file.select("file_id", "path"), "file_id")
    a, b = (ends.select(F.col("symbol_id").alias(c), F.concat_ws(":", "path", "name").alias(n)) for c, n in (("src", "caller"), ("dst", "callee")))
    return ix.edge.join(a, "src").join(b, "dst").select("caller", "callee", model.labelled(F.col("provenance"), model.PROVENANCES).alias("provenance"), model.labelled(F.col("resolution"), model.RESOLUTIONS).alias("resolution"))


def index_edges(spark: SparkSession, d: str) -> DataFrame:
    return named_edges(indexed(spark, TREE))


EDGES = [("src/a.rs:mid", "src/a.rs:leaf"), ("src/keep.gen.rs:kept", "src/a.rs:leaf"), ("web/app/b.ts:page", "src/a.rs:mid")]
SCIP = [(0, "s1", 1), (1, "s2", 1), (1, "s1", 0)]


def scip_source(spark: SparkSession, d: str) -> DataFrame:
    root = planted(spark, {"a.scip": precise_bytes("file:///repo", "src/a.rs", SCIP)})
    return scan.precise_index(spark, [f"{root}/a.scip"]).drop("index_file")


def reconcile_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges after an unrelated file went and another came: the precise edge stays, the new file's call is resolved."""
    root = planted(spark, TREE)
    put(f"{root}-precise", {"a.scip": precise_bytes(scan.opened(root)[1], "src/a.rs", SCIP)})
    ix = Index(spark, root, f"{root}-index")
    ix.build([f"{root}-precise/a.scip"])
    removed(root, "src/keep.gen.rs")
    put(root, {"src/new.rs": b"fn fresh() { leaf() }\n"})
    ix.reconcile()
    return named_edges(ix)


def meta_rows(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of a store over two versions: later values win, earlier ones are carried over."""
    store = Store(spark, f"{shared_dir(spark)}/weft-store-{uuid.uuid4().hex}")
    store.write({"x": spark.range(1)}, {"a": "1", "b": "1"})
    store.write({"x": spark.range(2)}, {"b": "2"})
    return spark.createDataFrame(sorted(store.meta().items()), "key string, value string")


QUERIES = {f.__name__: f for f in (scan_tree, full_index, index_edges, scip_source, reconcile_edges, meta_rows)}
ORACLES = {
    "scan_tree": values("path, size", SCANNED),
    "full_index": values("path, index_unit, name_path, kind, start_line, end_line", FULL),
    "index_edges": values("caller, callee, provenance, resolution", [(*e, "ts", "ambiguous") for e in EDGES]),
    "scip_source": values("project_root, relative_path, ordinal, symbol, line0, roles", [("file:///repo", "src/a.rs", i, s, n, r) for i, (n, s, r) in enumerate(SCIP)]),
    "reconcile_edges": values("caller, callee, provenance, resolution", [("src/a.rs:mid", "src/a.rs:leaf", "scip", "resolved"), ("web/app/b.ts:page", "src/a.rs:mid", "ts", "ambiguous"), ("src/new.rs:fresh", "src/a.rs:leaf", "ts", "ambiguous")]),
    "meta_rows": values("key, value", [("a", "1"), ("b", "2"), ("schema_version", "1")]),
}
