"""An index over a folder of source files: build it, keep it in step, ask it."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import extraction, graph, incremental, maintain, precise, project, query, resolve
from weft.plans.store import Scratch, Store
from weft.sources import scan as source


class Index:
    """Snapshots of a code graph at `store`, over the files at `root`."""

    def __init__(self, spark: SparkSession, root: str, store: str):
        self.spark, self.root, self.store = spark, root.rstrip("/"), Store(spark, store)

    def __getattr__(self, name: str) -> DataFrame:
        if name in ("file", "symbol", "call", "occurrence", "edge", "line"):
            return self.store.read(name)
        raise AttributeError(name)

    def derived(self, files: DataFrame, old: dict[str, DataFrame] | None, meta: dict[str, str], scratch: Scratch) -> tuple[dict[str, DataFrame], dict[str, str]]:
        """(file, symbol, call, line of source files (path, ..., content), marks of the highest ids): known paths and symbols keep their ids."""
        marks = {k: int(meta.get(k, 0)) for k in ("file_mark", "symbol_mark")}
        known = old["file"] if old else self.spark.createDataFrame([], "path string, file_id long")
        file = scratch.stored(maintain.numbered(files.drop("content", "language"), known, marks["file_mark"]).withColumn("tier", F.lit(0).cast("long")), "file")
        rows = scratch.stored(extraction.parsed(files), "parsed")
        symbol, call = extraction.tables(file, rows)
        symbol = scratch.stored(maintain.keyed(scratch.stored(symbol, "symbol"), file), "keyed")
        before = old["symbol"].join(file.select("file_id"), "file_id", "left_semi") if old else self.spark.createDataFrame([], "symbol_key string, symbol_id long")
        told = maintain.reconciled(before, symbol, marks["symbol_mark"]).filter("action <> 'delete'").select("symbol_key", F.col("symbol_id").cast("long").alias("kept"))
        symbol = scratch.stored(symbol.join(told, "symbol_key").withColumn("symbol_id", F.col("kept")).drop("kept"), "symbol")
        line = files.join(file.select("path", "file_id"), "path").select("file_id", F.posexplode(F.split("content", "\n", -1)).alias("p", "line")).select("file_id", (F.col("p") + 1).cast("long").alias("line_no"), "line")
        for mark, df, name in (("file_mark", file, "file_id"), ("symbol_mark", symbol, "symbol_id")):
            marks[mark] = max(marks[mark], df.agg(F.coalesce(F.max(name), F.lit(0)).alias("n")).first()["n"])
        return {"file": file, "symbol": symbol, "call": scratch.stored(call, "call"), "line": line}, {k: str(v) for k, v in marks.items()}

    def place(self) -> dict[str, str]:
        """Metadata of where the files are now: the commit and the mode of the next reconcile."""
        head = None if ":/" in self.root else source.git_head(self.root)
        return {"scanner_mode": "git" if head else "fs", "indexed_commit": head or ""}

    def dirty(self) -> DataFrame:
        """Paths that differ from the commit now; the next reconcile by git looks at them again."""
        if ":/" in self.root or not source.git_head(self.root):
            return self.spark.createDataFrame([], "path string")
        return maintain.git_status(source.git(self.spark, self.root)).select("path").distinct()

    def build(self, indexes: list[str] | None = None) -> dict[str, int]:
        """Index all files anew, ids of known files and symbols kept; then take in precise indexes, if any. Returns counts."""
        with Scratch(self.spark) as scratch:
            place, dirty = self.place(), scratch.stored(self.dirty(), "dirty")
            names = source.named(self.spark, source.listed(self.root))
            files = scratch.stored(source.indexed(source.contents(names, self.root), names), "files")
            old, meta = ({n: self.store.read(n) for n in ("file", "symbol")}, self.store.meta()) if self.store.version() is not None else (None, {})
            new, marks = self.derived(files, old, meta, scratch)
            file, symbol, call = new["file"], new["symbol"], new["call"]
            occurrence, edge = resolve.occurrences(call, symbol), resolve.edges(call, symbol)
            covered, meta = self.spark.createDataFrame([], "file_id long"), {"scip_at": "", "scip_coverage": ""}
            if indexes:
                docs = scratch.stored(precise.documents(source.precise_index(self.spark, indexes), file, self.root), "precise")
                covered = docs.select("file_id").distinct()
                edge = precise.inserted(precise.superseded(precise.without_scip(edge), symbol, covered), precise.scip_edges(docs, symbol))
                meta = {"scip_at": ", ".join(indexes), "scip_coverage": self.coverage_of(covered, file)}
            tables = new | {"occurrence": occurrence, "edge": edge, "covered": covered, "manifest": source.manifest_dirs(names), "dirty": dirty}
            self.store.write(tables, meta | marks | place)
        return {"files": self.file.count(), "symbols": self.symbol.count(), "edges": self.edge.count()}

    @staticmethod
    def coverage_of(covered: DataFrame, file: DataFrame) -> str:
        c = precise.coverage(covered, file).first()
        return f"{c['covered']}/{c['total']} ({c['pct']}%)"

    def candidates(self, old: DataFrame, meta: dict[str, str]) -> tuple[DataFrame, DataFrame, DataFrame] | None:
        """By git, (paths to look at with size and time, paths that are gone, folders of manifests); None where git can't tell.

        Looked at are paths that differ between the commits, in the working tree now, or that did at the last time. A manifest
        or a file of ignore rules among them may concern any path, so that the whole tree is listed instead.
        """
        since = meta.get("indexed_commit")
        if not since or ":/" in self.root or not source.git_head(self.root):
            return None
        try:
            told = maintain.git_changeset(maintain.git_status(source.git(self.spark, self.root, since)))
        except subprocess.CalledProcessError:  # the commit is gone
            return None
        paths = sorted({r["path"] for r in told.select("path").union(self.store.read("dirty")).distinct().collect()})
        if any(p.rsplit("/", 1)[-1] in source.IGNORE_FILES for p in paths):
            return None
        asked = self.spark.createDataFrame([(p,) for p in paths], "path string")
        if not source.manifest_dirs(asked).isEmpty():
            return None
        found = source.listed(self.root, only=paths)
        there = {x[0] for x in found}
        gone = self.spark.createDataFrame([(p,) for p in paths if p not in there], "path string")
        return source.named(self.spark, found), gone, self.store.read("manifest")

    def reconcile(self) -> dict[str, int]:
        """Bring the index in step with the files. Counts of added, changed, deleted and unchanged files.

        What to look at is told by git where the root is the checkout that was indexed, else by size and time of all files; only
        those contents are read, and the hash decides. Only changed files are parsed again, and only calls in them or to a
        name whose symbols came or went are resolved again; ids stay, no id is given twice, and precise edges of other files
        stay. With nothing to do no snapshot is written.
        """
        with Scratch(self.spark) as scratch:
            old, meta = {n: self.store.read(n) for n in ("file", "symbol", "call", "line", "occurrence", "edge", "covered")}, self.store.meta()
            file, place, dirty = old["file"], self.place(), scratch.stored(self.dirty(), "dirty")
            told = self.candidates(file, meta)
            if told:
                asked, gone, dirs = told
                all_paths = file.select("path").union(asked.select("path")).distinct()
            else:
                names = scratch.stored(source.named(self.spark, source.listed(self.root)), "names")
                same = file.select("path", "size", "mtime_ns")
                asked, gone, dirs = names.join(same, ["path", "size", "mtime_ns"], "left_anti"), file.select("path").join(names, "path", "left_anti"), source.manifest_dirs(names)
                all_paths = names.select("path")
            files = scratch.stored(source.facts(source.contents(asked, self.root)), "files")
            rest = file.join(asked.select("path"), "path", "left_anti").join(gone, "path", "left_anti")
            state = ["path", "size", "mtime_ns", "content_hash"]
            diff = scratch.stored(maintain.fs_diff(file, rest.select(state).unionByName(files.select(state))), "diff")
            counts = {r["change"]: r["n"] for r in diff.groupBy("change").agg(F.count("*").alias("n")).collect()}
            out = {k: counts.get(k, 0) for k in ("added", "changed", "deleted", "unchanged")}
            unit = scratch.stored(source.units(all_paths, dirs), "units")
            moved = file.join(unit.withColumnRenamed("index_unit", "now"), "path").filter("now <> index_unit")
            if not (out["added"] or out["changed"] or out["deleted"]) and moved.isEmpty() and place["indexed_commit"] == meta.get("indexed_commit", ""):
                return out
            new_files = files.join(diff.filter("change in ('added', 'changed')"), "path", "left_semi").join(unit, "path")
            touched = scratch.stored(file.join(diff.filter("change in ('changed', 'deleted')"), "path", "left_semi").select("file_id"), "touched")
            new, marks = self.derived(scratch.stored(new_files, "new"), old, meta, scratch)
            tables = incremental.applied(old, touched, new, scratch.stored)
            touch = files.select("path", F.col("size").alias("s"), F.col("mtime_ns").alias("m"))  # touched without a change: not looked at next time
            units = unit.withColumnRenamed("index_unit", "now")
            tables["file"] = tables["file"].join(touch, "path", "left").join(units, "path", "left").withColumn("size", F.coalesce("s", "size")).withColumn("mtime_ns", F.coalesce("m", "mtime_ns")).withColumn("index_unit", F.coalesce("now", "index_unit")).select(file.columns)
            if meta.get("scip_at"):
                place["scip_coverage"] = self.coverage_of(tables["covered"], tables["file"])
            self.store.write(tables | {"manifest": dirs, "dirty": dirty}, marks | place)
        return out

    def watch(self, checkpoint: str, interval: str = "500 milliseconds"):
        """A streaming query that reconciles whenever files come, change or go under root. Stop it with .stop()."""
        from weft.streaming.watch import watched

        return watched(self, checkpoint, interval)

    # --- the menu ---------------------------------------------------------------------------------------------------

    def id_of(self, arg: str) -> int:
        return query.resolve_arg(self.symbol, self.file, arg)

    def resolve(self, text: str, limit: int = 25) -> DataFrame:
        return query.resolve(self.symbol, self.file, text, limit)

    def outline(self, path: str) -> DataFrame:
        return query.outline(self.symbol, self.file, path)

    def search(self, text: str, mode: str = "symbol", limit: int = 30) -> DataFrame:
        return query.search(self.symbol, self.file, text, mode, limit)

    def grep(self, pattern: str, ignore_case: bool = False, limit: int = 50) -> DataFrame:
        """Over all files, hidden and other ones too; places in files that aren't indexed have no enclosing symbol."""
        from weft.functions.text import indexable

        files = source.scan(self.spark, self.root, hidden=True).filter(indexable(F.col("content"))).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
        known = files.join(self.file.select("path", "file_id"), "path", "left").withColumn("file_id", F.coalesce("file_id", -F.abs(F.xxhash64("path")) - 1))
        lines = known.select("file_id", F.posexplode(F.split(F.regexp_replace("content", "\r?\n$", ""), "\r?\n", -1)).alias("p", "line")).select("file_id", (F.col("p") + 1).cast("long").alias("line_no"), "line")
        return query.grep(lines, known.select("file_id", "path"), self.symbol, pattern, ignore_case, limit)

    def callers(self, arg: str, depth: int = 1, limit: int = 50) -> DataFrame:
        return graph.walk(self.edge, self.symbol, self.file, self.id_of(arg), depth, limit, False)

    def callees(self, arg: str, depth: int = 1, limit: int = 50) -> DataFrame:
        return graph.walk(self.edge, self.symbol, self.file, self.id_of(arg), depth, limit, True)

    def impact(self, arg: str, depth: int = 4, limit: int = 80) -> DataFrame:
        return self.callers(arg, depth, limit)

    def trace(self, arg: str, depth: int = 6, limit: int = 40) -> DataFrame:
        return graph.trace_roots(self.edge, self.symbol, self.file, self.id_of(arg), depth, limit)

    def references(self, arg: str, limit: int = 100) -> DataFrame:
        return query.references(self.occurrence, self.symbol, self.file, self.id_of(arg), limit)

    def variables(self, scope: str, limit: int = 100) -> DataFrame:
        return query.variables(self.symbol, self.file, scope, limit)

    def read(self, *args: str) -> DataFrame:
        """Code of symbols; files that changed since they were indexed are brought in step first."""
        ids = [self.id_of(a) for a in args]
        mine = self.file.join(self.symbol.filter(F.col("symbol_id").isin(ids)).select("file_id").distinct(), "file_id")
        paths = [r["path"] for r in mine.select("path").collect()]
        now = source.facts(source.contents(source.named(self.spark, source.listed(self.root, only=paths)), self.root))
        if not query.stale(mine, now).isEmpty():
            self.reconcile()
        known = {r["symbol_id"] for r in self.symbol.filter(F.col("symbol_id").isin(ids)).select("symbol_id").collect()}
        if lost := [a for a, i in zip(args, ids) if i not in known]:
            raise LookupError(f"no longer in the index: {', '.join(lost)}")
        return query.read_symbol(self.symbol, self.file, self.line, ids)

    def inspect(self, arg: str) -> DataFrame:
        return query.inspect(self.symbol, self.file, self.edge, self.id_of(arg))

    def status(self) -> DataFrame:
        return query.status_counts(file=self.file, symbol=self.symbol, occurrence=self.occurrence, edge=self.edge)

    def coverage(self) -> DataFrame:
        return query.unit_coverage(self.file, self.symbol, self.edge)

    def export(self, arg: str, form: str = "mermaid", depth: int = 2) -> str:
        root = self.id_of(arg)
        rows = project.exported(*graph.subgraph(self.edge, self.symbol, self.file, root, depth), root, form)
        return "\n".join(r["line"] for r in rows.orderBy("part", "a", "b").toLocalIterator()) + "\n"

    def text(self, label: str, df: DataFrame, limit: int) -> str:
        """Hits or walk results as a block of text under the token budget."""
        rows, cut = project.probed(df, limit)
        walked = "depth" in rows.columns
        row = project.edge_row(rows) if walked else project.hit_row(rows)
        fields = "sym | name_path | file:lines | kind" + (" | depth | provenance/resolution" if walked else "")
        return project.block(label, fields, [r[0] for r in rows.select(row).collect()], cut, "read a symbol by its id")

    def metas(self) -> DataFrame:
        """(key, value): metadata of the current snapshot, its version and its bytes."""
        fs, path = self.store._fs()
        n = self.store.version()
        rows = self.store.meta() | {"version": str(n), "bytes": str(fs.getContentSummary(path(f"{self.store.root}/v={n}")).getLength())}
        return self.spark.createDataFrame(sorted(rows.items()), "key string, value string")

    def gc(self) -> int:
        """Delete the snapshots before the current one; how many there were."""
        return self.store.pruned()

    def lsp(self, confirmed: DataFrame) -> int:
        """Take in calls that a language server confirmed, as (src, dst) or as (src, path, line_no) of what is called; returns the new version.

        A place stands for the symbol whose name is on the line, else for the innermost callable over it; places without
        one are left out.
        """
        if "dst" not in confirmed.columns:
            places = confirmed.join(self.file.select("path", "file_id"), "path").select("src", "file_id", F.col("line_no").cast("long").alias("line_no"))
            confirmed = precise.symbol_at(places, self.symbol).filter("symbol_id is not null").select("src", F.col("symbol_id").alias("dst"))
        tables = {n: self.store.read(n) for n in ("file", "symbol", "call", "line", "occurrence", "covered", "manifest", "dirty")}
        return self.store.write(tables | {"edge": precise.lsp_upserted(self.edge, confirmed)})


