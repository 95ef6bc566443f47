"""Edges from precise indexes and language servers, merged with the syntactic ones."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft import model
from weft.operators.resolve import innermost

DEFINITION = 1


def full_path(project_root: Column, relative: Column, root: str = "") -> Column:
    """A document's path in the repository: the unit's root, relative to the repository, and its own path."""
    unit = F.regexp_replace(F.regexp_replace(project_root, "^file://", ""), "/+$", "")
    top = re.sub(r"^file:/+", "/", root).rstrip("/")
    prefix = F.when(unit == top, F.lit("")).when(unit.startswith(f"{top}/"), F.substring(unit, len(top) + 2, 1 << 20)).otherwise(F.lit(""))
    return F.when(prefix == "", relative).otherwise(F.concat_ws("/", prefix, relative))


def without_scip(edges: DataFrame) -> DataFrame:
    """Edges before a new ingest: earlier precise ones are dropped, so ingesting twice gives the same."""
    return edges.filter(F.col("provenance") != model.SCIP)


def documents(occurrences: DataFrame, files: DataFrame, root: str = "") -> DataFrame:
    """Occurrences (project_root, relative_path, ordinal, symbol, line0, roles) with file_id; unknown files are left out."""
    return occurrences.withColumn("path", full_path(F.col("project_root"), F.col("relative_path"), root)).join(files.select("file_id", "path"), "path")


def scope(docs: DataFrame) -> list[str]:
    """What a precise symbol's name is known within: its project, and its index file where that is told."""
    return ["project_root"] + (["index_file"] if "index_file" in docs.columns else [])


def symbol_map(docs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(project_root, index_file where told, symbol, symbol_id, kind): the last definition of each symbol, on a line the last symbol of the line."""
    lines = symbols.groupBy("file_id", F.col("sel_line").alias("line_no")).agg(F.max("symbol_id").alias("symbol_id"), F.max_by("kind", "symbol_id").alias("kind"))
    defined = docs.filter(F.col("roles").bitwiseAND(DEFINITION) != 0).withColumn("line_no", F.col("line0") + 1).join(lines, ["file_id", "line_no"])
    last = F.max_by(F.struct("symbol_id", "kind"), F.struct("path", "ordinal"))
    return defined.groupBy(*scope(docs), "symbol").agg(last.alias("s")).select(*scope(docs), "symbol", "s.symbol_id", "s.kind")


def superseded(edges: DataFrame, symbols: DataFrame, covered: DataFrame) -> DataFrame:
    """Edges without the Calls edges of other provenance whose source lies in a covered file (file_id)."""
    sources = symbols.join(covered.select("file_id").distinct(), "file_id", "left_semi").select(F.col("symbol_id").alias("src"), F.lit(True).alias("__covered"))
    gone = F.col("__covered").isNotNull() & (F.col("kind") == model.CALLS) & (F.col("provenance") != model.SCIP)
    return edges.join(sources, "src", "left").filter(~gone).select(edges.columns)


def scip_edges(docs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Resolved Calls edges: references to functions and methods, from the innermost callable over their line."""
    known = symbol_map(docs, symbols).filter(F.col("kind").isin(*model.CALLABLE)).select(*scope(docs), "symbol", F.col("symbol_id").alias("dst"))
    used = docs.filter(F.col("roles").bitwiseAND(DEFINITION) == 0).select(*scope(docs), "symbol", "file_id", (F.col("line0") + 1).alias("line_no")).join(known, [*scope(docs), "symbol"])
    held = innermost(used, symbols, True).filter("enclosing_id is not null")
    return held.select(F.col("enclosing_id").alias("src"), "dst").distinct().select("src", "dst", *[F.lit(v).cast("long").alias(n) for n, v in (("kind", model.CALLS), ("provenance", model.SCIP), ("resolution", model.RESOLVED))])


def inserted(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or ignore: new edges where no edge of the same ends and kind is."""
    return edges.unionByName(new.dropDuplicates(["src", "dst", "kind"]).join(edges.select("src", "dst", "kind"), ["src", "dst", "kind"], "left_anti").select(edges.columns))


def coverage(covered: DataFrame, files: DataFrame) -> DataFrame:
    """(covered, total, pct, warn): whole percent, 0 without files; a warning under 50."""
    flags = files.select("file_id").join(covered.select("file_id", F.lit(1).alias("c")).distinct(), "file_id", "left")
    a = flags.agg(F.count("c").alias("covered"), F.count("*").alias("total"))
    pct = F.when(F.col("total") == 0, F.lit(0)).otherwise(F.floor(F.col("covered") * 100 / F.col("total"))).cast("long")
    return a.select("covered", "total", pct.alias("pct"), (pct < 50).alias("warn"))


def lsp_upserted(edges: DataFrame, confirmed: DataFrame, prefer_trusted: bool = False) -> DataFrame:
    """Edges after a language server confirmed calls (src, dst): new or overwritten as lsp/resolved; self-calls are ignored.

    prefer_trusted keeps an edge whose provenance ranks higher.
    """
    new = confirmed.filter("src <> dst").select("src", "dst").distinct().select("src", "dst", F.lit(model.CALLS).cast("long").alias("kind"), F.lit(True).alias("__new"))
    both = edges.join(new, ["src", "dst", "kind"], "full_outer")
    take = F.col("__new").isNotNull()
    if prefer_trusted:
        higher = [model.PROVENANCES.index(p) for p in model.TRUST[: model.TRUST.index("lsp")]]
        take = take & ~F.coalesce(F.col("provenance").isin(*higher), F.lit(False))
    return both.select(
        "src", "dst", "kind",
        F.when(take, F.lit(model.LSP).cast("long")).otherwise(F.col("provenance")).alias("provenance"),
        F.when(take, F.lit(model.RESOLVED).cast("long")).otherwise(F.col("resolution")).alias("resolution"),
    )


def symbol_at(places: DataFrame, symbols: DataFrame) -> DataFrame:
    """places (file_id, line_no) with symbol_id: the symbol whose name stands on the line (least id), else the innermost callable."""
    exact = symbols.groupBy("file_id", F.col("sel_line").alias("line_no")).agg(F.min("symbol_id").alias("__exact"))
    return innermost(places.join(exact, ["file_id", "line_no"], "left"), symbols, True).select(*places.columns, F.coalesce("__exact", "enclosing_id").alias("symbol_id"))
