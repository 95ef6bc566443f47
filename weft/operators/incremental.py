"""A graph after some of its files changed: only what they touch is derived again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft import model
from weft.operators import precise, resolve


def swapped(old: DataFrame, touched: DataFrame, new: DataFrame) -> DataFrame:
    """A table by file_id without the rows of touched files, and with the new ones."""
    return old.join(touched, "file_id", "left_anti").select(old.columns).unionByName(new.select(old.columns))


def changed_names(old: DataFrame, new: DataFrame) -> DataFrame:
    """Names whose candidates may differ: those of symbols (symbol_id, name) that are in one of the two tables only."""
    gone = old.select("symbol_id", "name").join(new.select("symbol_id"), "symbol_id", "left_anti")
    come = new.select("symbol_id", "name").join(old.select("symbol_id"), "symbol_id", "left_anti")
    return gone.unionByName(come).select("name").distinct()


def applied(old: dict[str, DataFrame], touched: DataFrame, new: dict[str, DataFrame], stored) -> dict[str, DataFrame]:
    """The tables after the files of touched (file_id: changed and deleted ones) gave way to those of new.

    old: file, symbol, call, line, occurrence, edge, covered (files that a precise index covers); new: file, symbol, call, line
    of changed and added files, with ids. stored(df, what) writes an intermediate table.

    Calls are resolved again in new files and, anywhere, where a symbol of their name came or went. Edges of touched files go, of
    any provenance; precise edges of other files stay as long as both ends do, and files that are still covered get no
    syntactic edges. The edges are those that resolving everything anew would give, plus the precise ones that stayed.
    """
    touched = touched.select("file_id").distinct()
    out = {name: swapped(old[name], touched, new[name]) for name in ("file", "symbol", "call", "line")}
    symbol = out["symbol"]
    names = stored(changed_names(old["symbol"].join(touched, "file_id", "left_semi"), new["symbol"]), "names")
    fresh = new["file"].select("file_id")
    again = out["call"].join(names, "name", "left_semi").unionByName(out["call"].join(fresh, "file_id", "left_semi")).distinct()
    kept = old["occurrence"].join(touched, "file_id", "left_anti").join(names, "name", "left_anti").select(old["occurrence"].columns)
    out["occurrence"] = kept.unionByName(resolve.occurrences(again, symbol).select(kept.columns))
    # every call of a source that is resolved again counts for its edges
    sources = stored(resolve.innermost(again, symbol, True).filter("enclosing_id is not null").select(F.col("enclosing_id").alias("src")).distinct(), "sources")
    theirs = symbol.join(sources.select(F.col("src").alias("symbol_id")), "symbol_id", "left_semi").select("file_id").distinct()
    derived = resolve.edges(out["call"].join(theirs, "file_id", "left_semi"), symbol).join(sources, "src", "left_semi").select(old["edge"].columns)
    out["covered"] = old["covered"].join(touched, "file_id", "left_anti")
    derived = precise.superseded(derived, symbol, out["covered"])
    lost = old["symbol"].join(touched, "file_id", "left_semi").select("symbol_id")
    dead = lost.join(new["symbol"].select("symbol_id"), "symbol_id", "left_anti")
    edge = old["edge"].join(lost.withColumnRenamed("symbol_id", "src"), "src", "left_anti").join(dead.withColumnRenamed("symbol_id", "dst"), "dst", "left_anti")
    syntactic = edge.join(sources.withColumn("again", F.lit(True)), "src", "left").filter(F.col("again").isNull() | (F.col("provenance") != model.TS))
    out["edge"] = precise.inserted(syntactic.select(old["edge"].columns), derived)
    return out
