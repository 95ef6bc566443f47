"""Call resolution: from call sites by name to edges between symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft import model


def innermost(places: DataFrame, symbols: DataFrame, callable_only: bool) -> DataFrame:
    """places (file_id, line_no, ...) with enclosing_id: the symbol of fewest lines over the line, null if none.

    Ties go to the least id. An interval join on file and line, reduced by a minimum that combines before the shuffle;
    only the distinct places take part, so many calls on a line cost one lookup.
    """
    spans = symbols.select("file_id", "symbol_id", "start_line", "end_line", "kind")
    if callable_only:
        spans = spans.filter(F.col("kind").isin(*model.CALLABLE))
    asked = places.select("file_id", "line_no").distinct()
    over = asked.join(spans, "file_id").filter(F.col("line_no").between(F.col("start_line"), F.col("end_line")))
    least = over.groupBy("file_id", "line_no").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("n"), "symbol_id")).alias("s"))
    return places.join(least.select("file_id", "line_no", F.col("s.symbol_id").alias("enclosing_id")), ["file_id", "line_no"], "left")


def candidates(symbols: DataFrame, most: int = model.CANDIDATES) -> DataFrame:
    """(name, symbol_id, rank) of the first symbols of each name, any kind and file, by id.

    The rank limit is applied within each task before the shuffle, so a very common name costs a few rows a task.
    """
    rank = F.row_number().over(Window.partitionBy("name").orderBy("symbol_id"))
    return symbols.select("name", "symbol_id").withColumn("rank", rank.cast("long")).filter(F.col("rank") <= most)


def occurrences(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Call occurrences: one for each call that lies in a callable and whose name is known; symbol_id is the first candidate."""
    first = candidates(symbols, 1).select("name", "symbol_id")
    held = innermost(calls, symbols, True).filter("enclosing_id is not null")
    return held.join(first, "name").select("file_id", "line_no", "name", "enclosing_id", "symbol_id", F.lit(model.CALL).cast("long").alias("role"))


def edges(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls edges from the enclosing callable to every candidate, each once; ambiguous even for one candidate."""
    held = innermost(calls, symbols, True).filter("enclosing_id is not null").select("name", F.col("enclosing_id").alias("src")).distinct()
    found = held.join(candidates(symbols).select("name", F.col("symbol_id").alias("dst")), "name").select("src", "dst").distinct()
    return found.select("src", "dst", *[F.lit(v).cast("long").alias(n) for n, v in (("kind", model.CALLS), ("provenance", model.TS), ("resolution", model.AMBIGUOUS))])


def call_sites(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst, kind, file_id, line_no): which call gave which edge; an occurrence is its file, line and name."""
    held = innermost(calls, symbols, True).filter("enclosing_id is not null")
    return held.join(candidates(symbols).select("name", F.col("symbol_id").alias("dst")), "name").select(F.col("enclosing_id").alias("src"), "dst", F.lit(model.CALLS).cast("long").alias("kind"), "file_id", "line_no").distinct()


def replaced(old: DataFrame, new: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Edges after a pass over some files (file_id): their Calls edges of any provenance give way to the new ones."""
    sources = symbols.join(files.select("file_id").distinct(), "file_id", "left_semi").select(F.col("symbol_id").alias("src"))
    others = old.filter(F.col("kind") != model.CALLS).unionByName(old.filter(F.col("kind") == model.CALLS).join(sources, "src", "left_anti").select(old.columns))
    return others.unionByName(new.join(sources, "src", "left_semi").select(old.columns)).dropDuplicates(["src", "dst", "kind"])
