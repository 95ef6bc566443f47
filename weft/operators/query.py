"""The query menu: lookups by name, file and text."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft import model
from weft.functions.text import ascii_lower, cut_line, like
from weft.operators.graph import hits
from weft.operators.resolve import innermost


def resolve(symbols: DataFrame, files: DataFrame, query: str, limit: int = 25) -> DataFrame:
    """Symbols of that name or name path, or whose name matches %query% (wildcards live); exact ones first, then short names."""
    exact = (F.col("name") == query) | (F.col("name_path") == query)
    found = symbols.filter(exact | like(F.col("name"), f"%{query}%")).withColumn("exact", exact)
    top = found.orderBy(F.col("exact").desc(), F.length("name"), "symbol_id").limit(limit)
    return hits(top, files, "exact").orderBy(F.col("exact").desc(), F.length(F.element_at(F.split("name_path", "/"), -1)), "symbol_id").drop("exact")


def resolve_arg(symbols: DataFrame, files: DataFrame, arg: str) -> int:
    """A symbol argument: sym:N or a whole number is an id as it stands; else the first hit of its name."""
    number = arg.removeprefix("sym:")
    if re.fullmatch(r"[+-]?\d+", number):
        return int(number)
    row = resolve(symbols, files, arg, 1).first()
    if row is None:
        raise LookupError(f"no symbol matches {arg!r}")
    return row["symbol_id"]


def outline(symbols: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """All symbols of a file by first line."""
    return hits(symbols, files.filter(F.col("path") == path)).orderBy("line", "symbol_id")


def folded(text: str) -> str:
    """Lower case without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"


def tokens(symbols: DataFrame) -> DataFrame:
    """(symbol_id, at, token): runs of letters and digits of the name path, folded. Written sorted by token, it is a prefix index."""
    folds = F.translate(F.lower("name_path"), ACCENTED, "".join(map(folded, ACCENTED)))
    return symbols.select("symbol_id", F.posexplode(F.filter(F.split(folds, r"[^\p{L}\p{N}]+"), lambda t: t != "")).alias("at", "token"))


def search(symbols: DataFrame, files: DataFrame, query: str, mode: str = "symbol", limit: int = 30) -> DataFrame:
    """mode symbol (and any unknown one): token prefixes; text: substrings of names; semantic: an error. Ordered by id."""
    if mode == "semantic":
        raise ValueError("semantic search needs embeddings, which this index doesn't have")
    if mode == "text":
        term = query.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        found = symbols.filter(F.contains(ascii_lower(F.col("name")), F.lit(term)) | F.contains(ascii_lower(F.col("name_path")), F.lit(term)))
    else:
        kept = "".join(c for c in query if c.isalnum() or c == "_")
        parts = [p for p in folded(kept).split("_") if p]
        if not parts:
            return hits(symbols.limit(0), files)
        listed = tokens(symbols)
        at = listed.filter(F.col("token").startswith(parts[-1])).select("symbol_id", "at")
        for back, p in enumerate(reversed(parts[:-1]), 1):  # the words before stand right before it
            at = at.join(listed.filter(F.col("token") == p).select("symbol_id", (F.col("at") + back).alias("at")), ["symbol_id", "at"], "left_semi")
        found = symbols.join(at.select("symbol_id"), "symbol_id", "left_semi")
    return hits(found.orderBy("symbol_id").limit(limit), files).orderBy("symbol_id")


def grep(lines: DataFrame, files: DataFrame, symbols: DataFrame, pattern: str, ignore_case: bool = False, limit: int | None = 50) -> DataFrame:
    """Lines that match, cut to 200 characters, each with its innermost enclosing symbol of any kind; by file and line."""
    found = lines.filter(F.col("line").rlike(f"(?i){pattern}" if ignore_case else pattern)).join(files.select("file_id", F.col("path").alias("file")), "file_id")
    found = found.select("file_id", "file", "line_no", cut_line(F.col("line")).alias("text")).orderBy("file", "line_no")
    found = found.limit(limit) if limit is not None else found
    held = innermost(found, symbols, False)
    named = symbols.select(F.col("symbol_id").alias("enclosing_id"), F.col("name_path").alias("enclosing"))
    return held.join(named, "enclosing_id", "left").select("file", F.col("line_no").alias("line"), "text", "enclosing_id", "enclosing").orderBy("file", "line")


def references(occurrences: DataFrame, symbols: DataFrame, files: DataFrame, symbol_id: int, limit: int = 100) -> DataFrame:
    """Places where a symbol is used, with the enclosing symbol's name path, by file and line."""
    enclosing = symbols.select(F.col("symbol_id").alias("enclosing_id"), F.col("name_path").alias("enclosing"))
    found = occurrences.filter(F.col("symbol_id") == symbol_id).join(enclosing, "enclosing_id", "left").join(files.select("file_id", F.col("path").alias("file")), "file_id")
    return found.select("enclosing", "file", F.col("line_no").alias("line"), "role").orderBy("file", "line", "enclosing").limit(limit)


def variables(symbols: DataFrame, files: DataFrame, scope: str, limit: int = 100) -> DataFrame:
    """Fields, variables and constants at any depth below a scope, by line."""
    found = symbols.filter(like(F.col("name_path"), f"{scope}/%") & F.col("kind").isin(model.FIELD, model.VARIABLE, model.CONST))
    return hits(found.orderBy("start_line", "symbol_id").limit(limit), files).orderBy("line", "symbol_id")


def read_symbol(symbols: DataFrame, files: DataFrame, lines: DataFrame, ids: list[int]) -> DataFrame:
    """The code of symbols: their lines, each with its newline but for a file's last. Only lines in their ranges are read."""
    some = symbols.filter(F.col("symbol_id").isin(ids))
    body = some.join(lines, "file_id").filter(F.col("line_no").between(F.col("start_line"), F.col("end_line")))
    code = body.groupBy("symbol_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("code"))
    return hits(some.join(code, "symbol_id"), files, "code").select("symbol_id", "name_path", "file", F.col("line").alias("start_line"), "end_line", "code")


def stale(files: DataFrame, current: DataFrame) -> DataFrame:
    """file_id of files whose content hash differs from that of a scan (path, content_hash), or that are gone."""
    now = current.select("path", F.col("content_hash").alias("now"))
    return files.join(now, "path", "left").filter(~F.col("content_hash").eqNullSafe(F.col("now"))).select("file_id")


def inspect(symbols: DataFrame, files: DataFrame, edges: DataFrame, symbol_id: int) -> DataFrame:
    """A symbol with the numbers of its direct callers and callees, itself not counted."""
    calls = edges.filter((F.col("kind") == model.CALLS) & (F.col("src") != F.col("dst")) & ((F.col("src") == symbol_id) | (F.col("dst") == symbol_id)))
    n = calls.agg(F.count_if(F.col("dst") == symbol_id).alias("callers"), F.count_if(F.col("src") == symbol_id).alias("callees")).withColumn("symbol_id", F.lit(symbol_id).cast("long"))
    return hits(symbols.filter(F.col("symbol_id") == symbol_id), files).join(n, "symbol_id")


def status_counts(**tables: DataFrame) -> DataFrame:
    """(name, n): rows of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def unit_coverage(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(unit, files, precise, pct): files of each build unit, and those with a symbol at either end of a precise edge."""
    sure = edges.filter(F.col("provenance").isin(model.SCIP, model.LSP))
    ends = sure.select(F.col("src").alias("symbol_id")).union(sure.select("dst")).distinct()
    good = symbols.join(ends, "symbol_id", "left_semi").select("file_id", F.lit(1).alias("good")).distinct()
    by = files.join(good, "file_id", "left").groupBy(F.coalesce("index_unit", F.lit(".")).alias("unit")).agg(F.count("*").alias("files"), F.count("good").alias("precise"))
    return by.select("unit", "files", "precise", F.floor(F.col("precise") * 100 / F.col("files")).cast("long").alias("pct")).orderBy(F.col("files").desc(), "unit")
