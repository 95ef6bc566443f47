"""Output: rows as text under a budget of tokens, code with line numbers, graph exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft import model
from weft.functions.text import tokens
from weft.operators.graph import running


def estimate(text: str) -> int:
    return len(text.encode()) // 4 + 1


def hit_row(df: DataFrame) -> Column:
    return F.format_string("sym:%d | %s | %s:%d-%d | %s", "symbol_id", "name_path", "file", "line", "end_line", model.labelled(F.col("kind"), model.KINDS, True))


def edge_row(df: DataFrame) -> Column:
    via = F.when(F.col("provenance").isNull() | F.col("resolution").isNull(), F.lit("-")).otherwise(F.concat_ws("/", model.labelled(F.col("provenance"), model.PROVENANCES), model.labelled(F.col("resolution"), model.RESOLUTIONS)))
    return F.concat_ws(" | ", hit_row(df), F.col("depth").cast("string"), via)


def ref_row(df: DataFrame) -> Column:
    return F.format_string("%s | %s:%d | %s", F.coalesce("enclosing", F.lit("(top-level)")), "file", "line", model.labelled(F.col("role"), model.ROLES))


def grep_row(df: DataFrame) -> Column:
    where = F.when(F.col("enclosing_id").isNull(), F.lit("-")).otherwise(F.format_string("sym:%d %s", "enclosing_id", "enclosing"))
    return F.format_string("%s:%d | %s | %s", "file", "line", where, "text")


def budgeted(rows: DataFrame, order: list[str], label: str = "", fields: str = "", hint: str = "", ceiling: int = model.TOKENS) -> DataFrame:
    """rows (row, and the columns of order) up to the first that would exceed the ceiling. Costs are positive, so a filter
    on the running sum keeps just that prefix."""
    used = estimate(label) + estimate(fields) + estimate(hint) + 8
    return rows.withColumn("used", running(tokens(F.col("row")), order) + F.lit(used)).filter(F.col("used") <= ceiling)


def probed(df: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """The first limit rows, and whether there was one more."""
    more = df.limit(limit + 1)
    return more.limit(limit), more.count() > limit


def block(label: str, fields: str, rows: list[str], cut: bool, hint: str, ceiling: int = model.TOKENS) -> str:
    """A block of text: a heading with the number of rows shown and why any are missing, the rows, and a hint."""
    used, shown = estimate(label) + estimate(fields) + estimate(hint) + 8, []
    for r in rows:
        if used + estimate(r) > ceiling:
            break
        used += estimate(r)
        shown.append(r)
    missing = len(rows) - len(shown)
    why = f", truncated_by=token, dropped≈{missing}" if missing else ", truncated_by=limit, dropped≈1" if cut else ""
    return "\n".join([f"# {label}  ({len(shown)} shown{why})", f"# fields: {fields}", *shown, f"# next: {hint}", ""])


def rendered_code(symbols: DataFrame, files: DataFrame, lines: DataFrame) -> DataFrame:
    """(symbol_id, line_no, text): a heading (line 0) and the lines of each symbol, numbers right-aligned in five places."""
    held = symbols.join(files.select("file_id", "path"), "file_id")
    head = held.select("symbol_id", F.lit(0).cast("long").alias("line_no"), F.format_string("# sym:%d %s  %s:%d-%d", "symbol_id", "name_path", "path", "start_line", "end_line").alias("text"))
    body = symbols.join(lines, "file_id").filter(F.col("line_no").between(F.col("start_line"), F.col("end_line")))
    return head.unionByName(body.select("symbol_id", "line_no", F.format_string("%5d  %s", "line_no", "line").alias("text")))


def exported(nodes: DataFrame, edges: DataFrame, root: int, form: str) -> DataFrame:
    """(part, a, b, line) of a graph as DOT or Mermaid; ordered by part, a, b the lines are the file."""
    spark = nodes.sparkSession
    none = lambda part, line: spark.createDataFrame([(part, 0, 0, line)], "part long, a long, b long, line string")
    zero = F.lit(0).cast("long")
    if form == "dot":
        label = F.replace(F.replace(F.col("name_path"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        extra = F.when(F.col("symbol_id") == root, F.lit(', style=filled, fillcolor="#e0e7ff"')).otherwise(F.lit(""))
        color = F.when(F.col("provenance").isin(model.SCIP, model.LSP), "#16a34a").when(F.col("provenance") == model.PROVENANCES.index("sg"), "#2563eb").otherwise("#ea580c")
        node, edge = F.format_string('  n%d [label="%s"%s];', "symbol_id", label, extra), F.format_string('  n%d -> n%d [color="%s"];', "src", "dst", color)
        first, last = none(0, 'digraph calls {\n  rankdir=LR;\n  node [shape=box, fontname="monospace"];'), none(3, "}")
    elif form == "mermaid":
        node = F.format_string('  n%d["%s"]', "symbol_id", F.replace(F.col("name_path"), F.lit('"'), F.lit("&quot;")))
        edge = F.format_string("  n%d --> n%d", "src", "dst")
        first, last = none(0, "flowchart LR"), None
    else:
        raise ValueError(f"unknown export format {form!r}")
    out = first.unionByName(nodes.select(F.lit(1).cast("long").alias("part"), F.col("symbol_id").alias("a"), zero.alias("b"), node.alias("line")))
    out = out.unionByName(edges.select(F.lit(2).cast("long").alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"), edge.alias("line")))
    return out if last is None else out.unionByName(last)
