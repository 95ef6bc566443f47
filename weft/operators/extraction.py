"""Symbols and calls of source files, a parse per file on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft import model
from weft.extract import extract, extract_calls
from weft.operators.ids import dense_ids, ranged

SCHEMA = "path string, what string, ordinal long, name string, name_path string, kind long, start_line long, start_col long, end_line long, end_col long, sel_line long, sel_col long"
ARROW = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in SCHEMA.split(", "))])


def parsed(files: DataFrame) -> DataFrame:
    """Rows of files (path, language, content): definitions (what = symbol) and calls (what = call), from one pass."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, language, content in zip(*(b.column(i).to_pylist() for i in range(3))):
                rows = [(path, "symbol", i, s.name, s.name_path, model.KINDS.index(s.kind), s.start_line, s.start_col, s.end_line, s.end_col, s.sel_line, s.sel_col) for i, s in enumerate(extract(language, content or ""))]
                rows += [(path, "call", i, c.name, None, None, c.line, c.col, c.line, None, None, None) for i, c in enumerate(extract_calls(language, content or ""))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), ARROW)], schema=ARROW)

    return files.select("path", "language", "content").mapInArrow(parse, SCHEMA)


def tables(file: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbol, call) of files (file_id, path) from their parsed rows. symbol_id is a first number, in order of path and place."""
    held = rows.join(file.select("path", "file_id"), "path")
    symbol = dense_ids(held.filter("what = 'symbol'").drop("what"), "symbol_id", ranged(file, "path"), F.col("path"), F.col("ordinal"))
    call = held.filter("what = 'call'").select("file_id", F.col("start_line").alias("line_no"), "name").distinct()
    return symbol.drop("path", "ordinal").withColumn("symbol_id", F.col("symbol_id").cast("long")), call
