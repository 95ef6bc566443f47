"""The model over any table of texts: documents are files, nested blocks of lines are symbols, capitalised words are calls.

Built once per session and folder and written to the shared folder, as an index is built once and asked often.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft import model
from weft.functions.text import detect_lang, dirname
from weft.operators import maintain, resolve
from weft.operators.ids import dense_ids
from weft.plans.store import stored

#: Extensions dealt to the documents in turn.
DEALT = ["rs", "ts", "py", "go", "java", "c", "cpp", "cs", "php", "swift", "kt", "clj", "tsx", "js", "h", "md"]


@dataclass
class CodeGraph:
    """Tables of an index: file, line, symbol, call, occurrence, edge."""

    file: DataFrame
    line: DataFrame
    symbol: DataFrame
    call: DataFrame
    occurrence: DataFrame
    edge: DataFrame

    def views(self) -> None:
        """Register the tables as views, for SQL of one's own."""
        for name, df in vars(self).items():
            df.createOrReplaceTempView(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id is not null")
    ext = F.element_at(F.array(*[F.lit(x) for x in DEALT]), (F.col("doc_id") % len(DEALT) + 1).cast("int"))
    path = F.format_string("%s/%s/d%d.%s", F.coalesce("lang", F.lit("und")), F.coalesce("source", F.lit("none")), "doc_id", ext)
    return docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), F.coalesce("text", F.lit("")).alias("content"))


def lines(docs: DataFrame) -> DataFrame:
    return docs.select("file_id", F.posexplode(F.split("content", "\n", -1)).alias("p", "line")).select("file_id", (F.col("p") + 1).cast("long").alias("line_no"), "line")


def symbols(line: DataFrame) -> DataFrame:
    """Nested blocks: a module, functions of eight lines, methods of two, fields of one, named by their first word."""
    n = line.groupBy("file_id").agg(F.count("*").alias("n"))
    at = line.join(n, "file_id").withColumn("name", F.regexp_extract("line", "[A-Za-z]{4,}", 0)).filter("name <> ''").drop("line")
    k, pos = F.col("line_no"), (F.col("line_no") - 1)
    block = lambda when, end, kind: F.when(when, F.struct(end.cast("long").alias("end_line"), F.lit(kind).cast("long").alias("kind")))
    kinds = F.array(block(k == 1, F.col("n"), 7), block(pos % 8 == 0, F.least(k + 7, "n"), 0), block(pos % 4 == 2, F.least(k + 1, "n"), 1), block(pos % 8 == 5, k, 8))
    found = at.select("file_id", "line_no", "name", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("b")).select("file_id", F.col("line_no").alias("start_line"), "b.end_line", "b.kind", "name")
    ids = dense_ids(found, "symbol_id", F.floor(F.col("file_id") / 1000), F.col("file_id"), F.col("start_line"), F.col("kind").desc())
    m = found.filter("kind = 7").select("file_id", F.col("name").alias("mname"))
    f = found.filter("kind = 0").select("file_id", F.col("start_line").alias("fs"), F.col("name").alias("fname"))
    named = ids.withColumn("fs", F.col("start_line") - (F.col("start_line") - 1) % 8).join(m, "file_id", "left").join(f, ["file_id", "fs"], "left")
    path = F.when(F.col("kind") == 7, F.col("name")).when(F.col("kind") == 0, F.concat_ws("/", "mname", "name")).otherwise(F.concat_ws("/", "mname", "fname", "name"))
    return named.select(F.col("symbol_id").cast("long").alias("symbol_id"), "file_id", "start_line", "end_line", "kind", "name", path.alias("name_path"), F.col("start_line").alias("sel_line"))


def calls(line: DataFrame) -> DataFrame:
    return line.select("file_id", "line_no", F.explode(F.regexp_extract_all("line", F.lit("(?:^|[^A-Za-z])([A-Z][a-z]{3,})"), 1)).alias("name")).distinct()


def manifests(files: DataFrame) -> DataFrame:
    """Paths of build manifests: one per language `en` and `de`, and one per source whose number divides by three."""
    d = files.select(F.split("path", "/").alias("p")).select(F.get("p", F.lit(0)).alias("lang"), F.get("p", F.lit(1)).alias("source")).distinct()
    number = F.try_to_number(F.regexp_extract("source", "([0-9]+)$", 1), F.lit("999999"))
    top = d.select("lang").distinct().filter(F.col("lang").isin("en", "de")).select(F.concat("lang", F.lit("/package.json")).alias("path"))
    return d.filter(number % 3 == 0).select(F.concat_ws("/", "lang", "source", F.lit("Cargo.toml")).alias("path")).union(top)


def index_units(files: DataFrame, manifest_paths: DataFrame) -> DataFrame:
    """(path, index_unit): the nearest folder above each file that holds a manifest, `.` if none does."""
    parts = F.split(dirname(F.col("path")), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    roots = manifest_paths.select(dirname(F.col("path")).alias("dir")).distinct()
    found = files.select("path", F.explode(above).alias("dir")).join(roots, "dir").groupBy("path").agg(F.max_by("dir", F.length("dir")).alias("unit"))
    return files.select("path").join(found, "path", "left").select("path", F.coalesce("unit", F.lit(".")).alias("index_unit"))


_built: dict[tuple[str, str], CodeGraph] = {}


def graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        docs = documents(spark, sf_dir)
        facts = docs.select("file_id", "path", F.octet_length("content").cast("long").alias("size"), F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"), F.size(F.split("content", "\n", -1)).cast("long").alias("line_count"))
        lang = model.code_of(detect_lang(F.col("path")), model.LANGUAGES)
        file = stored(facts.join(index_units(facts, manifests(facts)), "path").withColumn("lang", lang).withColumn("tier", F.lit(0).cast("long")), "file")
        line = stored(lines(docs), "line")
        symbol = stored(symbols(line), "symbol")
        call = stored(calls(line), "call")
        occurrence = stored(resolve.occurrences(call, symbol), "occurrence")
        edge = stored(resolve.edges(call, symbol), "edge")
        _built[key] = CodeGraph(file, line, symbol, call, occurrence, edge)
    return _built[key]


def hub(g: CodeGraph) -> int:
    """The symbol that most others call, the least id of several; 0 in an empty graph."""
    row = g.edge.groupBy("dst").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "dst").first()
    return row["dst"] if row else 0


def precise(g: CodeGraph) -> DataFrame:
    """Occurrences as a precise index of the files whose id divides by three would have them."""
    some = g.file.filter("file_id % 3 = 0").select("file_id", F.concat(F.lit("file:///repo/"), F.substring_index("path", "/", 1)).alias("project_root"), F.regexp_replace("path", "^[^/]+/", "").alias("relative_path"))
    of = lambda df, line, ordinal, role: df.join(some, "file_id").select("project_root", "relative_path", ordinal.cast("long").alias("ordinal"), F.concat(F.lit("s"), "name").alias("symbol"), (line - 1).alias("line0"), F.lit(role).cast("long").alias("roles"))
    return of(g.symbol, F.col("sel_line"), F.col("symbol_id"), 1).unionByName(of(g.call, F.col("line_no"), F.lit(0), 0))


def keyed(g: CodeGraph) -> DataFrame:
    return maintain.keyed(g.symbol, g.file)
