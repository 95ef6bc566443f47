"""Every query of the code graph engine over the driver's tables, with its SQL twin for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft import model
from weft.functions import text
from weft.operators import extraction, graph, maintain, precise, project, query, resolve
from weft.plans import cases, trees
from weft.sources import fixture

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

EXT = "[" + ",".join(f"'{x}'" for x in fixture.DEALT) + "]"
LANGS = "CASE " + " ".join(f"WHEN ext = '{e}' THEN {model.LANGUAGES.index(lang)}" for e, lang in model.EXTENSIONS.items()) + " END"
LABELS = "CASE " + " ".join(f"WHEN ext = '{e}' THEN '{lang}'" for e, lang in model.EXTENSIONS.items()) + " END"
CTES = {
    "doc": f"SELECT doc_id AS file_id, coalesce(lang,'und')||'/'||coalesce(source,'none')||'/d'||doc_id||'.'||({EXT})[doc_id % 16 + 1] AS path, ({EXT})[doc_id % 16 + 1] AS ext, coalesce(text,'') AS content, coalesce(lang,'und') AS l, coalesce(source,'none') AS s FROM documents",
    "manifest": "SELECT DISTINCT l||'/'||s||'/Cargo.toml' AS path, l||'/'||s AS dir FROM doc WHERE regexp_extract(s,'([0-9]+)$',1) <> '' AND CAST(nullif(regexp_extract(s,'([0-9]+)$',1),'') AS BIGINT) % 3 = 0 UNION SELECT DISTINCT l||'/package.json', l FROM doc WHERE l IN ('en','de')",
    "file": f"SELECT file_id, path, CAST(strlen(content) AS BIGINT) AS size, sha256(content) AS content_hash, CAST(len(string_split(content, chr(10))) AS BIGINT) AS line_count, CAST({LANGS} AS BIGINT) AS lang, CASE WHEN EXISTS (SELECT 1 FROM manifest m WHERE m.dir = doc.l||'/'||doc.s) THEN l||'/'||s WHEN l IN ('en','de') THEN l ELSE '.' END AS index_unit FROM doc",
    "line": "SELECT file_id, CAST(u.i AS BIGINT) AS line_no, string_split(content, chr(10))[u.i] AS line FROM doc, LATERAL (SELECT unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i) u",
    "nl": "SELECT file_id, count(*) AS n FROM line GROUP BY file_id",
    "b": "SELECT line.file_id, line_no AS s, n AS e, 7 AS kind, line FROM line JOIN nl ON line.file_id = nl.file_id WHERE line_no = 1 UNION ALL SELECT line.file_id, line_no, least(line_no + 7, n), 0, line FROM line JOIN nl ON line.file_id = nl.file_id WHERE (line_no - 1) % 8 = 0 UNION ALL SELECT line.file_id, line_no, least(line_no + 1, n), 1, line FROM line JOIN nl ON line.file_id = nl.file_id WHERE (line_no - 1) % 4 = 2 UNION ALL SELECT line.file_id, line_no, line_no, 8, line FROM line WHERE (line_no - 1) % 8 = 5",
    "sym0": "SELECT row_number() OVER (ORDER BY file_id, s, kind DESC) AS symbol_id, * FROM (SELECT file_id, s, e, kind, regexp_extract(line, '[A-Za-z]{4,}', 0) AS name FROM b) WHERE name <> ''",
    "m": "SELECT file_id, name AS mname FROM sym0 WHERE kind = 7",
    "f": "SELECT file_id, s AS fs, name AS fname FROM sym0 WHERE kind = 0",
    "symbol": "SELECT CAST(symbol_id AS BIGINT) AS symbol_id, sym0.file_id, CAST(sym0.s AS BIGINT) AS start_line, CAST(sym0.e AS BIGINT) AS end_line, CAST(kind AS BIGINT) AS kind, name, CASE WHEN kind = 7 THEN name WHEN kind = 0 THEN concat_ws('/', mname, name) ELSE concat_ws('/', mname, fname, name) END AS name_path, CAST(sym0.s AS BIGINT) AS sel_line FROM sym0 LEFT JOIN m ON sym0.file_id = m.file_id LEFT JOIN f ON sym0.file_id = f.file_id AND f.fs = sym0.s - (sym0.s - 1) % 8",
    "call": "SELECT DISTINCT file_id, line_no, unnest(regexp_extract_all(line, '(?:^|[^A-Za-z])([A-Z][a-z]{3,})', 1)) AS name FROM line",
    "over_": "SELECT c.file_id, c.line_no, c.name, s.symbol_id, row_number() OVER (PARTITION BY c.file_id, c.line_no, c.name ORDER BY s.end_line - s.start_line, s.symbol_id) AS r FROM call c JOIN symbol s ON s.file_id = c.file_id AND c.line_no BETWEEN s.start_line AND s.end_line WHERE s.kind IN (0, 1)",
    "held": "SELECT file_id, line_no, name, symbol_id AS enclosing_id FROM over_ WHERE r = 1",
    "cand": "SELECT name, symbol_id, rk AS rank FROM (SELECT name, symbol_id, row_number() OVER (PARTITION BY name ORDER BY symbol_id) AS rk FROM symbol) WHERE rk <= 8",
    "occurrence": "SELECT file_id, line_no, held.name, enclosing_id, symbol_id, CAST(4 AS BIGINT) AS role FROM held JOIN cand ON held.name = cand.name WHERE rank = 1",
    "edge": "SELECT DISTINCT enclosing_id AS src, symbol_id AS dst, CAST(1 AS BIGINT) AS kind, CAST(0 AS BIGINT) AS provenance, CAST(1 AS BIGINT) AS resolution FROM held JOIN cand ON held.name = cand.name",
    "hub": "SELECT dst AS id FROM edge GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1",
    "hit": "SELECT symbol_id, name_path, file.path AS file, start_line AS line, end_line, symbol.kind AS kind, name FROM symbol JOIN file ON symbol.file_id = file.file_id",
    # the precise index of the fixture
    "pdoc": "SELECT file_id, 'file:///repo/'||l AS project_root, s||'/d'||file_id||'.'||ext AS relative_path, path FROM doc WHERE file_id % 3 = 0",
    "defs": "SELECT p.project_root, p.path, 's'||y.name AS sy, y.symbol_id AS ordinal, p.file_id, y.sel_line FROM pdoc p JOIN symbol y ON y.file_id = p.file_id",
    "lastline": "SELECT file_id, sel_line, max(symbol_id) AS sid FROM symbol GROUP BY file_id, sel_line",
    "smap": "SELECT project_root, sy AS symbol, sid AS symbol_id, kind FROM (SELECT d.project_root, d.sy, t.sid, y.kind, row_number() OVER (PARTITION BY d.project_root, d.sy ORDER BY d.path DESC, d.ordinal DESC) AS r FROM defs d JOIN lastline t ON t.file_id = d.file_id AND t.sel_line = d.sel_line JOIN symbol y ON y.symbol_id = t.sid) WHERE r = 1",
    "sedge": "SELECT DISTINCT h.enclosing_id AS src, s.symbol_id AS dst, CAST(1 AS BIGINT) AS kind, CAST(2 AS BIGINT) AS provenance, CAST(0 AS BIGINT) AS resolution FROM held h JOIN pdoc p ON p.file_id = h.file_id JOIN smap s ON s.project_root = p.project_root AND s.symbol = 's'||h.name WHERE s.kind IN (0, 1)",
    "covered": "SELECT DISTINCT file_id FROM pdoc",
    "left_": "SELECT e.* FROM edge e WHERE NOT EXISTS (SELECT 1 FROM symbol y JOIN covered c ON c.file_id = y.file_id WHERE y.symbol_id = e.src)",
    "mixed": "SELECT * FROM left_ UNION ALL SELECT * FROM sedge",
    "keyed": "SELECT *, sha256(path||chr(0)||name_path||chr(0)||kind||chr(0)||nth) AS symbol_key FROM (SELECT symbol.*, file.path, row_number() OVER (PARTITION BY symbol.file_id, name_path, symbol.kind ORDER BY start_line, symbol_id) - 1 AS nth FROM symbol JOIN file ON file.file_id = symbol.file_id)",
}
ORDER = list(CTES)
LOWER = lambda c: f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def sql(body: str, extra: str = "") -> str:
    """body after the tables that it names, and those that they name."""
    import re

    need, todo = set(), [body + " " + extra]
    while todo:
        for name in set(re.findall(r"\w+", todo.pop())) & CTES.keys() - need:
            need.add(name)
            todo.append(CTES[name])
    parts = [f"{n} AS {'MATERIALIZED ' if n in ('symbol', 'edge', 'line', 'call', 'held') else ''}({CTES[n]})" for n in ORDER if n in need]
    return "WITH RECURSIVE " + ",\n".join([*parts, *([extra] if extra else [])]) + "\n" + body


def walk_sql(depth: int, forward: bool, root: str = "(SELECT id FROM hub)", edge: str = "edge") -> str:
    a, b = ("src", "dst") if forward else ("dst", "src")
    return f"w(sym, depth) AS (SELECT CAST({root} AS BIGINT), CAST(0 AS BIGINT) UNION SELECT e.{b}, w.depth + 1 FROM {edge} e JOIN w ON e.{a} = w.sym WHERE w.depth < {depth}), walked AS (SELECT sym, min(depth) AS depth FROM w WHERE sym <> {root} GROUP BY sym)"


HIT = "symbol_id, name_path, file, line, end_line, kind"
WALKED = f"SELECT {HIT}, depth, CAST(0 AS BIGINT) AS provenance, CAST(1 AS BIGINT) AS resolution FROM walked JOIN hit ON hit.symbol_id = walked.sym"


def entry(oracle: str | None = None, extra: str = ""):
    """Register a query, and its SQL twin if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = sql(oracle, extra)
        return f

    return add


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) if c in names else F.col(c) for c in df.columns])


# --- sources -------------------------------------------------------------------------------------------------------


@entry(f"SELECT path, {LABELS} AS lang FROM doc")
def detect_lang(spark, d):
    return fixture.documents(spark, d).select("path", text.detect_lang(F.col("path")).alias("lang"))


@entry("SELECT file_id, CAST(strlen(content) <= 2097152 AND NOT contains(content, chr(0)) AS BOOLEAN) AS kept FROM doc")
def binary_filter(spark, d):
    return fixture.documents(spark, d).select("file_id", text.indexable(F.col("content").cast("binary")).alias("kept"))


@entry(f"SELECT {LABELS} AS lang, count(*) AS files FROM doc WHERE {LABELS} IS NOT NULL GROUP BY 1")
def lang_histogram(spark, d):
    lang = text.detect_lang(F.col("path"))
    return fixture.documents(spark, d).select(lang.alias("lang")).filter("lang is not null").groupBy("lang").agg(F.count("*").alias("files"))


@entry("SELECT path, index_unit FROM file")
def index_unit(spark, d):
    files = fixture.documents(spark, d)
    return fixture.index_units(files, fixture.manifests(files))


@entry("SELECT dir, CASE WHEN path LIKE '%/package.json' THEN 'npm' ELSE 'cargo' END AS kind FROM manifest")
def detect_units(spark, d):
    found = fixture.manifests(fixture.documents(spark, d)).select("path", text.dirname(F.col("path")).alias("dir"), text.manifest_kind(F.col("path")).alias("kind"))
    return found.filter("kind is not null").groupBy("dir").agg(F.min_by("kind", "path").alias("kind"))


@entry("SELECT file_id, content_hash FROM file")
def content_hash(spark, d):
    return fixture.documents(spark, d).select("file_id", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"))


@entry("SELECT file_id, line_no, CAST(coalesce(sum(strlen(line) + 1) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_ FROM line")
def line_offsets(spark, d):
    return fixture.documents(spark, d).select("file_id", F.posexplode(text.line_offsets(F.col("content"))).alias("p", "offset_")).select("file_id", (F.col("p") + 1).cast("long").alias("line_no"), "offset_")


@entry("SELECT file_id, line_no, CAST(coalesce(lag(strlen(line) + 1) OVER (PARTITION BY file_id ORDER BY line_no), 0) AS BIGINT) AS delta, true AS round_trip FROM line")
def delta_offsets(spark, d):
    o = fixture.documents(spark, d).select("file_id", text.line_offsets(F.col("content")).alias("o")).withColumn("d", text.deltas(F.col("o")))
    return o.select("file_id", (text.undeltas(F.col("d")) == F.col("o")).alias("round_trip"), F.posexplode("d").alias("p", "delta")).select("file_id", (F.col("p") + 1).cast("long").alias("line_no"), "delta", "round_trip")


@entry("SELECT d.file_id, CAST(coalesce(sum(CASE WHEN line_no < 2 THEN strlen(line) + 1 END), 0) AS BIGINT) AS from_, CAST(least(sum(CASE WHEN line_no <= 3 THEN strlen(line) + 1 ELSE 0 END), strlen(any_value(d.content))) AS BIGINT) AS to_ FROM doc d JOIN line ON line.file_id = d.file_id GROUP BY d.file_id HAVING count(*) >= 2")
def byte_span(spark, d):
    o = fixture.documents(spark, d).select("file_id", text.line_offsets(F.col("content")).alias("o"), F.octet_length("content").cast("long").alias("n")).filter(F.size("o") >= 2)
    a, b = text.byte_span(F.col("o"), F.col("n"), F.lit(2), F.lit(3))
    return o.select("file_id", a.cast("long").alias("from_"), b.cast("long").alias("to_"))


GIT = "CASE doc.file_id % 6 WHEN 0 THEN 'D' WHEN 1 THEN 'R' WHEN 2 THEN 'M' WHEN 3 THEN '??' WHEN 4 THEN ' D' ELSE '->' END"


def git_lines(spark, d) -> DataFrame:
    f, k = fixture.documents(spark, d), F.col("file_id") % 6
    line = F.when(k == 0, F.concat(F.lit("D\t"), "path")).when(k == 1, F.concat(F.lit("R100\t"), "path", F.lit("\tmoved/"), "path")).when(k == 2, F.concat(F.lit("M\t"), "path"))
    line = line.when(k == 3, F.concat(F.lit('?? "'), "path", F.lit('"'))).when(k == 4, F.concat(F.lit(" D "), "path")).otherwise(F.concat(F.lit("R  "), "path", F.lit(" -> moved/"), "path"))
    return f.select(F.when(k < 3, "diff").otherwise("status").alias("source"), line.alias("line"))


GIT_CHANGES = f"git AS (SELECT path, CASE WHEN {GIT} IN ('M','??') THEN 'changed' ELSE 'deleted' END AS change FROM doc UNION SELECT 'moved/'||path, 'changed' FROM doc WHERE {GIT} IN ('R','->'))"


@entry("SELECT path, change FROM git", GIT_CHANGES)
def git_status_parse(spark, d):
    return maintain.git_status(git_lines(spark, d))


@entry("SELECT path, CASE change WHEN 'deleted' THEN 'prune' ELSE 'index' END AS action FROM git", GIT_CHANGES)
def git_changeset(spark, d):
    return maintain.git_changeset(maintain.git_status(git_lines(spark, d)))


# --- call resolution -----------------------------------------------------------------------------------------------


@entry("SELECT c.file_id, c.line_no, c.name, h.enclosing_id FROM call c LEFT JOIN held h ON h.file_id = c.file_id AND h.line_no = c.line_no AND h.name = c.name")
def innermost_callable(spark, d):
    g = fixture.graph(spark, d)
    return resolve.innermost(g.call, g.symbol, True)


@entry("SELECT name, symbol_id, rank FROM cand")
def call_candidates(spark, d):
    return resolve.candidates(fixture.graph(spark, d).symbol)


@entry("SELECT * FROM occurrence")
def call_occurrences(spark, d):
    g = fixture.graph(spark, d)
    return resolve.occurrences(g.call, g.symbol)


@entry("SELECT * FROM edge")
def call_edges(spark, d):
    g = fixture.graph(spark, d)
    return resolve.edges(g.call, g.symbol)


@entry("SELECT DISTINCT enclosing_id AS src, symbol_id AS dst, CAST(1 AS BIGINT) AS kind, file_id, line_no FROM held JOIN cand ON held.name = cand.name")
def call_sites(spark, d):
    g = fixture.graph(spark, d)
    return resolve.call_sites(g.call, g.symbol)


@entry("SELECT src, dst, kind, CAST(CASE WHEN EXISTS (SELECT 1 FROM symbol y WHERE y.symbol_id = e.src AND y.file_id % 5 = 0) THEN 0 ELSE 2 END AS BIGINT) AS provenance, resolution FROM edge e")
def replace_file_edges(spark, d):
    g = fixture.graph(spark, d)
    old = g.edge.withColumn("provenance", F.lit(model.SCIP).cast("long"))
    return resolve.replaced(old, g.edge, g.symbol, g.file.filter("file_id % 5 = 0"))


# --- precise edges -------------------------------------------------------------------------------------------------


def mixed(spark, d) -> tuple[fixture.CodeGraph, DataFrame, DataFrame]:
    """The graph, the documents of its precise index, and all edges after the ingest."""
    g = fixture.graph(spark, d)
    docs = precise.documents(fixture.precise(g), g.file, "/repo")
    kept = precise.superseded(precise.without_scip(g.edge), g.symbol, docs.select("file_id").distinct())
    return g, docs, precise.inserted(kept, precise.scip_edges(docs, g.symbol))


@entry("SELECT * FROM left_")
def scip_drop_previous(spark, d):
    g, _, edges = mixed(spark, d)
    return precise.without_scip(edges).select("src", "dst", "kind", "provenance", "resolution")


@entry("SELECT file_id, count(*) AS occurrences FROM (SELECT file_id FROM defs UNION ALL SELECT c.file_id FROM call c JOIN covered v ON v.file_id = c.file_id) GROUP BY file_id")
def scip_documents(spark, d):
    _, docs, _ = mixed(spark, d)
    return docs.groupBy("file_id").agg(F.count("*").alias("occurrences"))


@entry("SELECT project_root, symbol, symbol_id, kind FROM smap")
def scip_symbol_map(spark, d):
    g, docs, _ = mixed(spark, d)
    return precise.symbol_map(docs, g.symbol)


@entry("SELECT * FROM left_")
def scip_supersede(spark, d):
    g = fixture.graph(spark, d)
    return precise.superseded(g.edge, g.symbol, g.file.filter("file_id % 3 = 0"))


@entry("SELECT * FROM sedge")
def scip_edges(spark, d):
    g, docs, _ = mixed(spark, d)
    return precise.scip_edges(docs, g.symbol)


# covered files are those with an occurrence
@entry("SELECT CAST(c AS BIGINT) AS covered, CAST(t AS BIGINT) AS total, CAST(floor(c * 100 / t) AS BIGINT) AS pct, floor(c * 100 / t) < 50 AS warn FROM (SELECT (SELECT count(DISTINCT file_id) FROM (SELECT file_id FROM defs UNION ALL SELECT c.file_id FROM call c JOIN covered v ON v.file_id = c.file_id)) AS c, (SELECT count(*) FROM file) AS t)")
def scip_coverage(spark, d):
    g, docs, _ = mixed(spark, d)
    return precise.coverage(docs.select("file_id"), g.file)


@entry("SELECT coalesce(e.src, n.src) AS src, coalesce(e.dst, n.dst) AS dst, CAST(1 AS BIGINT) AS kind, CAST(CASE WHEN n.src IS NULL THEN e.provenance ELSE 3 END AS BIGINT) AS provenance, CAST(CASE WHEN n.src IS NULL THEN e.resolution ELSE 0 END AS BIGINT) AS resolution FROM edge e FULL OUTER JOIN n ON n.src = e.src AND n.dst = e.dst", "n AS (SELECT src, dst FROM edge WHERE src % 7 = 0 AND src <> dst UNION SELECT dst, src FROM edge WHERE src % 11 = 0 AND src <> dst)")
def lsp_upsert(spark, d):
    g = fixture.graph(spark, d)
    confirmed = g.edge.filter("src % 7 = 0").select("src", "dst").union(g.edge.filter("src % 11 = 0").select("dst", "src"))
    return precise.lsp_upserted(g.edge, confirmed)


@entry("SELECT c.file_id, c.line_no, c.name, coalesce(x.sid, h.enclosing_id) AS symbol_id FROM call c LEFT JOIN (SELECT file_id, sel_line, min(symbol_id) AS sid FROM symbol GROUP BY ALL) x ON x.file_id = c.file_id AND x.sel_line = c.line_no LEFT JOIN held h ON h.file_id = c.file_id AND h.line_no = c.line_no AND h.name = c.name")
def symbol_at(spark, d):
    g = fixture.graph(spark, d)
    return precise.symbol_at(g.call, g.symbol)


# --- lookups -------------------------------------------------------------------------------------------------------


@entry(f"SELECT {HIT} FROM hit WHERE name = 'that' OR name_path = 'that' OR {LOWER('name')} LIKE '%t_at%' ORDER BY (name = 't_at' OR name_path = 't_at') DESC, length(name), symbol_id LIMIT 25")
def resolve_names(spark, d):
    g = fixture.graph(spark, d)
    return query.resolve(g.symbol, g.file, "t_at")


@entry(f"SELECT symbol_id AS id FROM hit WHERE name = 'With' OR name_path = 'With' OR {LOWER('name')} LIKE '%with%' ORDER BY (name = 'With' OR name_path = 'With') DESC, length(name), symbol_id LIMIT 1")
def resolve_arg(spark, d):
    g = fixture.graph(spark, d)
    return spark.createDataFrame([(query.resolve_arg(g.symbol, g.file, "With"),)], "id long")


@entry(f"SELECT {HIT} FROM hit WHERE file = (SELECT path FROM doc WHERE file_id = 6)")
def outline(spark, d):
    g = fixture.graph(spark, d)
    path = fixture.documents(spark, d).filter("file_id = 6").first()["path"]
    return query.outline(g.symbol, g.file, path)


FOLD = f"translate(lower(name_path), '{query.ACCENTED}', '{''.join(map(query.folded, query.ACCENTED))}')"


@entry(f"SELECT {HIT} FROM hit WHERE len(list_filter(string_split_regex({FOLD}, '[^a-z0-9]+'), lambda x: starts_with(x, 'then'))) > 0 ORDER BY symbol_id LIMIT 30")
def search_prefix(spark, d):
    g = fixture.graph(spark, d)
    return query.search(g.symbol, g.file, "Then!")


@entry(f"SELECT {HIT} FROM hit WHERE contains({LOWER('name')}, 'ing') OR contains({LOWER('name_path')}, 'ing') ORDER BY symbol_id LIMIT 30")
def search_text(spark, d):
    g = fixture.graph(spark, d)
    return query.search(g.symbol, g.file, "ING", "text")


GREP = "g AS (SELECT doc.path AS file, line.file_id, line_no, CASE WHEN length(trim(line)) > 200 THEN substr(trim(line), 1, 200)||'…' ELSE trim(line) END AS text FROM line JOIN doc ON doc.file_id = line.file_id WHERE regexp_matches(line, '(?i)thea[a-z]+ [a-z]+on') ORDER BY file, line_no LIMIT 50)"


@entry("SELECT file, line_no AS line, text FROM g", GREP)
def grep(spark, d):
    g = fixture.graph(spark, d)
    return query.grep(g.line, g.file, g.symbol, "thea[a-z]+ [a-z]+on", True).select("file", "line", "text")


@entry("SELECT file, line_no AS line, enclosing_id, enclosing FROM (SELECT g.file, g.line_no, y.symbol_id AS enclosing_id, y.name_path AS enclosing, row_number() OVER (PARTITION BY g.file_id, g.line_no ORDER BY y.end_line - y.start_line, y.symbol_id) AS r FROM g LEFT JOIN symbol y ON y.file_id = g.file_id AND g.line_no BETWEEN y.start_line AND y.end_line) WHERE r = 1", GREP)
def grep_enclosing(spark, d):
    g = fixture.graph(spark, d)
    return query.grep(g.line, g.file, g.symbol, "thea[a-z]+ [a-z]+on", True).select("file", "line", "enclosing_id", "enclosing")


# --- walks ---------------------------------------------------------------------------------------------------------


def walked(spark, d, depth: int, limit: int, forward: bool) -> DataFrame:
    g = fixture.graph(spark, d)
    return graph.walk(g.edge, g.symbol, g.file, fixture.hub(g), depth, limit, forward)


@entry(f"{WALKED} ORDER BY depth, name_path, symbol_id LIMIT 50", walk_sql(1, False))
def callers(spark, d):
    return walked(spark, d, 1, 50, False)


@entry(f"{WALKED} ORDER BY depth, name_path, symbol_id LIMIT 50", walk_sql(2, True, "(SELECT src FROM edge GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)"))
def callees(spark, d):
    g = fixture.graph(spark, d)
    busiest = g.edge.groupBy("src").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "src").first()["src"]
    return graph.walk(g.edge, g.symbol, g.file, busiest, 2, 50, True)


@entry(f"{WALKED} ORDER BY depth, name_path, symbol_id LIMIT 80", walk_sql(4, False))
def impact(spark, d):
    return walked(spark, d, 4, 80, False)


@entry(f"SELECT * FROM ({WALKED} ORDER BY depth, name_path, symbol_id LIMIT 1000) a WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE e.dst = a.symbol_id) ORDER BY depth, name_path, symbol_id LIMIT 40", walk_sql(6, False))
def trace_roots(spark, d):
    g = fixture.graph(spark, d)
    return graph.trace_roots(g.edge, g.symbol, g.file, fixture.hub(g))


@entry("SELECT sym AS symbol_id, depth FROM walked ORDER BY depth, sym LIMIT 500", walk_sql(3, True))
def traverse(spark, d):
    g = fixture.graph(spark, d)
    return graph.traverse(g.edge, fixture.hub(g), model.CALLS, 3, 500)


NODES = walk_sql(2, False) + f", node AS (SELECT symbol_id FROM ({WALKED} ORDER BY depth, name_path, symbol_id LIMIT 1000) UNION SELECT id FROM hub)"


@entry("SELECT node.symbol_id, name_path FROM node JOIN symbol ON symbol.symbol_id = node.symbol_id", NODES)
def subgraph_nodes(spark, d):
    g = fixture.graph(spark, d)
    return graph.subgraph(g.edge, g.symbol, g.file, fixture.hub(g))[0]


@entry("SELECT src, dst, provenance, resolution FROM edge WHERE src IN (SELECT symbol_id FROM node) AND dst IN (SELECT symbol_id FROM node)", NODES)
def subgraph_edges(spark, d):
    g = fixture.graph(spark, d)
    return graph.subgraph(g.edge, g.symbol, g.file, fixture.hub(g))[1]


@entry("SELECT y.name_path AS enclosing, doc.path AS file, o.line_no AS line, o.role FROM occurrence o JOIN doc ON doc.file_id = o.file_id LEFT JOIN symbol y ON y.symbol_id = o.enclosing_id WHERE o.symbol_id = (SELECT symbol_id FROM occurrence GROUP BY symbol_id ORDER BY count(*) DESC, symbol_id LIMIT 1) ORDER BY file, line, enclosing LIMIT 100")
def references(spark, d):
    g = fixture.graph(spark, d)
    top = g.occurrence.groupBy("symbol_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "symbol_id").first()["symbol_id"]
    return query.references(g.occurrence, g.symbol, g.file, top)


@entry(f"SELECT {HIT} FROM hit WHERE {LOWER('name_path')} LIKE 'th%/%' AND kind IN (8, 9, 10) ORDER BY line, symbol_id LIMIT 100")
def variables(spark, d):
    g = fixture.graph(spark, d)
    return query.variables(g.symbol, g.file, "Th%")


@entry("SELECT symbol_id, name_path, file, start_line, end_line, string_agg(line, chr(10) ORDER BY line_no) AS code FROM (SELECT y.symbol_id, y.name_path, doc.path AS file, y.start_line, y.end_line, l.line_no, l.line FROM symbol y JOIN doc ON doc.file_id = y.file_id JOIN line l ON l.file_id = y.file_id AND l.line_no BETWEEN y.start_line AND y.end_line WHERE y.symbol_id IN (1, 2, 3, 5, 8, 13, 21)) GROUP BY ALL")
def read_symbol(spark, d):
    g = fixture.graph(spark, d)
    return query.read_symbol(g.symbol, g.file, g.line, [1, 2, 3, 5, 8, 13, 21])


@entry(f"SELECT {HIT}, (SELECT count(*) FROM edge WHERE dst = id AND src <> id) AS callers, (SELECT count(*) FROM edge WHERE src = id AND dst <> id) AS callees FROM hit JOIN hub ON hub.id = hit.symbol_id")
def inspect(spark, d):
    g = fixture.graph(spark, d)
    return query.inspect(g.symbol, g.file, g.edge, fixture.hub(g))


@entry("SELECT 'file' AS name, count(*) AS n FROM file UNION ALL SELECT 'symbol', count(*) FROM symbol UNION ALL SELECT 'occurrence', count(*) FROM occurrence UNION ALL SELECT 'edge', count(*) FROM edge")
def status_counts(spark, d):
    g = fixture.graph(spark, d)
    return query.status_counts(file=g.file, symbol=g.symbol, occurrence=g.occurrence, edge=g.edge)


@entry("SELECT index_unit AS unit, count(*) AS files, count(g.file_id) AS precise, CAST(floor(count(g.file_id) * 100 / count(*)) AS BIGINT) AS pct FROM file LEFT JOIN (SELECT DISTINCT y.file_id FROM symbol y JOIN (SELECT src AS id FROM sedge UNION SELECT dst FROM sedge) x ON x.id = y.symbol_id) g ON g.file_id = file.file_id GROUP BY index_unit")
def unit_coverage(spark, d):
    g, _, edges = mixed(spark, d)
    return query.unit_coverage(g.file, g.symbol, edges)


# --- output --------------------------------------------------------------------------------------------------------

ROWS = f"r AS (SELECT symbol_id, 'sym:'||symbol_id||' | '||name_path||' | '||file||':'||line||'-'||end_line||' | '||(CASE kind WHEN 0 THEN 'function' WHEN 1 THEN 'method' WHEN 7 THEN 'module' WHEN 8 THEN 'field' END) AS row FROM hit)"


def hit_rows(spark, d) -> DataFrame:
    g = fixture.graph(spark, d)
    found = graph.hits(g.symbol, g.file)
    return found.select("symbol_id", project.hit_row(found).alias("row"))


@entry("SELECT symbol_id, row FROM r", ROWS)
def render_hits(spark, d):
    return hit_rows(spark, d)


@entry("SELECT symbol_id, row, used FROM (SELECT symbol_id, row, CAST(28 + sum(strlen(row) // 4 + 1) OVER (ORDER BY symbol_id) AS BIGINT) AS used FROM r) WHERE used <= 22000", ROWS)
def token_budget(spark, d):
    out = project.budgeted(hit_rows(spark, d), ["symbol_id"], "outline", "sym | name_path | file:lines | kind", "read")
    return longs(out.withColumn("used", F.col("used") - F.lit(project.estimate("outline") + project.estimate("sym | name_path | file:lines | kind") + project.estimate("read") + 8 - 28)).filter("used <= 22000"), "used")


KIND_SQL = "(CASE {} WHEN 0 THEN 'function' WHEN 1 THEN 'method' WHEN 7 THEN 'module' WHEN 8 THEN 'field' END)"


@entry(f"SELECT symbol_id, 'sym:'||symbol_id||' | '||name_path||' | '||file||':'||line||'-'||end_line||' | '||{KIND_SQL.format('kind')}||' | '||depth||' | ts/ambiguous' AS row FROM ({WALKED} ORDER BY depth, name_path, symbol_id LIMIT 80)", walk_sql(4, False))
def render_walk(spark, d):
    rows = walked(spark, d, 4, 80, False)
    return rows.select("symbol_id", project.edge_row(rows).alias("row"))


@entry("SELECT o.file_id, o.line_no, o.name, coalesce(y.name_path, '(top-level)')||' | '||doc.path||':'||o.line_no||' | call' AS row FROM occurrence o JOIN doc ON doc.file_id = o.file_id LEFT JOIN symbol y ON y.symbol_id = o.enclosing_id")
def render_refs(spark, d):
    g = fixture.graph(spark, d)
    held = g.occurrence.join(g.symbol.select(F.col("symbol_id").alias("enclosing_id"), F.col("name_path").alias("enclosing")), "enclosing_id", "left")
    held = held.join(g.file.select("file_id", F.col("path").alias("file")), "file_id").withColumn("line", F.col("line_no"))
    return held.select("file_id", "line_no", "name", project.ref_row(held).alias("row"))


@entry("SELECT file||':'||line_no||' | '||coalesce('sym:'||enclosing_id||' '||enclosing, '-')||' | '||text AS row FROM (SELECT g.file, g.line_no, g.text, y.symbol_id AS enclosing_id, y.name_path AS enclosing, row_number() OVER (PARTITION BY g.file_id, g.line_no ORDER BY y.end_line - y.start_line, y.symbol_id) AS r FROM g LEFT JOIN symbol y ON y.file_id = g.file_id AND g.line_no BETWEEN y.start_line AND y.end_line) WHERE r = 1", GREP)
def render_grep(spark, d):
    g = fixture.graph(spark, d)
    rows = query.grep(g.line, g.file, g.symbol, "thea[a-z]+ [a-z]+on", True)
    return rows.select(project.grep_row(rows).alias("row"))


@entry(f"SELECT {HIT}, (SELECT count(*) FROM symbol) > 40 AS cut FROM hit ORDER BY symbol_id LIMIT 40")
def limit_probe(spark, d):
    g = fixture.graph(spark, d)
    rows, cut = project.probed(graph.hits(g.symbol, g.file).orderBy("symbol_id"), 40)
    return rows.withColumn("cut", F.lit(cut))


@entry("SELECT y.symbol_id, CAST(0 AS BIGINT) AS line_no, '# sym:'||y.symbol_id||' '||name_path||'  '||doc.path||':'||start_line||'-'||end_line AS text FROM symbol y JOIN doc ON doc.file_id = y.file_id UNION ALL SELECT y.symbol_id, l.line_no, printf('%5d  ', l.line_no)||l.line FROM symbol y JOIN line l ON l.file_id = y.file_id AND l.line_no BETWEEN y.start_line AND y.end_line")
def render_code(spark, d):
    g = fixture.graph(spark, d)
    return project.rendered_code(g.symbol, g.file, g.line)


def export(spark, d, form: str) -> DataFrame:
    g = fixture.graph(spark, d)
    root = fixture.hub(g)
    return project.exported(*graph.subgraph(g.edge, g.symbol, g.file, root), root, form)


PART = "CAST({} AS BIGINT) AS part, CAST({} AS BIGINT) AS a, CAST({} AS BIGINT) AS b, "


@entry(
    "SELECT " + PART.format(0, 0, 0) + """'digraph calls {'||chr(10)||'  rankdir=LR;'||chr(10)||'  node [shape=box, fontname="monospace"];' AS line UNION ALL SELECT 3, 0, 0, '}' """
    """UNION ALL SELECT 1, y.symbol_id, 0, '  n'||y.symbol_id||' [label="'||replace(replace(y.name_path, chr(92), chr(92)||chr(92)), '"', chr(92)||'"')||'"'||CASE WHEN y.symbol_id = (SELECT id FROM hub) THEN ', style=filled, fillcolor="#e0e7ff"' ELSE '' END||'];' FROM node JOIN symbol y ON y.symbol_id = node.symbol_id """
    """UNION ALL SELECT 2, src, dst, '  n'||src||' -> n'||dst||' [color="#ea580c"];' FROM edge WHERE src IN (SELECT symbol_id FROM node) AND dst IN (SELECT symbol_id FROM node)""",
    NODES,
)
def export_dot(spark, d):
    return export(spark, d, "dot")


@entry(
    "SELECT " + PART.format(0, 0, 0) + """'flowchart LR' AS line UNION ALL SELECT 1, y.symbol_id, 0, '  n'||y.symbol_id||'["'||replace(y.name_path, '"', '&quot;')||'"]' FROM node JOIN symbol y ON y.symbol_id = node.symbol_id """
    """UNION ALL SELECT 2, src, dst, '  n'||src||' --> n'||dst FROM edge WHERE src IN (SELECT symbol_id FROM node) AND dst IN (SELECT symbol_id FROM node)""",
    NODES,
)
def export_mermaid(spark, d):
    return export(spark, d, "mermaid")


# --- maintenance ---------------------------------------------------------------------------------------------------


@entry("SELECT symbol_key, 'keep' AS action, symbol_id FROM keyed WHERE file_id % 5 <> 0 AND file_id % 4 <> 0 UNION ALL SELECT symbol_key, 'delete', symbol_id FROM keyed WHERE file_id % 5 <> 0 AND file_id % 4 = 0 UNION ALL SELECT symbol_key, 'insert', (SELECT max(symbol_id) FROM keyed WHERE file_id % 5 <> 0) + row_number() OVER (ORDER BY symbol_key) FROM keyed WHERE file_id % 5 = 0 AND file_id % 4 <> 0")
def symbol_reconcile(spark, d):
    k = fixture.keyed(fixture.graph(spark, d))
    return longs(maintain.reconciled(k.filter("file_id % 5 <> 0"), k.filter("file_id % 4 <> 0")), "symbol_id")


@entry("SELECT path, CASE WHEN file_id % 7 = 0 THEN 'added' WHEN file_id % 11 = 0 THEN 'deleted' WHEN file_id % 5 = 0 THEN 'changed' ELSE 'unchanged' END AS change FROM file WHERE NOT (file_id % 7 = 0 AND file_id % 11 = 0)")
def fs_diff(spark, d):
    files = fixture.graph(spark, d).file
    old = files.filter("file_id % 7 <> 0").withColumn("mtime_ns", F.lit(1))
    # every third file was touched, every fifth has other bytes as well
    new = files.filter("file_id % 11 <> 0").withColumn("mtime_ns", F.when(F.col("file_id") % 3 == 0, 2).otherwise(1)).withColumn("size", F.col("size") + F.when(F.col("file_id") % 5 == 0, 1).otherwise(0))
    return maintain.fs_diff(old, new.withColumn("content_hash", F.when(F.col("file_id") % 5 == 0, "other").otherwise(F.col("content_hash"))))


@entry("SELECT 'file' AS name, count(*) AS n FROM file WHERE file_id % 5 <> 0 UNION ALL SELECT 'symbol', count(*) FROM symbol WHERE file_id % 5 <> 0 UNION ALL SELECT 'edge', count(*) FROM edge e JOIN symbol a ON a.symbol_id = e.src JOIN symbol b ON b.symbol_id = e.dst WHERE a.file_id % 5 <> 0 AND b.file_id % 5 <> 0 UNION ALL SELECT 'occurrence', count(*) FROM occurrence WHERE file_id % 5 <> 0 UNION ALL SELECT 'forgotten', count(*) FROM occurrence o JOIN symbol y ON y.symbol_id = o.symbol_id WHERE o.file_id % 5 <> 0 AND y.file_id % 5 = 0")
def prune_cascade(spark, d):
    g = fixture.graph(spark, d)
    left = maintain.pruned(g.file, g.symbol, g.edge, g.occurrence, g.file.filter("file_id % 5 = 0"))
    return query.status_counts(**left, forgotten=left["occurrence"].filter("symbol_id is null"))


STRINGS = "pool AS (SELECT text, row_number() OVER (ORDER BY text) AS id FROM (SELECT path AS text FROM file UNION SELECT index_unit FROM file UNION SELECT name FROM symbol UNION SELECT name_path FROM symbol))"


@entry("SELECT CAST(id AS BIGINT) AS id, text FROM pool", STRINGS)
def string_pool(spark, d):
    g = fixture.graph(spark, d)
    return longs(maintain.interned(maintain.strings(g.file, g.symbol)), "id")


@entry("SELECT CAST(id AS BIGINT) AS id, text FROM pool WHERE text NOT IN (SELECT path FROM file WHERE file_id % 5 <> 0 UNION SELECT index_unit FROM file WHERE file_id % 5 <> 0 UNION SELECT name FROM symbol WHERE file_id % 5 <> 0 UNION SELECT name_path FROM symbol WHERE file_id % 5 <> 0)", STRINGS)
def gc_orphans(spark, d):
    g = fixture.graph(spark, d)
    pool = maintain.interned(maintain.strings(g.file, g.symbol))
    return longs(maintain.orphans(pool, g.file.filter("file_id % 5 <> 0"), g.symbol.filter("file_id % 5 <> 0")), "id")


# --- extraction ----------------------------------------------------------------------------------------------------


def extracted(language: str) -> Callable[[SparkSession, str], DataFrame]:
    """Symbols and calls of one source file per document, with the document's id in its names."""
    ext, source = cases.SOURCES[language]
    pattern = rf"/d(\d+)\.{ext}$"

    def run(spark, d):
        n = F.col("file_id").cast("string")
        files = fixture.documents(spark, d).select(F.concat(F.lit("src/d"), n, F.lit(f".{ext}")).alias("path"), F.lit(model.EXTENSIONS[ext]).alias("language"), F.replace(F.lit(source), F.lit("{n}"), n).alias("content"))
        kind = F.when(F.col("what") == "call", "call").otherwise(model.labelled(F.col("kind"), model.KINDS))
        return extraction.parsed(files).select(F.regexp_extract("path", pattern, 1).cast("long").alias("file_id"), F.coalesce("name_path", "name").alias("name_path"), "name", kind.alias("kind"), "start_line", "end_line")

    return run


def extracted_sql(language: str) -> str:
    rows = ", ".join(f"('{p}', '{p.rsplit('/', 1)[-1]}', '{k}', {a}, {b})" for p, k, a, b in cases.expected(language))
    number = "'{n}', CAST(file_id AS VARCHAR)"
    return sql(f"SELECT file_id, replace(t.p, {number}) AS name_path, replace(t.n, {number}) AS name, t.k AS kind, CAST(t.a AS BIGINT) AS start_line, CAST(t.b AS BIGINT) AS end_line FROM doc, (VALUES {rows}) t(p, n, k, a, b)")


for _language in cases.SOURCES:
    QUERIES[f"extract_{_language}"] = extracted(_language)
    ORACLES[f"extract_{_language}"] = extracted_sql(_language)


QUERIES |= trees.QUERIES
ORACLES |= trees.ORACLES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {("resolve" if k == "resolve_names" else k): v for k, v in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {("resolve" if k == "resolve_names" else k): v for k, v in ORACLES.items()}
