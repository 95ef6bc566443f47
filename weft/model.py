"""The data model: a directed labelled multigraph of source code, as tables.

Ids, lines, columns and counts are long; lines count from 1, columns from 0. Codes of the enumerations are stored and
never change.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes as stored, and labels.
LANGUAGES = ["JavaScript", "TypeScript", "Python", "Go", "Rust", "Java", "Kotlin", "Swift", "C", "Cpp", "CSharp", "Php", "Clojure", "Tsx"]
KINDS = ["Function", "Method", "Class", "Struct", "Enum", "Interface", "Trait", "Module", "Field", "Variable", "Const", "Test", "Macro", "TypeAlias", "Variant"]
PROVENANCES = ["ts", "sg", "scip", "lsp", "text"]
RESOLUTIONS = ["resolved", "ambiguous", "unresolved"]
ROLES = ["definition", "reference", "read", "write", "call"]
EDGE_KINDS = ["Contains", "Calls", "References", "Reads", "Writes", "Imports", "Extends", "Implements"]
EXTENSIONS = {
    "rs": "Rust", "ts": "TypeScript", "mts": "TypeScript", "cts": "TypeScript", "tsx": "Tsx", "jsx": "Tsx", "js": "Tsx", "mjs": "Tsx", "cjs": "Tsx",
    "py": "Python", "pyi": "Python", "go": "Go", "java": "Java", "cs": "CSharp", "php": "Php", "c": "C", "h": "C", "cc": "Cpp", "cpp": "Cpp", "cxx": "Cpp",
    "hpp": "Cpp", "hh": "Cpp", "hxx": "Cpp", "swift": "Swift", "kt": "Kotlin", "kts": "Kotlin", "clj": "Clojure", "cljs": "Clojure", "cljc": "Clojure", "cljx": "Clojure", "edn": "Clojure",
}
MANIFESTS = {"Cargo.toml": "cargo", "package.json": "npm", "go.mod": "go", "pom.xml": "jvm", "build.gradle": "jvm", "build.gradle.kts": "jvm", "composer.json": "php", "Package.swift": "swift"}
MANIFEST_SUFFIXES = {".csproj": "dotnet", ".sln": "dotnet"}
#: How far an edge of each provenance is trusted, the most first.
TRUST = ["scip", "lsp", "sg", "ts", "text"]

FUNCTION, METHOD, MODULE, FIELD, VARIABLE, CONST = (KINDS.index(k) for k in ("Function", "Method", "Module", "Field", "Variable", "Const"))
CALLABLE = (FUNCTION, METHOD)
CALLS = EDGE_KINDS.index("Calls")
CALL = ROLES.index("call")
TS, SCIP, LSP = (PROVENANCES.index(p) for p in ("ts", "scip", "lsp"))
RESOLVED, AMBIGUOUS = 0, 1

# Fixed limits of the query menu.
MAX_FILE, PROBE = 2 * 1024 * 1024, 8192
CANDIDATES = 8
LINE_CAP = 200
TOKENS = 22_000
WALK_NODES = 1000


def labelled(code: Column, labels: list[str], lower: bool = False) -> Column:
    """The label of a code, `?` for an unknown one."""
    names = F.array(*[F.lit(x.lower() if lower else x) for x in labels])
    return F.coalesce(F.get(names, code.cast("int")), F.lit("?"))


def code_of(label: Column, labels: list[str]) -> Column:
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in labels]), label), F.lit(0)).cast("long") - 1
