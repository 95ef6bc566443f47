"""Scalar functions on small values."""

from pyspark.sql import functions as F

from weft.functions import text
from weft.operators import precise, query
from weft.operators.ids import dense_ids
from weft.sources.scan import Rules


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_offsets_and_spans(spark):
    assert values(spark, [("line1\nline2\n\nend",), ("",), ("a\n",), ("é\nb",)], "t string", text.line_offsets(F.col("t"))) == [[0, 6, 12, 13], [0], [0, 2], [0, 3]]
    df = spark.createDataFrame([("aaa\nbbb\nccc\nddd",)], "t string").select(text.line_offsets(F.col("t")).alias("o"), F.octet_length("t").cast("long").alias("n"))
    spans = [(2, 3, (4, 12)), (1, 1, (0, 4)), (4, 9, (12, 15)), (9, 9, (0, 15)), (0, 1, (0, 4))]
    for a, b, want in spans:
        lo, hi = text.byte_span(F.col("o"), F.col("n"), F.lit(a), F.lit(b))
        assert tuple(df.select(lo, hi).first()) == want


def test_like_is_ascii_caseless(spark):
    rows = [("Ärger",), ("ab\\c",), ("aXc",), ("ÄB",)]
    assert values(spark, rows, "t string", text.like(F.col("t"), "ä%")) == [False] * 4
    assert values(spark, rows, "t string", text.like(F.col("t"), "A_C")) == [False, False, True, False]
    assert values(spark, rows, "t string", text.like(F.col("t"), "ab\\c")) == [False, True, False, False]


def test_languages_and_manifests(spark):
    rows = [("a.rs",), ("x/b.test.tsx",), (".rs",), ("x/.rs",), ("a.RS",), ("Makefile",), ("d.x/y",), ("k.kts",)]
    assert values(spark, rows, "p string", text.detect_lang(F.col("p"))) == ["Rust", "Tsx", None, None, None, None, None, "Kotlin"]
    assert values(spark, [("x/A.csproj",), ("go.mod",), ("x/y.toml",)], "p string", text.manifest_kind(F.col("p"))) == ["dotnet", "go", None]


def test_binary_probe(spark):
    rows = [(b"abc",), (b"a\0c",), (b"a" * 8192 + b"\0",), (b"a" * (2 * 1024 * 1024 + 1),), (b"",)]
    assert values(spark, rows, "c binary", text.indexable(F.col("c"))) == [True, False, True, False, True]


def test_full_path(spark):
    rows = [("file:///r", "a.rs"), ("file:///r/u/", "a.rs"), ("/r/u/v", "a.rs"), ("file:///elsewhere", "a.rs"), ("file:///rest", "a.rs")]
    assert values(spark, rows, "p string, q string", precise.full_path(F.col("p"), F.col("q"), "/r/")) == ["a.rs", "u/a.rs", "u/v/a.rs", "a.rs", "a.rs"]


def test_ignore_rules():
    r = Rules({".gitignore": "*.log\n!keep.log\n/build\nout/\n# no\ndocs/**/x?.md\n", "sub/.gitignore": "local\n"})
    ignored = ["a.log", "s/b.log", "build", "build/x", "out/a", "s/out/a", "docs/a/b/xy.md", "sub/local", "sub/q/local"]
    kept = ["keep.log", "s/build", "out", "local", "docs/a/x.md", "a.txt"]
    assert all(map(r.ignored, ignored)) and not any(map(r.ignored, kept))


def test_dense_ids(spark):
    got = dense_ids(spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")), "n", F.floor(F.col("x") / 100), F.col("x")).collect()
    assert all(r["n"] == r["x"] + 1 for r in got) and len(got) == 1000


def test_folding():
    assert query.folded("Éà_Ñ") == "ea_n"
