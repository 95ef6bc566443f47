"""An index over a small tree of files: build, ask, change, reconcile."""

import os
import random
import subprocess
import time

import pytest

from weft.engine import Index
from weft.operators import graph, maintain, precise, project
from weft.plans.store import Store
from weft.sources import scan


def write(root, files):
    for path, text in files.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


CHAIN = "struct Cfg { max: u32 }\nfn leaf() {}\nfn mid() {\n    leaf();\n}\nfn root_fn() {\n    mid();\n}\n"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    write(root, {
        "Cargo.toml": "", "src/g.rs": CHAIN, "src/url.rs": 'const HOST: &str = "http://a.example";\n', ".env.example": "KEY=http://b.example\n",
        "web/package.json": "{}", "web/a.ts": "export class Cart { total = 0; pay() { return leaf() } }\n", ".gitignore": "out/\n*.gen.rs\n!keep.gen.rs\n",
        "out/x.rs": "fn hidden() {}\n", "src/a.gen.rs": "fn generated() {}\n", "src/keep.gen.rs": "fn kept() {}\n", "notes.md": "fn no() {}\n",
    })
    (root / "src/bin.rs").write_bytes(b"fn binary() {}\0")
    ix = Index(spark, str(root), str(tmp_path_factory.mktemp("store") / "ix"))
    ix.build()
    return ix


def names(df):
    return {r["name_path"] for r in df.collect()}


def test_scan_and_units(index):
    got = {r["path"]: r["index_unit"] for r in index.file.collect()}
    assert got == {"src/g.rs": ".", "src/url.rs": ".", "src/keep.gen.rs": ".", "web/a.ts": "web"}


def test_menu(index):
    assert names(index.impact("leaf")) == {"mid", "root_fn", "Cart/pay"}
    assert names(index.callers("leaf")) == {"mid", "Cart/pay"} and names(index.callees("root_fn", 2)) == {"mid", "leaf"}
    assert names(index.trace("leaf")) == {"root_fn", "Cart/pay"}
    assert {r["enclosing"] for r in index.references("leaf").collect()} == {"mid", "Cart/pay"}
    assert names(index.variables("Cfg")) == {"Cfg/max"} and names(index.outline("src/url.rs")) == {"HOST"}
    assert names(index.search("root")) == {"root_fn"} and names(index.search("ROOT_f")) == {"root_fn"} and names(index.search("oot_")) == set()
    assert names(index.search("oot_F", "text")) == {"root_fn"}
    with pytest.raises(ValueError):
        index.search("x", "semantic")
    with pytest.raises(LookupError):
        index.id_of("nothing_like_it")
    assert index.id_of("sym:77") == 77
    hits = {(r["file"], r["enclosing"]) for r in index.grep("http://[ab]").collect()}
    assert hits == {("src/url.rs", "HOST"), (".env.example", None)}
    assert [r["code"] for r in index.read("mid").collect()] == ["fn mid() {\n    leaf();\n}"]
    r = index.inspect("leaf").first()
    assert (r["callers"], r["callees"]) == (2, 0)
    dot = index.export("leaf", "dot")
    assert dot.startswith("digraph") and "->" in dot and dot.rstrip().endswith("}")
    assert index.export("leaf").startswith("flowchart LR")
    with pytest.raises(ValueError):
        index.export("leaf", "svg")


def test_text_budget(index):
    block = index.text("resolve", index.resolve("l", 3), 1)
    assert "truncated_by=limit" in block and block.count("sym:") == 1
    assert "truncated_by=token" in project.block("x", "f", ["a" * 400] * 10, False, "n", ceiling=250)


def test_reconcile_keeps_ids(spark, tmp_path):
    root = tmp_path / "t"
    write(root, {"a.rs": "fn one() {}\nfn two() { one() }\n", "b.rs": "fn three() {}\n", "keep.rs": "fn four() {}\n"})
    ix = Index(spark, str(root), str(tmp_path / "ix"))
    ix.build()
    before = {r["name"]: (r["symbol_id"], r["start_line"]) for r in ix.symbol.collect()}
    assert ix.reconcile() == {"added": 0, "changed": 0, "deleted": 0, "unchanged": 3}
    write(root, {"a.rs": "// moved\nfn one() {}\nfn two() { one() }\n", "c.rs": "fn five() { four() }\n"})
    os.remove(root / "b.rs")
    assert ix.reconcile() == {"added": 1, "changed": 1, "deleted": 1, "unchanged": 1}
    after = {r["name"]: (r["symbol_id"], r["start_line"]) for r in ix.symbol.collect()}
    assert after["one"] == (before["one"][0], before["one"][1] + 1) and after["four"][0] == before["four"][0] and "three" not in after
    assert after["five"][0] > max(i for i, _ in before.values())
    assert names(ix.callers("four")) == {"five"}


def test_watch(spark, tmp_path):
    root = tmp_path / "t"
    write(root, {"a.rs": "fn one() {}\n"})
    ix = Index(spark, str(root), str(tmp_path / "ix"))
    ix.build()
    q = ix.watch(str(tmp_path / "ck"))
    try:
        q.processAllAvailable()
        write(root, {"b.rs": "fn two() { one() }\n"})
        q.processAllAvailable()
    finally:
        q.stop()
    assert names(ix.callers("one")) == {"two"}


def test_watch_sees_edits_and_deletions(spark, tmp_path):
    root = tmp_path / "t"
    write(root, {"a.rs": "fn one() {}\n", "b.rs": "fn two() { one() }\n", "c.rs": "fn three() { one() }\n"})
    ix = Index(spark, str(root), str(tmp_path / "ix"))
    ix.build()
    q = ix.watch(str(tmp_path / "ck"))
    try:
        q.processAllAvailable()
        write(root, {"b.rs": "fn two() { }\nfn four() { one() }\n"})
        q.processAllAvailable()
        assert names(ix.callers("one")) == {"three", "four"}
        os.remove(root / "c.rs")
        q.processAllAvailable()
        assert names(ix.callers("one")) == {"four"}
    finally:
        q.stop()


def test_ids_are_never_given_twice(spark, tmp_path):
    root = tmp_path / "t"
    write(root, {"a.rs": "fn one() {}\n", "z.rs": "fn zed() {}\n"})
    ix = Index(spark, str(root), str(tmp_path / "ix"))
    ix.build()
    gone = {r["name"]: (r["symbol_id"], r["file_id"]) for r in ix.symbol.collect()}["zed"]
    os.remove(root / "z.rs")
    ix.reconcile()
    write(root, {"y.rs": "fn new() {}\n"})
    ix.reconcile()
    now = {r["name"]: (r["symbol_id"], r["file_id"]) for r in ix.symbol.collect()}["new"]
    assert now[0] > gone[0] and now[1] > gone[1]
    ix.build()
    assert {r["name"]: (r["symbol_id"], r["file_id"]) for r in ix.symbol.collect()}["new"] == now


def test_reconcile_equals_build(spark, tmp_path):
    """After random edits the tables are those of resolving everything anew, by ids of the same symbols."""
    from weft.operators import resolve

    rng, root = random.Random(17), tmp_path / "t"
    body = lambda: "".join(f"fn f{rng.randrange(6)}() {{ f{rng.randrange(6)}(); }}\n" for _ in range(rng.randrange(1, 4)))
    write(root, {f"d{k}/a.rs": body() for k in range(5)})
    ix = Index(spark, str(root), str(tmp_path / "ix"))
    ix.build()
    for step in range(2):
        write(root, {f"d{rng.randrange(7)}/a.rs": body() + f"// {step}\n" for _ in range(2)})
        if step:
            os.remove(root / "d1/a.rs")
        ix.reconcile()
        for mine, whole in ((ix.edge, resolve.edges(ix.call, ix.symbol)), (ix.occurrence, resolve.occurrences(ix.call, ix.symbol))):
            assert sorted(map(tuple, mine.select(whole.columns).collect())) == sorted(map(tuple, whole.collect()))


def test_reconcile_by_git(spark, tmp_path):
    root = tmp_path / "r"
    write(root, {"a.rs": "fn a() {}\n", "b.rs": "fn b() { a() }\n", "u/Cargo.toml": "", "u/c.rs": "fn c() {}\n"})
    run = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", "-C", str(root), *a], check=True, capture_output=True)
    run("init"), run("add", "."), run("commit", "-m", "1")
    ix = Index(spark, str(root), str(tmp_path / "ix"))
    ix.build()
    assert ix.store.meta()["scanner_mode"] == "git"
    assert ix.reconcile() == {"added": 0, "changed": 0, "deleted": 0, "unchanged": 3}
    write(root, {"b.rs": "fn b() { c() }\n", "u/new.rs": "fn n() { a() }\n"})
    run("rm", "a.rs"), run("commit", "-m", "2")
    assert ix.reconcile() == {"added": 1, "changed": 1, "deleted": 1, "unchanged": 1}
    assert {r["path"]: r["index_unit"] for r in ix.file.collect()} == {"b.rs": ".", "u/c.rs": "u", "u/new.rs": "u"} and names(ix.callers("c")) == {"b"}
    run("checkout", "b.rs")  # git reports nothing any more, but the path was looked at in another state
    assert ix.reconcile()["changed"] == 1 and names(ix.callers("c")) == set()


def test_git_changes(spark, tmp_path):
    root = tmp_path / "r"
    write(root, {"a.rs": "fn a() {}\n" * 20, "gone.rs": "fn g() {}\n"})
    run = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", "-C", str(root), *a], check=True, capture_output=True, text=True).stdout.strip()
    run("init"), run("add", "."), run("commit", "-m", "1")
    first = run("rev-parse", "HEAD")
    run("mv", "a.rs", "b.rs"), run("rm", "gone.rs"), run("commit", "-m", "2")
    write(root, {"new/c.rs": "fn c() {}\n"})
    got = {(r["path"], r["action"]) for r in maintain.git_changeset(maintain.git_status(scan.git(spark, str(root), first))).collect()}
    assert got == {("a.rs", "prune"), ("gone.rs", "prune"), ("b.rs", "index"), ("new/c.rs", "index")}


def message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += bytes([number << 3, value])
        else:
            out += bytes([number << 3 | 2, len(value)]) + value
    return out


def test_precise_index(spark, tmp_path):
    root = tmp_path / "r"
    write(root, {"u/Cargo.toml": "", "u/a.rs": "fn callee() {}\nfn caller() {\n  x.callee()\n}\nfn callee2() { callee() }\n"})
    occ = lambda line, sym, role: (2, message((1, bytes([line, 0, 3])), (2, sym.encode()), (3, role)))
    doc = message((1, b"a.rs"), occ(0, "s1", 1), occ(1, "s2", 1), occ(2, "s1", 0))
    (tmp_path / "i.scip").write_bytes(message((1, message((3, f"file://{root}/u".encode()))), (2, doc)))
    ix = Index(spark, str(root), str(tmp_path / "ix"))
    ix.build([str(tmp_path / "i.scip")])
    name = {r["symbol_id"]: r["name"] for r in ix.symbol.collect()}
    assert {(name[r["src"]], name[r["dst"]], r["provenance"], r["resolution"]) for r in ix.edge.collect()} == {("caller", "callee", 2, 0)}
    assert ix.store.meta()["scip_coverage"] == "1/1 (100%)"
    ids = {n: i for i, n in name.items()}
    ix.lsp(spark.createDataFrame([(ids["callee2"], ids["callee"]), (ids["caller"], ids["callee"]), (1, 1)], "src long, dst long"))
    assert {(name[r["src"]], r["provenance"]) for r in ix.edge.collect()} == {("caller", 3), ("callee2", 3)}
    ix.lsp(spark.createDataFrame([(ids["callee2"], "u/a.rs", 2), (ids["callee2"], "u/none.rs", 1)], "src long, path string, line_no long"))
    assert (ids["callee2"], ids["caller"]) in {(r["src"], r["dst"]) for r in ix.edge.collect()}
    assert {r["key"]: r["value"] for r in ix.metas().collect()}["version"] == "3" and ix.gc() == 2 and ix.gc() == 0
    os.remove(root / "u/a.rs")
    with pytest.raises(LookupError):
        ix.read(f"sym:{ids['caller']}")


def test_precise_edges_survive_a_reconcile(spark, tmp_path):
    root = tmp_path / "r"
    write(root, {"u/a.rs": "fn callee() {}\nfn caller() {\n  x.callee()\n}\n", "other.rs": "fn lone() {}\n", "third.rs": "fn callee() {}\nfn third() { callee() }\n"})
    occ = lambda line, sym, role: (2, message((1, bytes([line, 0, 3])), (2, sym.encode()), (3, role)))
    (tmp_path / "i.scip").write_bytes(message((1, message((3, f"file://{root}".encode()))), (2, message((1, b"u/a.rs"), occ(0, "s1", 1), occ(2, "s1", 0)))))
    ix = Index(spark, str(root), str(tmp_path / "ix"))
    ix.build([str(tmp_path / "i.scip")])
    told = lambda: {(r["a"], r["f"], r["provenance"]) for r in ix.edge.join(ix.symbol.selectExpr("symbol_id as src", "name as a"), "src").join(ix.symbol.selectExpr("symbol_id as dst", "file_id"), "dst").join(ix.file.selectExpr("file_id", "path as f"), "file_id").collect()}
    both = {("third", "third.rs", 0), ("third", "u/a.rs", 0)}
    assert told() == both | {("caller", "u/a.rs", 2)} and ix.store.meta()["scip_coverage"] == "1/3 (33%)"
    os.remove(root / "other.rs")
    ix.reconcile()
    assert told() == both | {("caller", "u/a.rs", 2)} and ix.store.meta()["scip_coverage"] == "1/2 (50%)"
    write(root, {"third.rs": "fn nothing() {}\n"})  # a candidate of a name that the covered file calls is gone
    ix.reconcile()
    assert told() == {("caller", "u/a.rs", 2)}
    write(root, {"u/a.rs": "fn callee() {}\nfn caller() {\n  x.callee() // edited\n}\n"})
    ix.reconcile()
    assert told() == {("caller", "u/a.rs", 0)} and ix.store.meta()["scip_coverage"] == "0/2 (0%)"


def test_trusted_edges_can_stay(spark):
    e = spark.createDataFrame([(1, 2, 1, 2, 0), (1, 3, 1, 0, 1)], "src long, dst long, kind long, provenance long, resolution long")
    new = spark.createDataFrame([(1, 2), (1, 3)], "src long, dst long")
    assert {(r["dst"], r["provenance"]) for r in precise.lsp_upserted(e, new, prefer_trusted=True).collect()} == {(2, 2), (3, 3)}


def walk(edges, root, depth, forward):
    seen, front = {root: 0}, {root}
    for d in range(1, depth + 1):
        front = {(b if forward else a) for a, b in edges if (a if forward else b) in front} - seen.keys()
        seen |= dict.fromkeys(front, d)
    return {k: v for k, v in seen.items() if v}


def test_walks_on_random_graphs(spark):
    rng = random.Random(5)
    for _ in range(2):
        edges = {(rng.randrange(12), rng.randrange(12)) for _ in range(25)}
        df = spark.createDataFrame([(a, b, 1) for a, b in edges], "src long, dst long, kind long")
        for forward in (True, False):
            got = {r["symbol_id"]: r["depth"] for r in graph.bfs(df, 3, 3, forward).collect()}
            assert got == walk(edges, 3, 3, forward)


def test_cycle(spark):
    df = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 1, 1), (1, 4, 1)], "src long, dst long, kind long")
    assert {(r["symbol_id"], r["depth"]) for r in graph.bfs(df, 1, 10, True).collect()} == {(2, 1), (3, 2), (4, 1)}


def test_store_versions(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    with pytest.raises(FileNotFoundError):
        s.read("x")
    assert s.write({"x": spark.range(1)}, {"a": "1"}) == 1 and s.write({"x": spark.range(2)}) == 2
    assert s.read("x").count() == 2 and s.read("x", 1).count() == 1 and s.meta() == {"a": "1", "schema_version": "1"}
    s.reset()
    assert s.version() is None
