"""Keeping an index in step with its files: reconciling, pruning and collecting strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.ids import dense_ids, ranged


def symbol_key(path: Column, name_path: Column, kind: Column, nth: Column) -> Column:
    """Identity of a symbol over time: where it is, what it is, and which of its namesakes in the file."""
    return F.sha2(F.concat_ws("\0", path, name_path, kind.cast("string"), nth.cast("string")).cast("binary"), 256)


def keyed(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """symbols with nth (from 0, in order of start and id among equal name path and kind in a file) and symbol_key."""
    nth = F.row_number().over(Window.partitionBy("file_id", "name_path", "kind").orderBy("start_line", "symbol_id")) - 1
    named = symbols.withColumn("nth", nth.cast("long")).join(files.select("file_id", "path"), "file_id")
    return named.withColumn("symbol_key", symbol_key(F.col("path"), F.col("name_path"), F.col("kind"), F.col("nth"))).drop("path")


def reconciled(old: DataFrame, new: DataFrame, mark: int = 0) -> DataFrame:
    """(symbol_key, action, symbol_id): kept symbols keep their id, inserted ones get new ids, the rest are deleted.

    old: symbol_key, symbol_id; new: symbol_key. New ids lie above those of old and above mark, the highest id ever given
    (a snapshot's metadata has it), so no id is used twice.
    """
    top = F.coalesce(F.max("symbol_id"), F.lit(0))
    high = max(mark, old.agg(top.alias("top")).first()["top"])
    both = old.select("symbol_key", "symbol_id").join(new.select("symbol_key", F.lit(True).alias("now")), "symbol_key", "full_outer")
    action = F.when(F.col("symbol_id").isNull(), "insert").when(F.col("now").isNull(), "delete").otherwise("keep")
    told = both.select("symbol_key", action.alias("action"), "symbol_id")
    added = dense_ids(told.filter("action = 'insert'").drop("symbol_id"), "n", F.substring("symbol_key", 1, 3), F.col("symbol_key"))
    return told.filter("action <> 'insert'").unionByName(added.select("symbol_key", "action", (F.col("n") + high).alias("symbol_id")))


def numbered(new: DataFrame, old: DataFrame, mark: int = 0) -> DataFrame:
    """new (path, ...) with file_id: that of old (path, file_id) where the path is known, else one above old's and above mark."""
    high = max(mark, old.agg(F.coalesce(F.max("file_id"), F.lit(0)).alias("top")).first()["top"])
    fresh = new.select("path").join(old.select("path"), "path", "left_anti")
    ids = dense_ids(fresh, "n", ranged(fresh, "path"), F.col("path")).select("path", (F.col("n") + high).cast("long").alias("file_id"))
    return new.join(ids.unionByName(old.select("path", F.col("file_id").cast("long").alias("file_id"))), "path")


def fs_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, changed, deleted or unchanged between two scans (path, size, mtime_ns, content_hash).

    The hash is compared only where size or time differ; a file touched without a change is unchanged.
    """
    a = old.select("path", F.col("size").alias("s0"), F.col("mtime_ns").alias("m0"), F.col("content_hash").alias("h0"))
    b = new.select("path", F.col("size").alias("s1"), F.col("mtime_ns").alias("m1"), F.col("content_hash").alias("h1"))
    both = a.join(b, "path", "full_outer")
    same = (F.col("s0") == F.col("s1")) & (F.col("m0") == F.col("m1"))
    change = F.when(F.col("s0").isNull(), "added").when(F.col("s1").isNull(), "deleted").when(same | (F.col("h0") == F.col("h1")), "unchanged").otherwise("changed")
    return both.select("path", change.alias("change"))


def unquoted(c: Column) -> Column:
    return F.when(c.rlike('^".*"$'), F.regexp_extract(c, '^"(.*)"$', 1)).otherwise(c)


def git_status(lines: DataFrame) -> DataFrame:
    """(path, change) from lines (source, line) of `git diff --name-status` (source diff) and `git status --porcelain` (status).

    A rename or a copy deletes its first path and changes its second; short or odd lines say nothing.
    """
    parts, line = F.split("line", "\t"), F.col("line")
    one = lambda p, change: F.struct(p.alias("path"), F.lit(change).alias("change"))
    head, n = F.substring(F.get(parts, 0), 1, 1), F.size(parts)
    diff = F.when(head.isin("R", "C") & (n == 3), F.array(one(F.get(parts, 1), "deleted"), one(F.get(parts, 2), "changed"))).when((head == "D") & (n == 2), F.array(one(F.get(parts, 1), "deleted"))).when(n == 2, F.array(one(F.get(parts, 1), "changed")))
    rest = F.trim(F.substring(line, 4, 1 << 20))
    moved = F.split(rest, " -> ", 2)
    status = F.when(F.length(line) < 3, None).when(F.size(moved) == 2, F.array(one(unquoted(F.get(moved, 0)), "deleted"), one(unquoted(F.get(moved, 1)), "changed")))
    status = status.when(F.contains(F.substring(line, 1, 2), F.lit("D")), F.array(one(unquoted(rest), "deleted"))).otherwise(F.array(one(unquoted(rest), "changed")))
    return lines.select(F.explode(F.when(F.col("source") == "diff", diff).otherwise(status)).alias("x")).select("x.*").distinct()


def git_changeset(changes: DataFrame) -> DataFrame:
    """What a reconcile does: paths to prune (deleted and not changed as well) and to index again."""
    changed = changes.filter("change = 'changed'").select("path").distinct()
    gone = changes.filter("change = 'deleted'").select("path").distinct().join(changed, "path", "left_anti")
    return gone.select("path", F.lit("prune").alias("action")).unionByName(changed.select("path", F.lit("index").alias("action")))


def pruned(files: DataFrame, symbols: DataFrame, edges: DataFrame, occurrences: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """The tables without some files (file_id): their symbols go, and edges with an end among those; occurrences elsewhere
    forget them."""
    ids = gone.select("file_id").distinct()
    left = symbols.join(ids, "file_id", "left_anti").select(symbols.columns)
    lost = symbols.join(ids, "file_id", "left_semi").select("symbol_id")
    kept = edges.join(lost.select(F.col("symbol_id").alias("src")), "src", "left_anti").join(lost.select(F.col("symbol_id").alias("dst")), "dst", "left_anti").select(edges.columns)
    rest = occurrences.join(ids, "file_id", "left_anti")
    a = lost.select("symbol_id", F.lit(True).alias("__a"))
    b = lost.select(F.col("symbol_id").alias("enclosing_id"), F.lit(True).alias("__b"))
    rest = rest.join(a, "symbol_id", "left").join(b, "enclosing_id", "left").withColumn("symbol_id", F.when(F.col("__a").isNull(), F.col("symbol_id"))).withColumn("enclosing_id", F.when(F.col("__b").isNull(), F.col("enclosing_id"))).select(occurrences.columns)
    return {"file": files.join(ids, "file_id", "left_anti").select(files.columns), "symbol": left, "edge": kept, "occurrence": rest}


def strings(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Every string that the model refers to, once."""
    return files.select(F.col("path").alias("text")).union(files.select("index_unit")).union(symbols.select("name")).union(symbols.select("name_path")).filter("text is not null").distinct()


def interned(texts: DataFrame) -> DataFrame:
    """(id, text): dense ids in order of the text."""
    return dense_ids(texts, "id", ranged(texts, "text"), F.col("text")).select("id", "text")


def orphans(pool: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Pool strings (id, text) that nothing refers to."""
    return pool.join(strings(files, symbols), "text", "left_anti").select("id", "text")
