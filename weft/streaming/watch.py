"""Watching a tree: a streaming source whose offset is the state of a listing, and a query that reconciles at each new state."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from weft.sources import scan


def state(root: str) -> str:
    """A digest of names, sizes and times of the files that an index of root looks at."""
    return hashlib.sha256(repr(sorted(scan.listed(root))).encode()).hexdigest()


class TreeReader(SimpleDataSourceStreamReader):
    """One row for each state of the tree that differs from the one before; edits and deletions count as arrivals do."""

    def __init__(self, root: str):
        self.root = root

    def initialOffset(self) -> dict:
        return {"state": ""}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = state(self.root)
        return iter([] if now == start["state"] else [(now,)]), {"state": now}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(end["state"],)])


class TreeSource(DataSource):
    """Format `weft_tree`, option `root`."""

    @classmethod
    def name(cls) -> str:
        return "weft_tree"

    def schema(self) -> str:
        return "state string"

    def simpleStreamReader(self, schema: StructType) -> TreeReader:
        return TreeReader(self.options["root"])


def watched(index, checkpoint: str, interval: str):
    """A running query: each new state of the tree reconciles the index. A failing batch is told and the watch goes on."""
    index.spark.dataSource.register(TreeSource)

    def batch(df, _: int) -> None:
        if df.isEmpty():
            return
        try:
            index.reconcile()
        except Exception as e:  # noqa: BLE001  the watch outlives a bad batch
            print(f"reconcile failed: {e}")

    states = index.spark.readStream.format("weft_tree").option("root", index.root).load()
    return states.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
