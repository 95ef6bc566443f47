"""Versioned snapshots of the graph as Parquet, and tables that end lineage.

A snapshot is a folder v=N with one Parquet table each; a small pointer table names the current version. A new version is
written whole and then pointed at, so readers never see half of one, and a lost executor only repeats tasks.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; one of our own where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="weft-"))
    return sc.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, what: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/weft-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables that are deleted together, once what was made of them is written elsewhere."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/weft-scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def stored(self, df: DataFrame, what: str) -> DataFrame:
        path = f"{self.root}/{what}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *_) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class Store:
    """Snapshots under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def version(self) -> int | None:
        """The current version, None before the first. Of the pointers that are complete, the highest counts."""
        fs, path = self._fs()
        if not fs.exists(path(f"{self.root}/current")):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(path(f"{self.root}/current"))]
        return max((int(n) for n in names if n.isdigit()), default=None)

    def write(self, tables: dict[str, DataFrame], meta: dict[str, str] | None = None) -> int:
        """A new version with these tables and string metadata (that of the version before is carried over)."""
        n = (self.version() or 0) + 1
        old = self.meta() if n > 1 else {}
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/v={n}/{name}")
        rows = sorted((old | {"schema_version": "1"} | (meta or {})).items())
        self.spark.createDataFrame(rows, "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/v={n}/meta")
        fs, path = self._fs()
        fs.mkdirs(path(f"{self.root}/current"))
        fs.create(path(f"{self.root}/current/{n}"), True).close()  # the switch
        return n

    def read(self, name: str, version: int | None = None) -> DataFrame:
        n = version or self.version()
        if n is None:
            raise FileNotFoundError(f"no index at {self.root}")
        return self.spark.read.parquet(f"{self.root}/v={n}/{name}")

    def meta(self) -> dict[str, str]:
        return {r["key"]: r["value"] for r in self.read("meta").collect()}

    def pruned(self) -> int:
        """Delete the versions before the current one, pointers first; how many there were."""
        fs, path = self._fs()
        n, gone = self.version(), 0
        for s in fs.listStatus(path(self.root)):
            name = s.getPath().getName()
            if name.startswith("v=") and n is not None and int(name[2:]) < n:
                fs.delete(path(f"{self.root}/current/{name[2:]}"), False)
                gone += bool(fs.delete(s.getPath(), True))
        return gone

    def reset(self) -> None:
        fs, path = self._fs()
        fs.delete(path(self.root), True)
