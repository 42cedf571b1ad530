"""The store of results: a Parquet folder, partitioned by config_key, that takes new rows and is asked what it has.

``Store`` keeps several tables (metrics, trajectories) of which a configuration's rows appear together or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = "config_key"


def save(results: DataFrame, path: str) -> None:
    """Write the rows of one or more configurations in place of what the store has of them."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(KEY).parquet(path)


def collect(spark: SparkSession, path: str) -> DataFrame:
    """All results; columns that some lack are null there."""
    return spark.read.option("mergeSchema", True).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def pending(requested: DataFrame, stored: DataFrame) -> DataFrame:
    """The requested configurations that the store lacks."""
    return requested.join(stored.select(KEY).distinct(), KEY, "left_anti")


def present_keys(spark: SparkSession, path: str, keys: Sequence[str]) -> set[str]:
    """Those of ``keys`` that the store has."""
    if not keys or not exists(spark, path):
        return set()
    found = collect(spark, path).filter(F.col(KEY).isin(list(keys))).select(KEY).distinct()
    return {r[KEY] for r in found.collect()}


def working_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir, else the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")


class Store:
    """Results under ``path``: data of a commit in ``data/<commit>/<table>``, and ``manifest/<commit>`` with its keys.

    A commit's tables are written first, its manifest last, by a write that Spark publishes as a whole; readers go by
    manifests alone. So a write that is cut off leaves nothing to be seen, and ``vacuum`` removes what it left. A key that
    is committed again is read from its latest commit."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _manifests(self) -> DataFrame | None:
        if not exists(self.spark, f"{self.path}/manifest"):
            return None
        return self.spark.read.schema(f"{KEY} string, commit string, at timestamp, tables array<string>").option("recursiveFileLookup", True).parquet(f"{self.path}/manifest")

    def current(self) -> DataFrame | None:
        """(config_key, commit, at, tables): the latest commit of each key."""
        every = self._manifests()
        if every is None:
            return None
        last = Window.partitionBy(KEY).orderBy(F.desc("at"), F.desc("commit"))
        return every.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")

    def present(self, keys: Sequence[str]) -> set[str]:
        """Those of ``keys`` that are committed."""
        now = self.current()
        return set() if now is None or not keys else {r[KEY] for r in now.filter(F.col(KEY).isin(list(keys))).select(KEY).collect()}

    def commit(self, tables: dict[str, DataFrame], keys: Sequence[str]) -> str:
        """Write the tables, which have a column config_key, and then make the keys' rows appear in all of them."""
        (name, first), *rest = tables.items()
        return self.commit_with(first, name, lambda _: dict(rest), keys)

    def commit_with(self, first: DataFrame, name: str, others: Callable[[DataFrame], dict[str, DataFrame]], keys: Sequence[str]) -> str:
        """``commit`` of a table and of those that are made from it as written."""
        commit = uuid.uuid4().hex
        first.write.parquet(self.staged(commit, name))
        more = others(self.spark.read.schema(first.schema).parquet(self.staged(commit, name)))
        for k, table in more.items():
            table.write.parquet(self.staged(commit, k))
        entries = self.spark.createDataFrame([(k, commit) for k in keys], f"{KEY} string, commit string")
        entries = entries.select(KEY, "commit", F.current_timestamp().alias("at"), F.lit([name, *more]).alias("tables"))
        entries.coalesce(1).write.parquet(f"{self.path}/manifest/{commit}")
        return commit

    def staged(self, commit: str, name: str) -> str:
        return f"{self.path}/data/{commit}/{name}"

    def read(self, name: str) -> DataFrame:
        """A table's rows of the latest commit of each key; columns that some commits lack are null there."""
        now = self.current()
        here = None if now is None else now.filter(F.array_contains("tables", name))
        commits = [] if here is None else [r["commit"] for r in here.select("commit").distinct().collect()]
        if not commits:
            raise FileNotFoundError(f"{self.path} has no table {name}")
        rows = self.spark.read.option("mergeSchema", True).parquet(*[self.staged(c, name) for c in commits])
        rows = rows.withColumn("_commit", F.regexp_extract("_metadata.file_path", r"/data/([0-9a-f]{32})/", 1))
        kept = here.select(KEY, F.col("commit").alias("_commit"))
        return rows.join(F.broadcast(kept), [KEY, "_commit"], "left_semi").drop("_commit")

    def vacuum(self) -> list[str]:
        """Remove the data of commits that no key is read from: cut off or replaced. No commit may be under way."""
        now = self.current()
        used = set() if now is None else {r["commit"] for r in now.select("commit").distinct().collect()}
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        gone = [x.getPath() for x in (files.listStatus(folder) if files.exists(folder) else []) if x.getPath().getName() not in used]
        for path in gone:
            files.delete(path, True)
        return sorted(x.getName() for x in gone)
