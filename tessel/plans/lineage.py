"""Cutting lineage with tables in the folder that all executors share.

Iterative operators write the state of a round as Parquet below
``spark.checkpoint.dir`` and read it again: a lost executor then costs one
round, and column pruning still reaches the scan. Where the setting is absent
(tests), a folder below the driver's temporary one is made and set.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_KEPT: list[tuple[SparkSession, str]] = []
_TABLES: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder. Off a local master an unset folder is an error, since a machine-local one would not be seen by the executors."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessel-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tessel/{name}-{uuid.uuid4().hex}"
    _KEPT.append((spark, path))
    return path


def keep_table(spark: SparkSession, table: str) -> None:
    """A catalog entry over a fresh path, to be dropped with it."""
    _TABLES.append((spark, table))


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _KEPT[:] = [x for x in _KEPT if x[1] != path]


class Cut:
    """The tables an operator has written; ``free`` drops those no longer read.

    Results read these tables when they are run, so an operator can't drop the
    last ones itself. A caller who passes a Cut of their own drops them all, once
    the result is written, with ``close`` or by using it in a with statement; the
    others stay until the program ends.
    """

    def __enter__(self) -> Cut:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        for path in self.paths:
            drop_path(self.spark, path)
        self.paths.clear()

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: set[str] = set()

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths.add(path)
        out._tessel_path = path
        return out

    def counted(self, df: DataFrame, name: str, count: Column) -> tuple[DataFrame, int]:
        """The written table and an aggregate of its rows, observed while they are written, without a job of its own."""
        seen = Observation()
        out = self(df.observe(seen, count.alias("n")), name)
        return out, seen.get["n"]

    def free(self, *dfs: DataFrame) -> None:
        for df in dfs:
            path = df.__dict__.get("_tessel_path")
            if path in self.paths:
                self.paths.discard(path)
                drop_path(self.spark, path)


@atexit.register
def _clean() -> None:
    for spark, table in _TABLES:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        except Exception:  # noqa: BLE001 - the session may be gone
            break
    for spark, path in list(_KEPT):
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone
            return
