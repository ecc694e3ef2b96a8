"""Intermediate tables in the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def base_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; a temporary folder only where the setting is absent and all runs in one process."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="leafmill-checkpoint-")
    sc.setCheckpointDir(path)
    return path


class Scratch:
    """Tables of one operator call. `put` cuts lineage by writing Parquet; `drop` frees what is no longer read.

    tidy: shuffle files of a table are deleted as soon as it is written, not when the driver collects garbage.
    """

    def __init__(self, spark: SparkSession, name: str, tidy: bool = False) -> None:
        self.spark, self.tidy = spark, tidy
        self.root = f"{base_dir(spark)}/leafmill/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        with self._tidied():
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def put_by(self, df: DataFrame, name: str, column: str) -> DataFrame:
        """As `put`, in buckets of a column, so that joins on it don't shuffle the table again."""
        path, n = self.path(name), int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        table = f"leafmill_{name}_{uuid.uuid4().hex}"
        with self._tidied():
            df.repartition(n, column).write.bucketBy(n, column).option("path", path).saveAsTable(table)
        out = self.spark.table(table)
        out._scratch_path, out._scratch_table = path, table
        return out

    @contextmanager
    def _tidied(self) -> Iterator[None]:
        before = self.spark.conf.get(CLEANUP, None)
        if self.tidy:
            self.spark.conf.set(CLEANUP, "true")
        try:
            yield
        finally:
            if self.tidy:
                self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for df in tables:
            if hasattr(df, "_scratch_table"):
                self.spark.sql(f"drop table if exists {df._scratch_table}")
            path = getattr(df, "_scratch_path", None)
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
