"""Session helpers: a local session for tests and the checkpoint folder rule."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8,
                  memory: str = "12g") -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("assay")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master may fall
    back to a temporary folder, because executors elsewhere could not read it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    The stored files outlive lost executors, end the lineage, and tell the
    optimiser the true size of the table for its next joins.
    """
    return _stored(df, f"{ensure_checkpoint_dir(df.sparkSession)}/assay-{uuid.uuid4().hex}")


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables of one operator, deleted when nothing reads them any more.

    ``cut`` writes a table as ``cut_lineage`` does; ``free`` deletes the given ones, which must
    not be read again, not even by a table that was not written itself.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{ensure_checkpoint_dir(spark)}/assay-{uuid.uuid4().hex}"
        self.tables: list[tuple[DataFrame, str]] = []

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.tables)}"
        table = _stored(df, path)
        self.tables.append((table, path))
        return table

    def free(self, *done: DataFrame) -> None:
        """Delete the files of ``done``; tables that this object did not write stay as they are."""
        jvm = self.spark._jvm
        for table, path in self.tables:
            if any(table is d for d in done):
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def free_all_but(self, *kept: DataFrame) -> None:
        self.free(*[t for t, _ in self.tables if not any(t is k for k in kept)])
