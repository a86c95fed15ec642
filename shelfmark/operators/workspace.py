"""Where intermediate tables go: the shared folder the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Keys are hashes in hexadecimal digits, of which zstd halves the size; the default codec leaves them as they are.
CODEC = "zstd"


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a local session without one gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """The rows as a written table: lineage ends here and survives lost executors."""
    path = new_dir(df.sparkSession, label)
    writer = df.write.mode("overwrite")
    (writer if codec is None else writer.option("compression", codec)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder and all in it, in whatever store it lies: as the place of a database that is dropped. None need be there."""
    name = f"gone_{uuid.uuid4().hex}"
    place = path.replace("'", "\\'")
    spark.sql(f"CREATE DATABASE {name} LOCATION '{place}'")
    spark.sql(f"DROP DATABASE {name} CASCADE")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold within a ``with`` block."""
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class Scratch:
    """Written tables that last as long as a ``with`` block, or until they are dropped within it.

    They are tables of a database of their own in the shared folder, so dropping them is plain SQL. What is to outlast the
    block is written elsewhere before it ends, as by ``written``.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.name = spark, f"scratch_{uuid.uuid4().hex}"
        self.tables: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Scratch:
        self.spark.sql(f"CREATE DATABASE {self.name} LOCATION '{shared_dir(self.spark)}/{self.name}'")
        return self

    def written(self, df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
        """Like ``written``, within this block."""
        name = f"{self.name}.{label.replace('-', '_')}_{len(self.tables)}"
        (df.write if codec is None else df.write.option("compression", codec)).saveAsTable(name)
        self.tables.append((self.spark.table(name), name))
        return self.tables[-1][0]

    def drop(self, *frames: DataFrame) -> None:
        """Removes tables that nothing reads any more."""
        for frame in frames:
            for known, name in self.tables:
                if known is frame:
                    self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def __exit__(self, *_) -> None:
        self.spark.sql(f"DROP DATABASE IF EXISTS {self.name} CASCADE")
