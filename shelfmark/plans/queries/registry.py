"""Registered queries: a DataFrame function of (session, table folder) and, where SQL can say it, the
same question as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers the function under its name."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of few small files, spread over the cores for work that costs more than reading.

    Larger tables have more scan tasks than that, or as many files as there are cores, and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= cores and len(df.inputFiles()) < cores else df


def utc(c: Column | str) -> Column:
    """The zone-less times of the tables as UTC instants."""
    return (F.col(c) if isinstance(c, str) else c).cast("timestamp")


def joined(c: Column | str, sep: str = "|") -> Column:
    return F.array_join(c, sep)


# SQL counterparts of the scalar functions, for Latin text.
def sql_norm(x: str) -> str:
    return (
        f"trim(regexp_replace(lower(strip_accents(replace({x}, 'ß', 'ss'))), '\\s+', ' ', 'g'))"
    )


def sql_words(x: str) -> str:
    return f"regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+')"
