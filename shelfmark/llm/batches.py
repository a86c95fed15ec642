"""Small helpers for functions that Spark runs on Arrow batches of a partition."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import shelfmark

#: Rows turned into Python objects at a time: few, because a single text may be very long.
ROWS = 256


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, once for each application; Spark serves the file to new executors too."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(shelfmark.__file__)
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "shelfmark.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("shelfmark", os.path.relpath(full, root)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def give_back() -> None:
    """Returns freed memory to the system: a worker lives on and would hold what its largest task has needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def arrow_map(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """mapInArrow with a function of this package."""
    ship(df.sparkSession)

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def arrow_column(run: Callable, kind: str, source: Column | str) -> Column:
    """A column made by a function of this package from an Arrow column, a few rows at a time."""
    ship(SparkSession.active())

    def column(c: pa.Array) -> pa.Array:
        parts = [run(c.slice(at, ROWS)) for at in range(0, max(1, len(c)), ROWS)]
        give_back()
        return pa.concat_arrays(parts)

    return F.arrow_udf(column, kind)(source)


def slices(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts(batch: pa.RecordBatch, column: int | str = "text") -> list[str]:
    """The texts of a batch; a null is an empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just these two columns under fixed names, so that no other column of the input can clash."""
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
