"""Vectors of numbers as scaled integers: what the operators on vectors share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rows_of(vectors: DataFrame, id_col: str, vector_col: str, label: Column | None = None) -> DataFrame:
    """Fixed names for the columns that count, so that no other column of the input can clash."""
    label = F.lit(None).cast("int") if label is None else label
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    return vectors.select(F.col(f"`{id_col}`").alias("id"), label.alias("label"), vector.alias("vector"))


def scaled(column: pa.ListArray, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which rows, their lengths, all their floor(scale * x) one row after the other as floats) of the rows that are
    neither null nor hold a null or non-finite component."""
    values = column.flatten()
    found = values.to_numpy(zero_copy_only=False).astype(np.float64)  # a null becomes NaN
    lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    row_of = np.repeat(np.arange(len(column)), lengths)
    good = ~np.asarray(column.is_null())
    good[row_of[~np.isfinite(found)]] = False
    with np.errstate(over="ignore"):
        whole = np.floor(found[good[row_of]] * scale)
    rows = np.flatnonzero(good)
    return rows, lengths[rows], whole

