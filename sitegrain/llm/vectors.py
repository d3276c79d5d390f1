"""Vectors that take part in a search, and how rows and queries meet in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrain.llm.common import own_columns


def usable(df: DataFrame, id_col: str, vector_col: str, zero: bool) -> DataFrame:
    """id long, v array<double>: rows with an id and a vector of the commonest length (of equals, the shortest) without null or non-finite components.

    Vectors of zeros stay only where ``zero`` says so. A repeated id and vector counts as one row.
    """
    rows = own_columns(df, id=id_col, v=vector_col).select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    if not zero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    width = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").select("width").first()
    return rows.where(F.size("v") == (width.width if width else 0)).dropDuplicates(["id", "v"])


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column without nulls, all of one length, as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def blocked(n: int, size: int) -> int:
    return max(1, -(-n // size))
