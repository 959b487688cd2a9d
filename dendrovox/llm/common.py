"""Small helpers of the operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers each that a broadcast may have; it is checked by a count before.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS, weight=None) -> DataFrame:
    """``df`` (a written table) with a broadcast hint if it has at most ``limit`` rows, or numbers by ``weight``, else as it is."""
    if weight is None:
        small = df.limit(limit + 1).count() <= limit
    else:
        small = (df.agg(F.sum(weight)).first()[0] or 0) <= 4 * limit
    return F.broadcast(df) if small else df


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name in taken:
        name += "_"
    return name


def ascii_lower(column):
    """Lower-cases A-Z only."""
    import string

    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def ddl(df: DataFrame, names: list[str], more: str) -> str:
    """A schema of some columns of ``df`` and ``more`` columns."""
    return ", ".join([*(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names), more])


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """All rows of the batches, a few at a time; at the end the worker gives its free memory back, as it lives on."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass
