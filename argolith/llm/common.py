"""Shared plumbing: reading tables, cutting lineage, Arrow maps and packed shuffles."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from argolith.session import discard, materialise, ship  # noqa: F401

#: Rows that Python code of this package handles at once; bounds a worker's memory.
SLICE_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_of_id(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def sliced(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def sliced_by_size(batches: Iterable[pa.RecordBatch], text_col: int, chars: int) -> Iterator[pa.RecordBatch]:
    """Slices of so many bytes of text, or of one row."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + chars, "right")))
            yield batch.slice(at, end - at)
            at = end


def map_slices(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow over bounded slices. make() runs once per task and returns the function of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for part in sliced(batches):
            yield f(part)

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def aside(df: DataFrame, *names: str) -> list[str]:
    """Names of columns like the given ones that df does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def parts_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
