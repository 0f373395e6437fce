"""Bounded batches, the one large cache of a worker, and table reading for the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..staging import delete_folder, new_folder, shared_dir, staged, unstaged  # noqa: F401

#: Bytes of text that a Python worker holds as one batch.
BATCH_BYTES = 16 << 20


#: Name of the cache that this worker process holds, and what empties it.
HELD: list[tuple] = []


def claim(name: str, empty: Callable[[], None]) -> None:
    """Workers are reused by later stages, so the one large cache that a process may hold makes room for another operator's."""
    if HELD and HELD[0][0] != name:
        HELD.pop()[1]()
    if not HELD:
        HELD.append((name, empty))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about limit bytes of column, or one row."""
    for batch in batches:
        size = batch.column(batch.schema.get_field_index(column)).nbytes
        parts = max(1, -(-size // limit))
        step = max(1, -(-batch.num_rows // parts))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
