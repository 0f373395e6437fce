"""Nearest rows from 8-bit codes with a bound on each row's error: exact, though most rows are never read in full.

The index holds a byte for each component of a row's unit vector, the step between codes, and the length of what the
codes leave out. A query's product with the codes is then off by at most that length, so every row has a lower and an
upper bound. A first pass keeps the rows whose upper bound reaches the query's k-th lower bound; a second one reads just
those rows' vectors and decides in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import search

CODES = "grp string, ids array<long>, dim long, data binary, steps binary, errors binary"
BOUNDS = "query_id long, id long, low double, high double"
LEVELS = 127


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, steps and errors of rows: the unit vector is codes * step, but for a rest of length error; zero vectors have none."""
    with np.errstate(all="ignore"):
        size = np.linalg.norm(x, axis=1)[:, None]
        unit = np.where(size > 0, x / size, 0.0)
    step = np.abs(unit).max(1, initial=0.0)[:, None] / LEVELS
    code = np.rint(np.divide(unit, step, out=np.zeros_like(unit), where=step > 0)).astype(np.int8)
    step = step.astype("<f4").astype(np.float64)  # as it is stored
    error = np.linalg.norm(unit - code * step, axis=1)
    return code, step[:, 0].astype("<f4"), np.nextafter(error.astype("<f4"), np.float32(np.inf))


def index(rows: DataFrame, id_col: str, vector_col: str, group=None) -> DataFrame:
    """CODES of all rows that have a vector, in blocks of one group and length: to be written once, and read by many searches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [encode(np.frombuffer(d, np.float64).reshape(-1, n)) for n, d in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array([x[i].tobytes() for x in found], pa.binary()) for i in range(3)]], [c.split()[0] for c in CODES.split(", ")])

    return search.blocks(rows, id_col, vector_col, group).mapInArrow(run, CODES)


def bounded(queries: DataFrame, codes: DataFrame, id_col: str, vector_col: str, k: int, group=None) -> DataFrame:
    """BOUNDS of the rows that may be among the k nearest of each query: all whose upper bound reaches the k-th lower one."""
    q = search.blocks(queries, id_col, vector_col, group).toDF("q_grp", "q_ids", "q_dim", "q_data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, dim, q_data, ids, data, steps, errors in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.frombuffer(q_data, np.float64).reshape(-1, dim)
                with np.errstate(all="ignore"):
                    size = np.linalg.norm(x, axis=1)[:, None]
                    unit = np.where(size > 0, x / size, 0.0)
                code = np.frombuffer(data, np.int8).reshape(-1, dim).astype("f4")
                middle = (unit.astype("f4") @ code.T).astype(np.float64) * np.frombuffer(steps, "<f4")
                # what single precision may add, and a zero query's product is 0
                spread = np.where(size > 0, np.frombuffer(errors, "<f4") + (dim + 8) * 2.0**-22, 0.0)
                low, high = middle - spread, middle + spread
                q_ids, ids = np.array(q_ids), np.array(ids)
                same = q_ids[:, None] == ids
                low[same] = high[same] = -np.inf
                least = np.partition(low, -k, axis=1)[:, -k][:, None] if low.shape[1] > k else -np.inf
                i, j = np.nonzero((high >= least) & ~same)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(ids[j]), pa.array(low[i, j]), pa.array(high[i, j])], ["query_id", "id", "low", "high"])

    pairs = search.met(queries, q, codes).select("q_ids", "dim", "q_data", "ids", "data", "steps", "errors").mapInArrow(run, BOUNDS)
    w = Window.partitionBy("query_id").orderBy(F.col("low").desc())
    least = pairs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("low").alias("least"))
    return pairs.join(least, "query_id").where((F.col("high") >= F.col("least")) | (F.col("n") < k)).select("query_id", "id", "low", "high")


def top(queries: DataFrame, rows: DataFrame, codes: DataFrame, id_col: str, vector_col: str, k: int, group=None) -> DataFrame:
    """query_id, id, similarity, rank: what search.batch_top gives for the rows that codes (their index) was made of, itself left out.

    Only the vectors of bounded() rows are read in full; ties go by id.
    """
    pairs = bounded(queries, codes, id_col, vector_col, k, group)
    x, y = queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("x")), rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("y"))
    own = pairs.select("query_id", "id").join(y, "id").join(x, "query_id").select("query_id", "id", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                dims = np.array([len(v) for v in part.column(2).to_pylist()])
                similarity = np.zeros(part.num_rows)
                for dim in set(dims.tolist()):
                    own = np.flatnonzero(dims == dim)
                    a, b = (np.array(part.column(c).take(pa.array(own)).to_pylist(), dtype=np.float64) for c in (2, 3))
                    size = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
                    similarity[own] = np.divide(np.einsum("ij,ij->i", a, b), size, out=np.zeros(len(own)), where=size > 0)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(similarity)], ["query_id", "id", "similarity"])

    scored = own.mapInArrow(run, "query_id long, id long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
