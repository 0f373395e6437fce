"""Embedding near-dedup by spherical-cap filters with structured random product codes.

After a random rotation a vector is cut into blocks, and each block has its own random unit codewords; a filter
direction is one codeword of each block, so the dot products with all of their combinations are sums of a few block
products. Each vector is list-decoded to all directions that exceed its own cap height, which is where kept_of()
directions of a code are left; with one height for all vectors, at the same number of directions on average, half of the
pairs at the threshold share none. Vectors that share a direction are compared by a 128-bit sign sketch, and the
survivors by cosine in double precision.

Groups are kept from making all their pairs. Equal vectors are one class. Caps of half the link angle, fitted on a
bounded sample, take in the dense groups: any two vectors in such a cap are linked by the triangle inequality, so a
count stands for their links. Only classes in different caps are paired.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..operators.graph import components, even_join
from . import common

COSINE = 0.95
#: Independent codes, directions over a vector's cap height in a code of up to 2**23 vectors, blocks of a code, and filter directions for each vector.
CODES, KEPT, BLOCKS, DIRECTIONS = 2, 16, 4, 8
#: Bits by which the sketches of a pair may differ: over 6 standard deviations beyond the mean at the link angle.
SKETCH_BITS, SKETCH_MOST = 128, 35
#: Vectors of the sample that dense caps are fitted on, and those of it that a cap needs.
SAMPLE, SAMPLE_LEAST = 4096, 6
SEED = 11
FOUND = "cid long, copies long, filters array<long>, s1 long, s2 long, cap int"


def kept_of(n: int) -> int:
    """Directions over a vector's cap height in a code for n vectors: more with their number, so that recall stays over 0.99 at the threshold."""
    return max(KEPT, math.ceil(KEPT + 2.4 * (math.log2(max(2, n)) - 23)))


class Code:
    """Directions of one product code; made from the seed alone, so that all workers agree."""

    def __init__(self, dim: int, words: int, seed: int):
        rng = np.random.default_rng(seed)
        self.blocks = min(BLOCKS, dim)
        self.rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        self.cuts = np.linspace(0, dim, self.blocks + 1).astype(int)
        self.words = []
        for a, b in zip(self.cuts, self.cuts[1:]):
            c = rng.normal(size=(words, b - a))
            self.words.append(c / np.linalg.norm(c, axis=1, keepdims=True))

    def decode(self, x: np.ndarray, kept: int) -> np.ndarray:
        """The numbers of each row's best directions."""
        y, lists = x @ self.rotation, None
        for c, a, b in zip(self.words, self.cuts, self.cuts[1:]):
            own = _best(y[:, a:b] @ c.T, kept)
            lists = own if lists is None else _merged(lists, own, len(c), kept)
        return lists[0]


def _best(values: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray]:
    kept = min(kept, values.shape[1])
    at = np.argpartition(-values, kept - 1, axis=1)[:, :kept]
    return at.astype(np.int64), np.take_along_axis(values, at, 1)


def _merged(a: tuple, b: tuple, words: int, kept: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(a[0])
    at, value = _best((a[1][:, :, None] + b[1][:, None, :]).reshape(n, -1), kept)
    names = (a[0][:, :, None] * words + b[0][:, None, :]).reshape(n, -1)
    return np.take_along_axis(names, at, 1), value


def dense_caps(sample: np.ndarray, cosine: float, least: int) -> np.ndarray:
    """Unit centres of the sample's dense groups: leaders, then means of what is within the link angle of a leader."""
    half, left, centres = math.cos(math.acos(cosine) / 2) + 1e-9, sample, []
    while len(left):
        near = left @ left[0] >= cosine
        if near.sum() >= least:
            centre = left[near].mean(0)
            centre /= np.linalg.norm(centre)
            if (left @ centre >= half).sum() >= least:
                centres.append(centre)
        left = left[~near]
    return np.array(centres).reshape(-1, sample.shape[1])


def _units(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.int64))


def vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, raw (little-endian doubles; null where the vector links with nothing), from whole vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values, starts = lists.flatten().to_numpy(zero_copy_only=False).astype("<f8"), np.cumsum(sizes) - sizes
            out: list[bytes | None] = [None] * len(sizes)
            for size in set(sizes.tolist()) - {0}:
                at = np.flatnonzero(sizes == size)
                own = values[starts[at][:, None] + np.arange(size)] + 0.0  # no negative zeros
                with np.errstate(all="ignore"):  # a power of two makes the largest component about 1, so no square of it is lost
                    own = np.ldexp(own, -np.frexp(np.abs(own).max(1))[1][:, None])
                    norm = np.sqrt((own**2).sum(1))
                for i in np.flatnonzero(np.isfinite(norm) & (norm > 0)).tolist():
                    out[at[i]] = own[i].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "raw"])

    return embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, raw binary")


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, codes: int = CODES, kept: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row.

    Vectors that are null, empty, zero or hold a null or a component that isn't finite link with nothing. Vectors of
    different lengths never link. Equal vectors link, also under one vec_id (repeated rows): component_id is the least
    vec_id, and every row that has it is kept. Vectors may be of any length. Other columns are ignored; an empty table gives no rows.
    """
    rows = common.staged(vectors(embeddings), "vectors")
    classes = rows.where("raw is not null").groupBy("raw").agg(F.min("vec_id").alias("cid"), F.count("*").alias("copies"))
    classes = common.staged(classes.where("cid is not null"), "classes")
    counts, links = [], []
    for size, n in sorted((x[0], x[1]) for x in classes.groupBy(F.length("raw")).count().collect()):
        counted, linked = _links(classes.where(F.length("raw") == size), n, size // 8, cosine, codes, kept or kept_of(n), sample)
        counts.append(counted)
        links.append(linked)
    if not counts:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    count, link = counts[0], links[0]
    for x, y in zip(counts[1:], links[1:]):
        count, link = count.union(x), link.union(y)
    found = components(link)
    labelled = classes.join(count, "cid", "left").join(found, classes["cid"] == found["id"], "left")
    labelled = labelled.select("raw", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component_id"))
    out = even_join(rows, labelled, "raw", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links(classes: DataFrame, n: int, dim: int, cosine: float, codes: int, kept: int, sample: int) -> tuple[DataFrame, DataFrame]:
    """For vectors of one length: cid, n (vectors linked beyond its own copies); and a, b that join all linked classes."""
    spark = classes.sparkSession
    picked = classes.orderBy(F.xxhash64("cid"), "cid").limit(sample).select("raw").collect()
    caps = dense_caps(_units([bytes(x[0]) for x in picked]), cosine, max(SAMPLE_LEAST, len(picked) // 680))
    half = math.cos(math.acos(cosine) / 2) + 1e-9
    words = max(2, math.ceil((DIRECTIONS * n) ** (1 / min(BLOCKS, dim))))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Code(dim, words, SEED + i) for i in range(codes)]
        planes = np.random.default_rng(SEED - 1).normal(size=(dim, SKETCH_BITS))
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = _units(part.column(2).to_pylist())
                filters = np.concatenate([c.decode(x, kept) * codes + i for i, c in enumerate(own)], axis=1)
                bits = np.packbits(x @ planes > 0, axis=1).view("<i8")
                near = x @ caps.T if len(caps) else np.zeros((len(x), 1))
                cap = np.where(near.max(1) >= half, near.argmax(1), -1) if len(caps) else np.full(len(x), -1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * filters.shape[1], pa.int32()), _long(filters.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists, _long(bits[:, 0]), _long(bits[:, 1]), pa.array(cap.astype(np.int32))], ["cid", "copies", "filters", "s1", "s2", "cap"])

    points = common.staged(classes.select("cid", "copies", "raw").mapInArrow(decode, FOUND), "points")
    dense = points.where("cap >= 0").groupBy("cap").agg(F.min("cid").alias("first"), F.sum("copies").alias("total"), F.count("*").alias("own"))
    dense = {x["cap"]: x for x in dense.collect()}  # at most a row for each cap of the bounded sample
    rows = points.select("cid", "s1", "s2", "cap", F.explode("filters").alias("filter"))
    loose, inside = rows.where("cap < 0"), rows.where("cap >= 0")
    close = lambda: F.expr(f"bit_count(x.s1 ^ y.s1) + bit_count(x.s2 ^ y.s2) <= {SKETCH_MOST}")
    pair = lambda x, y, on: x.alias("x").join(y.alias("y"), (F.col("x.filter") == F.col("y.filter")) & on & close()).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"))
    pairs = pair(loose, loose, F.col("x.cid") < F.col("y.cid"))
    if dense:
        pairs = pairs.union(pair(inside, loose, F.lit(True)))
        reach = math.acos(cosine) * 2 + 1e-6
        angle = np.arccos(np.clip(caps @ caps.T, -1, 1))
        touching = [(int(i), int(j)) for i, j in zip(*np.nonzero(angle <= reach)) if i < j]
        if touching:
            ends = spark.createDataFrame(touching, "p int, q int")
            left = inside.join(F.broadcast(ends), F.col("cap") == F.col("p")).drop("p")  # at most a row for each two of the bounded caps
            pairs = pairs.union(pair(left, inside, F.col("x.q") == F.col("y.cap")))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                x, y = _units(part.column(4).to_pylist()), _units(part.column(5).to_pylist())
                yield part.select(["a", "b", "na", "nb"]).filter(pa.array((x * y).sum(1) >= cosine))

    one = classes.select(F.col("cid").alias("a"), F.col("raw").alias("ra"), F.col("copies").alias("na"))
    two = classes.select(F.col("cid").alias("b"), F.col("raw").alias("rb"), F.col("copies").alias("nb"))
    both = pairs.distinct().join(one, "a").join(two, "b").select("a", "b", "na", "nb", "ra", "rb")
    linked = common.staged(both.mapInArrow(verify, "a long, b long, na long, nb long"), "links")
    counts = linked.select(F.col("a").alias("cid"), F.col("nb").alias("n")).union(linked.select("b", "na"))
    edges = linked.select("a", "b")
    if dense:
        table = spark.createDataFrame([(k, x["first"], x["total"]) for k, x in dense.items()], "cap int, first long, total long")
        held = points.where("cap >= 0").join(F.broadcast(table), "cap")
        counts = counts.union(held.select("cid", F.col("total") - F.col("copies")))
        edges = edges.union(held.select(F.col("cid").alias("a"), F.col("first").alias("b")))
    return counts.groupBy("cid").agg(F.sum("n").alias("n")), edges
