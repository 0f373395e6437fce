"""Vector expressions on array columns; maths in double precision."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from . import text


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(_doubles(a), F.lit(1), n), F.slice(_doubles(b), F.lit(1), n), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """From -1 to 1; 0 where a vector is null or has no length."""
    size = norm(a) * norm(b)
    return F.coalesce(F.when(size > 0, dot(a, b) / size), F.lit(0.0))


def vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def normalized(v: Column) -> Column:
    """Length 1; a zero vector stays."""
    return F.when(norm(v) > 0, F.transform(_doubles(v), lambda x: x / norm(v))).otherwise(_doubles(v))


#: The hash embedder reduces by this; the hex checksum has another modulus.
EMBED_MODULUS = 2147483647
DIM = 384


#: Tokens of a text: w:<word> for words of two letters or more, g:<trigram> of each word between spaces; repeats count.
#: A letter or digit, small or not, by its byte: its place in LETTERS, from 1 on; 0 for all else.
LETTERS = b"0123456789abcdefghijklmnopqrstuvwxyz"
CODE = np.zeros(256, np.int32)
CODE[np.frombuffer(LETTERS, np.uint8)] = CODE[np.frombuffer(LETTERS.upper(), np.uint8)] = np.arange(1, 37)
#: Bytes of texts that are counted at once.
AT_ONCE = 8 << 20


def _djb2(h: np.ndarray, value: np.ndarray) -> np.ndarray:
    """One more byte of each."""
    return (h * 33 + value) % EMBED_MODULUS


def _begun(value: bytes, h: np.ndarray | int = 5381) -> np.ndarray:
    for b in value:
        h = _djb2(np.asarray(h, np.int64), b)
    return h


def _signed(h: np.ndarray, dim: int) -> np.ndarray:
    """Buckets of tokens from 1 on, negative where the sign is."""
    return np.where(_begun(b"#sign", h) % 2 == 0, 1, -1) * (h % dim + 1)


@lru_cache(maxsize=8)
def _trigrams(dim: int) -> np.ndarray:
    """The bucket of each three codes, a space being 0."""
    letters = np.frombuffer(b" " + LETTERS, np.uint8).astype(np.int64)
    h = _begun(b"g:")
    for axis in range(3):
        h = _djb2(h[..., None] if axis else np.full(1, h), letters)
    return _signed(h.ravel(), dim)


def _counted(raw: bytes, starts: np.ndarray, out: np.ndarray) -> None:
    """Adds to the rows of out the tokens of the texts that begin at starts in raw, with a byte that is no letter after each."""
    dim = out.shape[1]
    code = np.zeros(len(raw) + 2, np.int32)
    code[1:-1] = CODE[np.frombuffer(raw, np.uint8)]
    at = np.flatnonzero(code)
    if not len(at):
        return
    bucket = [_trigrams(dim)[(code[at - 1] * 37 + code[at]) * 37 + code[at + 1]]]
    row = [np.searchsorted(starts, at - 1, "right") - 1]
    first = at[code[at - 1] == 0]
    length = at[code[at + 1] == 0] - first + 1
    first, length = first[length > 1], length[length > 1]
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    letter = np.frombuffer(b" " + LETTERS, np.uint8).astype(np.int64)
    h = np.full(len(first), _begun(b"w:"))
    for k in range(int(length[0]) if len(length) else 0):
        n = np.searchsorted(-length, -k, "left")  # words of more than k letters stand in front
        h[:n] = _djb2(h[:n], letter[code[first[:n] + k]])
    bucket.append(_signed(h, dim))
    row.append(np.searchsorted(starts, first - 1, "right") - 1)
    b, r = np.concatenate(bucket), np.concatenate(row)
    out += np.bincount(r * dim + np.abs(b) - 1, np.sign(b), out.size).reshape(out.shape)


def token_sums_of(values: list[str | None], dim: int = DIM) -> np.ndarray:
    """The signed counts of the hash embedder for each text, before its length is made 1; texts of any length, some bytes at once."""
    out = np.zeros((len(values), dim))
    held, size, begin = [], 0, 0

    def count(end: int) -> None:
        if held:
            ends = np.cumsum([len(x) + 1 for x in held])
            _counted(b" ".join(held) + b" ", np.concatenate([[0], ends[:-1]]), out[begin:end])

    for i, value in enumerate(values):
        raw = (value or "").encode()
        while len(raw) > AT_ONCE and (cut := re.search(rb"[^0-9A-Za-z]", raw[AT_ONCE:])):
            _counted(raw[: AT_ONCE + cut.start()], np.zeros(1, np.int64), out[i : i + 1])
            raw = raw[AT_ONCE + cut.start() :]
        if held and size + len(raw) > AT_ONCE:
            count(i)
            held, size, begin = [], 0, i
        held.append(raw)
        size += len(raw)
    count(len(values))
    return out


def sparse_embedding(df, key: str, body: str, dim: int = DIM):
    """key, bucket, value: the signed counts of the hash embedder for each row; zeros are left out. No row leaves its task."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, bucket long, value long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sums = token_sums_of(part.column(1).to_pylist(), dim)
                row, bucket = np.nonzero(sums)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(bucket), pa.array(sums[row, bucket].astype(np.int64))], [key, "bucket", "value"])

    return df.select(key, F.col(body).cast("string")).mapInArrow(run, schema)


def hash_embeds(values: list[str | None], dim: int = DIM) -> np.ndarray:
    """The embedder: rows of unit length, zero for a text without words."""
    out = token_sums_of(values, dim)
    size = np.sqrt((out * out).sum(1))[:, None]
    return np.divide(out, size, out=out, where=size > 0)


def hash_embed(value: str | None, dim: int = DIM) -> np.ndarray:
    return hash_embeds([value], dim)[0]


def hash_embedding(body: Column, dim: int = DIM) -> Column:
    """hash_embed of a column, in Arrow batches."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<float>")
    def run(values):
        import pandas as pd

        return pd.Series(list(hash_embeds(values.tolist(), dim).astype("f4")))

    return run(body)


def projected(v: Column, weights: dict) -> Column:
    """A learned projection of an embedding, made unit length: full {dim, m} or low-rank {kind, dim, rank, U, V}.

    A vector of another length, or no weights, leaves the vector as it is.
    """
    from pyspark.sql.functions import pandas_udf

    from ..operators import projection

    @pandas_udf("array<double>")
    def run(values):
        import pandas as pd

        return pd.Series([None if x is None else projection.apply(weights, np.asarray(x, dtype=float)).tolist() for x in values])

    return run(v)


def lcg(seed: int):
    """Uniform numbers in (0, 1) of the multiplicative generator 16807 modulo 2**31 - 1."""
    s = seed % EMBED_MODULUS or EMBED_MODULUS - 1
    while True:
        s = s * 16807 % EMBED_MODULUS
        yield s / EMBED_MODULUS


def hyperplanes(dim: int, tables: int, bits: int, seed: int) -> np.ndarray:
    """[table, bit, dim]: unit normals of random hyperplanes, by Box and Muller's transform of lcg()."""
    rand = lcg(seed)
    out = np.empty(tables * bits * dim)
    for i in range(0, len(out), 2):
        u, v = next(rand), next(rand)
        r = np.sqrt(-2 * np.log(u))
        out[i] = r * np.cos(2 * np.pi * v)
        if i + 1 < len(out):
            out[i + 1] = r * np.sin(2 * np.pi * v)
    out = out.reshape(tables, bits, dim)
    return out / np.linalg.norm(out, axis=2, keepdims=True)


def lsh_keys(v: Column, planes: np.ndarray) -> Column:
    """A key for each table: table number and the signs of the products with its hyperplanes; in Arrow batches."""
    from pyspark.sql.functions import pandas_udf

    tables, bits, dim = planes.shape
    flat = planes.reshape(-1, dim).T

    @pandas_udf("array<string>")
    def run(values):
        import pandas as pd

        good = [x is not None and len(x) == dim for x in values]
        out = np.full(len(values), None, object)
        if any(good):
            signs = np.stack([np.asarray(x, dtype=float) for x, g in zip(values, good) if g]) @ flat >= 0
            codes = signs.reshape(-1, tables, bits) @ (1 << np.arange(bits)[::-1])
            for i, row in zip(np.flatnonzero(good).tolist(), codes.tolist()):
                out[i] = [f"{t}:{c:0{bits}b}" for t, c in enumerate(row)]
        return pd.Series(out)

    return run(v)
