"""N-gram Jaccard join by count vectors in R-trees.

A document is the set of its distinct word shingles. Shingles are hashed into groups, and a set's numbers of shingles in
each group are a point; the summed minima of two points' coordinates bound the overlap of the sets from above, and the
same sum over the corners of two boxes bounds every pair in them. Documents with equal sets are one class from the start.

R-trees over a whole corpus would prune nothing (boxes of many points are large), so points are first brought together
by shared prefix shingles, which loses no link: of two sets that link, the first n - ceil(0.75 n) + 1 shingles in any
common order intersect. The order is that of a fixed-size table of counts over all documents, rare ones first, so that
passages which many documents share fall out of the prefixes. Shingles that the same classes have are one list of
classes, so a passage of a hundred shingles gives its pairs once. Every list is joined by a dual walk down an R-tree of
its own, and the surviving pairs are verified on the whole sets.

Large groups of near copies don't make all their pairs: documents that share a min-hash with many others are first
verified against the few that their bounds say are closest (in chunks of the group) and against two leaders of the
group; only documents of different components are paired afterwards. A list of over BLOCK classes is dealt into blocks,
a large component's classes in blocks of their own, and pairs of blocks are joined, but for those of one component; so
no task ever holds more than two blocks, and what a large group costs is a pass over it for each block of the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.graph import components, even_join
from . import common

WORDS = 5
#: Documents link when PART * |union| <= WHOLE * |intersection|.
PART, WHOLE = 75, 100
GROUPS = 256
#: Cells of the table of counts (4 bytes each where it is summed, 2 where it is sent), and cells in one row of it.
CELL_BITS, CHUNK_BITS = 20, 12
#: Tasks whose tables are added in one group, chunk by chunk (16 KB each), until one table is left.
FAN_IN = 1024
#: Min-hashes of a document, documents that a min-hash is shared by before its group is looked into, and leaders of a group.
MINS, LEADER_LEAST, LEADERS = 3, 8, 2
#: Documents of a group that are looked through at once for each one's closest, and how many those are, for each of its min-hashes.
CHUNK, CLOSEST = 256, 2
#: Points of a leaf and children of a node.
FANOUT = 4
#: Classes of a list that one task joins at once, and documents of a shingle from which on its rows are dealt to several tasks.
BLOCK, HOT = 8192, 1 << 20
#: Least lists of a class, of as many residues, that tell whether a pair was given in an earlier list.
FIRSTS = 16
#: Bits of the filter that picks the texts to verify; all texts pass if it is full, and a join picks exactly.
FILTER_BITS = 24
#: Pairs of one class that are verified next to one copy of its set.
HUB = 1024
#: Words whose hashes a worker keeps.
CACHE_WORDS = 400_000
LOWER = bytes(b | 32 if 65 <= b <= 90 else b for b in range(256))
U64 = np.uint64
FACTORS = (np.random.default_rng(2024).integers(1 << 62, 1 << 63, 64, dtype=np.int64).astype(U64) << U64(1)) | U64(1)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = found
        return found


HASHES = WordHashes()


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct hashes, ascending; a text of fewer words is one shingle, one without words none."""
    common.claim("shingles", HASHES.clear)
    if len(HASHES) > CACHE_WORDS:
        HASHES.clear()
    cut = (text or "").encode().translate(LOWER).split()
    a = np.fromiter(map(HASHES.__getitem__, cut), U64, len(cut))
    k = min(words, len(a))
    if not k:
        return a
    n = len(a) - k + 1
    h = a[:n] * FACTORS[0] + U64(k)
    for i in range(1, k):
        h += a[i : n + i] * FACTORS[i]
    return np.unique(mix(h))


def class_of(h: np.ndarray) -> int:
    """A 64-bit name of a set."""
    found = (int(mix(h ^ FACTORS[60]).sum(dtype=U64)) + len(h) * int(FACTORS[61])) % (1 << 64)
    return found - (1 << 64) if found >> 63 else found


def prefix_length(n: int) -> int:
    return n - -(-PART * n // WHOLE) + 1


def links(common_n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether so large an overlap, or bound of one, may link sets of these sizes."""
    return WHOLE * common_n >= PART * (a + b - common_n)


FACTS = "doc_id long, mark long, cid long, n long, mins array<long>, points binary, wide binary, chunk int, cells binary"


def rounded(counts: np.ndarray) -> np.ndarray:
    """Counts in two bytes each: exact to 255, and within a 128th above."""
    return (counts.astype(np.float32).view(np.uint32) >> np.uint32(16)).astype("<u2")


def restored(sent: np.ndarray) -> np.ndarray:
    return (sent.astype(np.uint32) << np.uint32(16)).view(np.float32).astype(np.int64)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document (doc_id, mark, text), and the task's table of counts in rows of their own, under the task's number."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    cells = np.zeros(1 << CELL_BITS, np.int64)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
    names = ["doc_id", "mark", "cid", "n", "mins", "points", "wide", "chunk", "cells"]
    for batch in common.slices(batches, limit=4 << 20):
        rows, seen = [], []
        for doc_id, mark, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            h = shingles(text)
            mins = [int((h * FACTORS[40 + i]).min().astype(np.int64)) for i in range(MINS)] if len(h) else []
            points, wide = (packed(h, GROUPS), packed(h, groups_of(len(h)))) if len(h) else (None, None)
            rows.append((doc_id, mark, class_of(h), len(h), mins, points, wide, None, None))
            seen.append(h)
        cells += np.bincount((np.concatenate(seen) >> U64(64 - CELL_BITS)).astype(np.int64), minlength=1 << CELL_BITS)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)
    if cells.any():
        rows = [(None, task, *[None] * 5, i, x.tobytes()) for i, x in enumerate(rounded(cells).reshape(-1, 1 << CHUNK_BITS))]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)


def _cells(facts: DataFrame) -> np.ndarray:
    """The summed table; its size doesn't depend on the input. The tables of the tasks are added in a tree, FAN_IN at once."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, "<u4").astype(np.int64) if whole else restored(np.frombuffer(x, "<u2")) for x, whole in zip(group["cells"], group["whole"]))
        return pd.DataFrame({"chunk": [key[0]], "task": [key[1]], "whole": [True], "cells": [np.minimum(total, (1 << 31) - 1).astype("<u4").tobytes()]})

    rows = facts.where("chunk is not null").select("chunk", F.col("mark").alias("task"), F.lit(False).alias("whole"), "cells")
    tasks = 1 + (rows.agg(F.max("task")).first()[0] or 0)
    while True:
        tasks = -(-tasks // FAN_IN)
        rows = rows.withColumn("task", F.floor(F.col("task") / FAN_IN)).groupBy("chunk", "task").applyInPandas(run, "chunk int, task long, whole boolean, cells binary")
        if tasks <= 1:
            break
    out = np.zeros((1 << (CELL_BITS - CHUNK_BITS), 1 << CHUNK_BITS), np.uint32)
    for x in rows.collect():
        out[x["chunk"]] = np.frombuffer(x["cells"], "<u4")
    return out.ravel()


def _prefixes(held):
    """token, part, cid: the prefix shingles of each class that a task sees, once; part deals out those of over HOT documents, and is -1 for others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, known = held.value.astype(U64), set()
        for batch in common.slices(batches, "text", 4 << 20):
            tokens, counts, names, sizes = [np.zeros(0, U64)], [np.zeros(0, U64)], [], []
            for text in batch.column(0).to_pylist():
                h = shingles(text)
                if not len(h) or (cid := class_of(h)) in known:
                    continue
                known.add(cid)
                p = prefix_length(len(h))
                count = cells[(h >> U64(64 - CELL_BITS)).astype(np.int64)]
                key = (np.minimum(count, U64((1 << 24) - 1)) << U64(40)) | (h >> U64(24))
                own = key <= np.partition(key, p - 1)[p - 1]
                tokens.append(h[own])
                counts.append(count[own])
                names.append(cid)
                sizes.append(len(tokens[-1]))
            cids, count = np.repeat(np.array(names, np.int64), sizes), np.concatenate(counts)
            part = np.where(count > U64(HOT), (mix(cids.astype(U64)) % (count // U64(HOT) + U64(1))).astype(np.int64), -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).astype(np.int64)), pa.array(part), pa.array(cids)], ["token", "part", "cid"])

    return run


def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by their first column, cut anew so that no run of one value is split."""
    carry: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        first = table.column(0).to_numpy()
        if carry and carry[-1].column(0)[-1].as_py() == first[0]:
            if first[-1] == first[0]:
                carry.append(table)
                continue
        cut = int(np.searchsorted(first, first[-1]))
        done = pa.concat_tables([*carry, table.slice(0, cut)])
        if done.num_rows:
            yield done
        carry = [table.slice(cut)]
    if carry:
        yield pa.concat_tables(carry)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """list, cid: the classes of each token that several have, under a name that tokens of the same classes share.

    Rows (token, part, cid) are sorted so. Tokens of over HOT documents lie in several tasks: their rows pass under the
    token's own name as they come, so that no task gathers them. Others gather here, HOT rows of 24 bytes at most.
    """

    def hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = batch.column(1).to_numpy() >= 0
            if many.any():
                passed.append(batch.filter(pa.array(many)))
                batch = batch.filter(pa.array(~many))
            yield batch

    passed: list[pa.RecordBatch] = []
    for table in whole_runs(hot(batches)):
        yield from _passed(passed)
        t, c = table.column(0).to_numpy(), table.column(2).to_numpy()
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
        t, c = t[new], c[new]
        start = np.flatnonzero(np.diff(t, prepend=t[0] - 1) != 0)
        size = np.diff(np.append(start, len(t)))
        name = mix(np.add.reduceat(mix(c.astype(U64) ^ FACTORS[62]), start) + size.astype(U64) * FACTORS[63])
        keep = np.repeat(size > 1, size)
        own = np.repeat(name, size).astype(np.int64)[keep]
        own, c = np.unique(np.stack([own, c[keep]], axis=1), axis=0).T if keep.any() else (own, c[keep])
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(own)), pa.array(np.ascontiguousarray(c))], ["list", "cid"])
    yield from _passed(passed)


def _passed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    while held:
        batch = held.pop()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], ["list", "cid"])


def groups_of(n: int) -> int:
    """Groups of a set's own, wide count vector: about one for each shingle."""
    return max(GROUPS, 1 << (n - 1).bit_length())


def packed(h: np.ndarray, groups: int) -> bytes:
    """The number of shingles in each group, four bits a count; what is beyond 15 is made up for where it is unpacked."""
    c = np.minimum(np.bincount((h >> U64(8)).astype(np.int64) % groups, minlength=groups), 15).astype(np.uint8)
    return (c[::2] | c[1::2] << 4).tobytes()


def unpacked(points: list[bytes], n: np.ndarray) -> np.ndarray:
    """Count vectors, with what four bits couldn't hold as one more coordinate, so that the sum of minima stays a bound."""
    raw = np.frombuffer(b"".join(points), np.uint8).reshape(len(n), GROUPS // 2)
    counts = np.empty((len(n), GROUPS + 1), np.int32)
    counts[:, :-1:2], counts[:, 1::2] = raw & 15, raw >> 4
    counts[:, -1] = n - counts[:, :-1].sum(1)
    return counts


def _closest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b: for each class of a chunk (key, cid, n, points; sorted by key) those with the highest bounds that allow a link."""
    for table in whole_runs(batches):
        key, cid, n = (table.column(i).to_numpy() for i in range(3))
        points = unpacked(table.column(3).to_pylist(), n).astype(np.int16)
        edge = np.flatnonzero(np.diff(key, prepend=key[0] - 1, append=key[-1] + 1) != 0)
        found = [np.zeros((0, 2), np.int64)]
        for start, end in zip(edge, edge[1:]):
            for at in range(start, end, 64):
                rows = slice(at, min(end, at + 64))
                size = n[rows, None] + n[None, start:end]
                bound = np.minimum(points[rows, None], points[None, start:end]).sum(2, dtype=np.int64)
                fits = links(bound, n[rows, None], n[None, start:end]) & (cid[rows, None] != cid[None, start:end])
                value = np.where(fits, bound / size, -1.0)
                best = np.argsort(-value, axis=1, kind="stable")[:, :CLOSEST]
                i, j = np.nonzero(np.take_along_axis(value, best, 1) > 0)
                x, y = cid[at + i], cid[start + best[i, j]]
                found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def wide_counts(points: bytes) -> np.ndarray:
    raw = np.frombuffer(points, np.uint8)
    return np.stack([raw & 15, raw >> 4], axis=1).ravel().astype(np.int32)


def wide_bound(x: bytes, y: bytes, nx: int, ny: int) -> int:
    """The bound of two wide vectors; the longer one's groups are added up to the shorter one's."""
    a, b = wide_counts(x), wide_counts(y)
    rest = min(nx - int(a.sum()), ny - int(b.sum()))
    groups = min(len(a), len(b))
    return int(np.minimum(a.reshape(-1, groups).sum(0), b.reshape(-1, groups).sum(0)).sum()) + rest


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, na, nb, pa, pb, ra, rb) whose wide vectors allow a link."""
    for batch in batches:
        na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        bound = [wide_bound(x, y, i, j) for x, y, i, j in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), na.tolist(), nb.tolist())]
        yield batch.select(["a", "b", "ra", "rb"]).filter(pa.array(links(np.array(bound, np.int64), na, nb)))


class CountTrees:
    """R-trees over count vectors in the given order, one for each run of a key: level 0 holds all points, a node above spans up to FANOUT below it.

    A node has the largest of its points' coordinates, their least and greatest set size, their component if they have
    but one, and the place of its first child; in the last level each tree has one node.
    """

    def __init__(self, key: np.ndarray, points: np.ndarray, n: np.ndarray, comp: np.ndarray):
        start = np.flatnonzero(np.diff(key, prepend=key[0] - 1) != 0)
        count = np.diff(np.append(start, len(key)))
        self.levels = [(points.astype(np.int32), n, n, comp, np.ones(len(n), bool), None)]
        while count.max() > 1:
            top, low, high, own, pure, _ = self.levels[-1]
            rank = np.arange(len(low)) - np.repeat(start, count)
            at = np.flatnonzero(rank % FANOUT == 0)
            pure = np.logical_and.reduceat(pure, at) & (np.minimum.reduceat(own, at) == np.maximum.reduceat(own, at))
            self.levels.append((np.maximum.reduceat(top, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), own[at], pure, np.append(at, len(low))))
            count = -(-count // FANOUT)
            start = np.cumsum(count) - count

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of pairs of points of one tree and of different components whose bounds allow a link."""
        if len(self.levels) > 1:
            roots = np.arange(len(self.levels[-1][1]))
            yield from self._walk(len(self.levels) - 1, roots, roots)

    def _walk(self, level: int, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        top, low, high, own, pure, first = self.levels[level]
        for at in range(0, len(a), 1 << 14):
            x, y = a[at : at + (1 << 14)], b[at : at + (1 << 14)]
            live = ~(pure[x] & pure[y] & (own[x] == own[y])) & (WHOLE * high[x] >= PART * low[y]) & (WHOLE * high[y] >= PART * low[x])
            x, y = x[live], y[live]
            bound = np.minimum(top[x], top[y]).sum(1)
            live = links(bound, low[x], low[y])
            x, y = x[live], y[live]
            if not len(x):
                continue
            if level == 0:
                yield x, y
                continue
            step = np.arange(FANOUT)
            i, j = (first[x][:, None] + step)[:, :, None], (first[y][:, None] + step)[:, None, :]
            fits = (i < first[x + 1][:, None, None]) & (j < first[y + 1][:, None, None]) & (i < j if level == 1 else i <= j)
            i, j = np.broadcast_to(i, fits.shape)[fits], np.broadcast_to(j, fits.shape)[fits]
            yield from self._walk(level - 1, i, j)


def tiled(points: np.ndarray, comp: np.ndarray) -> np.ndarray:
    """An order of points that brings near ones together: larger components first, then slabs of the coordinate that varies most, each sorted by the next one."""
    _, inverse, count = np.unique(comp, return_inverse=True, return_counts=True)
    own = np.where(count[inverse] >= FANOUT, inverse + 1, 0)
    g, h = np.argsort(-points.var(axis=0), kind="stable")[:2]
    slab = np.empty(len(points), np.int64)
    slab[np.argsort(points[:, g], kind="stable")] = np.arange(len(points)) // max(1, int((FANOUT * len(points)) ** 0.5))
    return np.lexsort((points[:, h], slab, own))


CANDIDATES = ["key", "comp", "n", "cid", "part", "list", "points", "firsts"]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b: pairs of classes of different components of a list (of both blocks, where it has parts); rows: CANDIDATES, sorted so.

    A pair is not given where its classes' least lists show that they share an earlier one, which gives it.
    """
    for table in whole_runs(batches):
        t, comp, n, cid, part, of = (table.column(i).to_numpy() for i in range(6))
        points = unpacked(table.column(6).to_pylist(), n)
        firsts = table.column(7).combine_chunks().flatten().to_numpy().reshape(-1, FIRSTS)
        start = np.flatnonzero(np.diff(t, prepend=t[0] - 1) != 0)
        order = np.arange(len(t))
        for at, k in zip(start, np.diff(np.append(start, len(t)))):
            if k > FANOUT**2:
                order[at : at + k] = at + tiled(points[at : at + k], comp[at : at + k])
        points, n, comp, cid, part, firsts = points[order], n[order], comp[order], cid[order], part[order], firsts[order]
        found = [np.zeros((0, 2), np.int64)]
        for i, j in CountTrees(t, points, n, comp).pairs():
            earlier = ((firsts[i] == firsts[j]) & (firsts[i] < of[i][:, None])).any(1)
            asked = ((part[i] < 0) | (part[i] != part[j])) & ~earlier
            x, y = cid[i[asked]], cid[j[asked]]
            found.append(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0))
        pairs = np.unique(np.concatenate(found), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _blocks(lists: DataFrame, points: DataFrame, block: int) -> tuple[DataFrame, list[DataFrame]]:
    """CANDIDATES of all lists, and the staged tables that they read; lists of over block classes are dealt into blocks, and each pair of blocks is a key.

    A component of over block classes in a list has blocks of its own; pairs of blocks of one such component have no
    pairs to give. Other classes are dealt by component.
    """
    size = common.staged(lists.groupBy("list").agg(F.count("*").alias("size")).where(F.col("size") > block), "hot")
    whole = even_join(even_join(lists, size, "list", "left_anti"), points, "cid").select(F.col("list").alias("key"), "comp", "n", "cid", F.lit(-1).alias("part"), "list", "points", "firsts")
    hot = even_join(even_join(lists, size, "list"), points, "cid")
    of = hot.groupBy("list", "comp").agg(F.count("*").alias("own")).where(F.col("own") > block)
    of = common.staged(of, "hotcomps")
    ceil = lambda c: F.ceil(F.col(c) / block).cast("long")
    own = F.col("own").isNotNull()
    place = F.pmod(F.xxhash64(F.when(own, F.col("cid")).otherwise(F.col("comp"))), F.when(own, ceil("own")).otherwise(ceil("size")))
    dealt = even_join(hot, of, ["list", "comp"], "left").select("list", "cid", "comp", "n", "points", "firsts", F.when(own, F.col("comp")).alias("of"), place.alias("place"))
    dealt = common.staged(dealt.withColumn("block", F.xxhash64(F.coalesce("of", F.lit(0)), "of", "place")), "dealt")
    known = dealt.select("list", "block", "of").distinct()
    grid = known.alias("x").join(known.alias("y"), "list").where("x.block < y.block and not (x.of is not null and y.of is not null and x.of = y.of) or x.block = y.block and x.of is null")
    grid = grid.select("list", F.xxhash64("list", "x.block", "y.block").alias("key"), F.col("x.block").alias("bx"), F.col("y.block").alias("by"))
    sides = grid.select("list", "key", F.col("bx").alias("block"), F.when(F.col("bx") == F.col("by"), -1).otherwise(0).alias("part")).union(grid.where("bx != by").select("list", "key", "by", F.lit(1)))
    return whole.union(even_join(dealt, sides, ["list", "block"]).select(*CANDIDATES)), [size, of, dealt]


def _filter_of(wanted: DataFrame, column: str) -> np.ndarray:
    """A bit for the hash of each value of a column: doc_ids go by xxhash64, classes are hashes themselves."""
    place = F.pmod(F.xxhash64(column) if column == "rep" else F.col(column), F.lit(1 << FILTER_BITS))
    words = wanted.select(F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, cast(pmod({}, 64) as int))".format(f"xxhash64({column})" if column == "rep" else column)).alias("bit")).groupBy("word").agg(F.expr("bit_or(bit)").alias("bits")).collect()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for x in words:
        bits[x["word"]] = x["bits"]
    return bits


def _verify(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b (rep, cid of either): the pairs of classes (a, b, ra, rb) whose whole sets link."""
    spark = docs.sparkSession
    pairs = common.staged(pairs, "pairs")
    wanted = common.staged(pairs.select(F.col("a").alias("cid"), F.col("ra").alias("rep")).union(pairs.select("b", "rb")).distinct(), "wanted")
    held = spark.sparkContext.broadcast((_filter_of(wanted, "rep"), _filter_of(wanted, "cid")))  # of a fixed size

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_doc, by_class = held.value
        for batch in batches:
            at = batch.column(1).to_numpy()
            batch = batch.filter(pa.array((by_doc[at >> 6] >> (at & 63)) & 1 == 1))
            for part in common.slices([batch], "text", 4 << 20) if batch.num_rows else ():
                found = [(class_of(h), h) for h in map(shingles, part.column(0).to_pylist())]
                at = np.array([c for c, _ in found], np.int64) & (64 * len(by_class) - 1)
                kept = [x for x, k in zip(found, (by_class[at >> 6] >> (at & 63)) & 1) if k]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in kept], pa.int64()), pa.array([h.tobytes() for _, h in kept], pa.binary())], ["cid", "set"])

    rows = docs.select("text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS)).alias("at"))
    found = common.staged(rows.mapInArrow(sets, "cid long, set binary").dropDuplicates(["cid"]), "sets")

    # the class of more pairs is the hub of a pair: its set goes once to each HUB of its pairs, the other's with the pair
    degree = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).groupBy("cid").agg(F.count("*").alias("degree"))
    counted = even_join(even_join(pairs, degree.withColumnsRenamed({"cid": "a", "degree": "da"}), "a"), degree.withColumnsRenamed({"cid": "b", "degree": "db"}), "b")
    hub = lambda x, y: F.when(F.col("da") >= F.col("db"), F.col(x)).otherwise(F.col(y))
    turned = counted.select(hub("a", "b").alias("a"), hub("b", "a").alias("b"), hub("ra", "rb").alias("ra"), hub("rb", "ra").alias("rb"), F.greatest("da", "db").alias("degree"))
    turned = turned.withColumn("part", F.pmod(F.xxhash64("b"), F.ceil(F.col("degree") / HUB))).drop("degree")
    others = even_join(turned, found.withColumnRenamed("cid", "b"), "b").select("a", "part", "b", "ra", "rb", "set")
    none = F.lit(None).cast("long")
    hubs = even_join(turned.select("a", "part").distinct(), found.withColumnRenamed("cid", "a"), "a").select("a", "part", none.alias("b"), none.alias("ra"), none.alias("rb"), "set")
    met = others.union(hubs).repartition(F.col("a"), F.col("part")).sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    linked = met.mapInArrow(_linked, "a long, b long, ra long, rb long")
    linked = common.staged(linked.select(_node("ra", "a").alias("a"), _node("rb", "b").alias("b")), "verified")
    common.unstaged(pairs, wanted, found)
    held.unpersist()
    return linked


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, ra, rb of the pairs that link. Rows are sorted by (a, part); the first of each, of no b, holds the set of a, others that of b."""
    own, x = None, np.zeros(0, U64)
    for batch in batches:
        keep = []
        for a, b, held in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(5)):
            y = np.frombuffer(held.as_buffer(), U64)
            if b is None:
                own, x = a, y.copy()
            both = len(x) + len(y) - len(np.union1d(x, y))
            keep.append(b is not None and a == own and WHOLE * both >= PART * (len(x) + len(y) - both))
        yield batch.select(["a", "b", "ra", "rb"]).filter(pa.array(keep, pa.bool_()))


def _node(rep: str, cid: str) -> F.Column:
    """A class as a node of the graph: nodes order by their least doc_id."""
    return F.struct(F.col(rep).alias("rep"), F.col(cid).alias("cid"))


def keep(docs: DataFrame) -> DataFrame:
    """One row of docs, with all its columns, for each component: of its class of the least doc_id, the row of that doc_id.

    Rows of a null doc_id and those without shingles (null, empty and blank texts) all stay. A doc_id that several
    different texts have is as many documents, each judged by its own text. Of several such rows of one class (texts that
    differ in white space or case) the one of the least text hash stays, of rows of one doc_id and text any one. Texts
    may be of any length. An empty table gives no rows.
    """
    found = common.staged(_labelled(docs.select(*_columns())), "labelled")
    kept = found.where("component.cid = cid and component.rep = doc_id").groupBy("cid").agg(F.first("doc_id").alias("kept_id"), F.min("mark").alias("kept_mark"))
    marked = docs.withColumn(MARK, _mark())
    one = marked.join(kept, (marked["doc_id"].cast("long") == kept["kept_id"]) & (marked[MARK] == kept["kept_mark"]), "left_semi").dropDuplicates(["doc_id", MARK]).drop(MARK)
    blank = found.where("n = 0").select(F.col("doc_id").alias("kept_id"), F.col("mark").alias("kept_mark"))
    rest = marked.join(blank, (marked["doc_id"].cast("long") == blank["kept_id"]) & (marked[MARK] == blank["kept_mark"]), "left_semi").drop(MARK)
    return one.unionByName(rest).unionByName(docs.where("doc_id is null"))


#: A column that holds the mark of a text for a while.
MARK = "recollect mark of text"


def _mark() -> F.Column:
    return F.xxhash64(F.col("text").cast("string"))


def _columns() -> list[F.Column]:
    return [F.col("doc_id").cast("long").alias("doc_id"), _mark().alias("mark"), F.col("text").cast("string").alias("text")]


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links) for each row of docs.

    Null and empty texts, and those of white space, have no shingles and link with nothing. Rows that repeat a doc_id
    each have a result; one of a null doc_id has its component's least doc_id, or null. Texts may be of any length: all
    of their shingles count, and a task holds a few texts at once. Other columns are ignored; an empty table gives no
    rows. Equal sets are told by 64-bit names: of ten billion different sets about three pairs may pass for equal.
    """
    rows = _labelled(docs.select(*_columns()))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component.rep", "doc_id").alias("component_id"))


def _labelled(docs: DataFrame, block: int | None = None) -> DataFrame:
    """doc_id, mark, n, cid, component (rep, cid: of the component's class of the least doc_id; null where nothing links) for each row."""
    block, spark = block or BLOCK, docs.sparkSession
    facts = common.staged(docs.mapInArrow(_facts, FACTS), "facts")
    rows = facts.where("chunk is null")
    classes = rows.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("mins").alias("mins"), F.first("points").alias("points"), F.first("wide").alias("wide"))
    classes = common.staged(classes.where("rep is not null"), "classes")
    cells = spark.sparkContext.broadcast(_cells(facts))  # of a fixed size

    mins = classes.select("cid", F.posexplode("mins").alias("i", "m"))
    named = F.struct(F.xxhash64("cid", "i").alias("h"), "cid")
    groups = mins.groupBy("i", "m").agg(F.count("*").alias("members"), F.array(F.min(named)["cid"], F.max(named)["cid"]).alias("leaders")).where(F.col("members") >= LEADER_LEAST)
    large = common.staged(even_join(mins, groups, ["i", "m"]), "large")
    led = large.select("cid", F.explode("leaders").alias("leader")).where("cid != leader").select(F.least("cid", "leader").alias("a"), F.greatest("cid", "leader").alias("b"))
    side = lambda x: classes.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("wide").alias(f"p{x}"), F.col("rep").alias(f"r{x}"))
    bounded = lambda p: p.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "pa", "pb", "ra", "rb").mapInArrow(_bounded, "a long, b long, ra long, rb long")
    chunk = F.xxhash64("i", "m", F.pmod(F.xxhash64("cid"), F.ceil(F.col("members") / CHUNK)))
    chunks = large.select("cid", chunk.alias("key")).join(classes.select("cid", "n", "points"), "cid").select("key", "cid", "n", "points")
    near = chunks.repartition(F.col("key")).sortWithinPartitions("key", "cid").mapInArrow(_closest, "a long, b long")
    led = _verify(docs, classes, bounded(led.union(near).distinct()))
    comps = components(led).select(F.col("id.cid").alias("cid"), F.col("component.cid").alias("comp"))
    points = classes.select("cid", "n", "points").join(comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))

    tokens = docs.select("text").mapInArrow(_prefixes(cells), "token long, part long, cid long")
    lists = tokens.repartition(F.col("token"), F.col("part")).sortWithinPartitions("token", "part", "cid").mapInArrow(_lists, "list long, cid long")
    lists = common.staged(lists.distinct(), "lists")
    least = [F.min(F.when(F.pmod("list", F.lit(FIRSTS)) == k, F.col("list"))) for k in range(FIRSTS)]
    firsts = lists.groupBy("cid").agg(F.array(*[F.coalesce(x, F.lit((1 << 63) - 1)) for x in least]).alias("firsts"))
    points = points.join(firsts, "cid")
    rows_of_lists, used = _blocks(lists, points, block)
    rows_of_lists = rows_of_lists.repartition(F.col("key")).sortWithinPartitions("key", "comp", "n", "cid")
    pairs = rows_of_lists.mapInArrow(_candidates, "a long, b long").distinct()
    linked = _verify(docs, classes, bounded(pairs)).union(led)
    common.unstaged(lists, large, *used)

    found = components(linked).select(F.col("id.cid").alias("cid"), "component")
    labelled = classes.select("cid", _node("rep", "cid").alias("own")).join(found, "cid", "left").select("cid", F.coalesce("component", "own").alias("component"))
    return even_join(rows.select("doc_id", "mark", "n", "cid"), labelled, "cid", "left")
