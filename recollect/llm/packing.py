"""Best-fit decreasing packing of token sequences into windows.

Overlong documents are first cut into full windows; what remains of each document is placed, longest first, into the
open window with the least sufficient room, found by a segment tree over remaining capacities. The pieces are dealt to
groups of about group_pieces by a hash, so that no task grows with the corpus; each group packs on its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common, tokens

WINDOW = 2048
END_ID = 1
#: Pieces packed by one task; more pieces make more groups.
GROUP_PIECES = 6144
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Rooms:
    """Open windows by remaining capacity, under a segment tree that answers "least capacity >= n that is open"."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, which: int) -> None:
        self.open[capacity].append(which)
        if len(self.open[capacity]) == 1:
            self._count(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The capacity and the window of the tightest fit, removed from the tree."""
        tree, at = self.tree, need + self.leaves
        if not tree[at]:
            while True:  # up to the first subtree to the right that has an open window, then down its left edge
                if at == 1:
                    return None
                if not at & 1 and tree[at + 1]:
                    at += 1
                    break
                at >>= 1
            while at < self.leaves:
                at = 2 * at if tree[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        which = self.open[capacity].pop()
        if not self.open[capacity]:
            self._count(capacity, -1)
        return capacity, which

    def _count(self, capacity: int, by: int) -> None:
        at = capacity + self.leaves
        while at:
            self.tree[at] += by
            at >>= 1


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The window and the offset in it of each piece; lengths are from 1 to window, ties go by position."""
    rooms, n = Rooms(window), 0
    of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        capacity, which = rooms.take(need) or (window, n)
        n += which == n
        of[i], offset[i] = which, window - capacity
        if capacity > need:
            rooms.add(capacity - need, which)
    return of, offset


def piece_rows(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: full windows of a document, then what is left; deal is the piece's number in its task."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, dealt = tokens.encoder(path), 0
        for batch in common.slices(batches):
            out: list[list] = [[], [], [], [], []]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                raw = ids + end
                total = len(raw) // 4
                for start in range(0, total, window):
                    piece = raw[4 * start : 4 * (start + window)]
                    for column, x in zip(out, (doc_id, start, len(piece) // 4, zlib.crc32(piece), total)):
                        column.append(x)
            out.append(list(range(dealt, dealt + len(out[0]))))
            dealt += len(out[0])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "deal"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"{PIECES}, deal long")


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece.

    Null and empty texts are one end id. Rows that repeat a doc_id are packed as documents of their own; a null doc_id
    stays null. An empty table gives no rows. Other columns of docs are ignored. Texts may be of any length: each is
    encoded as a whole and cut into windows. Pieces of one length go by doc_id, start and content. Pieces are dealt to
    groups also by their number in their task, so that rows repeated any number of times spread over all groups.
    sequence_id is the group's number times 2**32 plus the window's number in it.
    """
    pieces = common.staged(piece_rows(docs, path, window, end_id), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        of, offset = best_fit_decreasing(group["length"].to_numpy(), window)
        return group.assign(sequence_id=of + (int(key[0]) << 32), offset=offset).drop(columns=["part", "deal"])

    part = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "deal"), F.lit(groups))
    return pieces.withColumn("part", part).groupBy("part").applyInPandas(run, f"{PIECES}, sequence_id long, offset long")
