"""Top rows of a full-text query without reading all postings of frequent terms: blocks of rows with the most they can score.

Rows are dealt into blocks of like length, and a small table keeps the most occurrences of each stem in any row of each
block. A cover of a query's n terms adds at most 1 to a row's cover density, and each cover begins at another occurrence
of a term, of which the last n - 1 begin none; so a row scores at most its terms' occurrences less n - 1, and a block no
more than that of its maxima (nothing, where it lacks a term). A search scores the few most promising blocks, and then
only those whose bound reaches the k-th score found there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .. import staging
from ..functions import fts

#: Rows of a block on average, and blocks that a search scores first.
BLOCK_ROWS, FIRST = 256, 8


@dataclass(frozen=True)
class Index:
    """postings: key, lexeme, positions, block, in order of lexeme and block; maxima: lexeme, block, most."""

    postings: DataFrame
    maxima: DataFrame


def build(rows: DataFrame, key: str, body: Column, block_rows: int = BLOCK_ROWS) -> Index:
    """The index of a table's texts, written once; texts without stems are in no block, and a null text has none."""
    own = staging.staged(fts.postings(rows, key, body), "postings")
    size = F.floor(F.log2(F.greatest("words", F.lit(1)))).cast("int")
    sizes = own.select(key, size.alias("size")).distinct().groupBy("size").count().collect()  # a row for each power of two
    cuts = F.create_map(*[F.lit(x) for r in sizes for x in (r["size"], -(-r["count"] // block_rows))]) if sizes else F.create_map(F.lit(0), F.lit(1))
    block = F.shiftleft(size.cast("long"), 40) + F.pmod(F.xxhash64(key), cuts[size].cast("long"))
    placed = own.withColumn("block", block).drop("words").repartitionByRange("lexeme", "block").sortWithinPartitions("lexeme", "block")
    placed = staging.staged(placed, "blocks")
    maxima = placed.groupBy("lexeme", "block").agg(F.max(F.size("positions")).alias("most"))
    index = Index(placed, staging.staged(maxima.repartitionByRange("lexeme").sortWithinPartitions("lexeme", "block"), "maxima"))
    staging.unstaged(own)
    return index


def bounds(index: Index, query: str) -> DataFrame:
    """block, bound: the blocks whose rows may hold all terms of the query, and the most that one of them can score."""
    wanted = fts.terms(query)
    own = index.maxima.where(F.col("lexeme").isin(*wanted)) if wanted else index.maxima.limit(0)
    n = len(wanted)
    return own.groupBy("block").agg(F.count("*").alias("n"), F.sum("most").alias("most")).where(F.col("n") == n).select("block", (F.col("most") - (n - 1)).cast("double").alias("bound"))


def read_blocks(index: Index, key: str, query: str, k: int, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
    """block, bound of the blocks that a search reads in its first and in its second step."""
    found = staging.staged(bounds(index, query), "bounds")
    ahead = staging.staged(found.orderBy(F.col("bound").desc(), "block").limit(first), "ahead")
    scored = fts.ranked(_within(index, ahead), key, query)
    best = scored.orderBy(F.col("fts_score").desc(), key).limit(k)
    least = best.agg(F.when(F.count("*") == k, F.min("fts_score")).alias("least"))
    rest = found.join(ahead.select("block"), "block", "left_anti").crossJoin(F.broadcast(least))  # one row
    return ahead, rest.where(F.coalesce(F.col("bound") >= F.col("least"), F.lit(True))).select("block", "bound")


def _within(index: Index, blocks: DataFrame) -> DataFrame:
    return index.postings.join(blocks.select("block"), "block", "left_semi")


def top(index: Index, key: str, query: str, k: int, first: int = FIRST) -> DataFrame:
    """key, fts_score: the k rows of greatest cover density (fts.ranked), ties by key."""
    ahead, rest = read_blocks(index, key, query, k, first)
    return fts.ranked(_within(index, ahead.union(rest)), key, query).orderBy(F.col("fts_score").desc(), key).limit(k)
