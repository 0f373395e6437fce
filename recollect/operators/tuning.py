"""The best blend of two scores, exactly: a gold row's rank as a piecewise constant function of the blend.

At blend b a row scores (1 - b) * vec_n + b * fts_n, a line over b. Another row passes a gold row where their lines cross,
so the sorted crossings of a query's pool with a running count give the gold row's rank at every b, and the sum over
queries gives recall at every b, without trying any.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

PIECES = "query_id long, lo double, hi double, rank long"
#: Parts of the range of blends, whose sums make the running count one of many tasks.
PARTS = 1024


def _ranks(v: np.ndarray, f: np.ndarray, ids: np.ndarray, gold: np.ndarray) -> list[tuple[float, float, int | None]]:
    """(lo, hi, rank) of the best gold row: at 0, between crossings, and at 1; equal scores go by id."""
    if not gold.any():
        return [(0.0, 0.0, None), (0.0, 1.0, None), (1.0, 1.0, None)]
    ends, events = [], []
    for g in np.flatnonzero(gold):
        a, c = v - v[g], f - f[g]
        slope, first = c - a, ids < ids[g]
        ends.append([1 + int(((x > 0) | (x == 0) & first).sum()) for x in (a, c)])
        ahead = (a > 0) | (a == 0) & ((slope > 0) | (slope == 0) & first)
        with np.errstate(all="ignore"):
            at = np.where(slope != 0, -a / slope, -1.0)
        own = np.flatnonzero((at > 0) & (at < 1))
        own = own[np.argsort(at[own])]
        events.append((1 + int(ahead.sum()), at[own], np.cumsum(np.where(slope[own] > 0, 1, -1))))
    points = np.unique(np.concatenate([[0.0], *[at for _, at, _ in events]]))
    rank = np.min([base + np.concatenate([[0], run])[np.searchsorted(at, points, "right")] for base, at, run in events], axis=0)
    kept = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]]))
    lo, hi = points[kept], np.append(points[kept[1:]], 1.0)
    at0, at1 = (min(e[i] for e in ends) for i in (0, 1))
    return [(0.0, 0.0, at0), *zip(lo.tolist(), hi.tolist(), rank[kept].tolist()), (1.0, 1.0, at1)]


def rank_pieces(scored: DataFrame, gold: DataFrame) -> DataFrame:
    """PIECES of each query of gold (query_id, id): the best rank of its gold rows in its pool (query_id, id, vec_n, fts_n), null without one.

    Pieces with lo = hi are the ends 0 and 1 themselves; others hold between lo and hi. A pool is bounded, and one group.
    """
    named = gold.select("query_id", "id").distinct().withColumn("gold", F.lit(True))
    pool = scored.select("query_id", "id", F.col("vec_n").cast("double"), F.col("fts_n").cast("double"))
    own = pool.join(named, ["query_id", "id"], "left").join(named.select("query_id").distinct(), "query_id", "left_semi")
    lone = named.select("query_id").distinct().join(pool.select("query_id"), "query_id", "left_anti")

    def run(table: pa.Table) -> pa.Table:
        v, f, ids = (table.column(c).to_numpy() for c in ("vec_n", "fts_n", "id"))
        found = _ranks(v, f, ids, table.column("gold").is_valid().to_numpy())
        lo, hi, rank = zip(*found)
        return pa.table({"query_id": pa.array([table.column("query_id")[0].as_py()] * len(found), pa.int64()), "lo": lo, "hi": hi, "rank": pa.array(rank, pa.int64())})

    ends = F.explode(F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in ((0.0, 0.0), (0.0, 1.0), (1.0, 1.0))]))
    nothing = lone.select("query_id", ends.alias("e")).select("query_id", "e.lo", "e.hi", F.lit(None).cast("long").alias("rank"))
    return own.groupBy("query_id").applyInArrow(run, PIECES).union(nothing)


def curve(pieces: DataFrame, k: int) -> DataFrame:
    """lo, hi, hits: in how many queries a gold row is among the first k, at 0, between each two changes, and at 1."""
    inner = pieces.where("lo < hi and rank <= " + str(int(k)))
    ends = pieces.where("lo = hi").groupBy("lo", "hi").agg(F.count_if(F.col("rank") <= k).alias("hits"))
    zero = pieces.where("lo = 0 and hi > 0").limit(1).select(F.lit(0.0).alias("at"), F.lit(0).cast("long").alias("delta"))  # 0 begins a piece even where nothing hits
    change = inner.select(F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("delta")), F.struct(F.col("hi").alias("at"), F.lit(-1).alias("delta")))).alias("e")).select("e.at", F.col("e.delta").cast("long").alias("delta"))
    change = change.union(zero).where("at < 1").groupBy("at").agg(F.sum("delta").alias("delta")).where("delta != 0 or at = 0").withColumn("part", F.floor(F.col("at") * PARTS))
    every = Window.partitionBy(F.lit(0)).orderBy("part")  # a row for each part at most
    part = change.groupBy("part").agg(F.sum("delta").alias("sum"), F.min("at").alias("first"))
    part = part.select("part", (F.sum("sum").over(every) - F.col("sum")).alias("before"), F.lead("first").over(every).alias("next"))
    own = Window.partitionBy("part").orderBy("at")
    out = change.join(part, "part").select(F.col("at").alias("lo"), F.coalesce(F.lead("at").over(own), "next", F.lit(1.0)).alias("hi"), (F.col("before") + F.sum("delta").over(own)).alias("hits"))
    return out.unionByName(ends)


def best(found: DataFrame) -> DataFrame:
    """lo, hi, hits: of the pieces with most hits the widest, then the first."""
    return found.orderBy(F.col("hits").desc(), (F.col("hi") - F.col("lo")).desc(), "lo").limit(1)


def leave_one_out(pieces: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """query_id, blend, hit: the blend that all other queries would choose (of most hits there, the smallest), and what it gives the query.

    Without a query's own hit, the best of the rest is a piece with the most hits of all, or one with one less that the
    query misses; so only these few pieces meet the queries, cut at PARTS of the range.
    """
    inner = found.where("lo < hi")
    most = inner.agg(F.max("hits").alias("most"))  # one row
    good = inner.crossJoin(F.broadcast(most)).where(F.col("hits") >= F.col("most") - 1)
    parts = F.explode(F.sequence(F.floor(F.col("lo") * PARTS), F.least(F.floor(F.col("hi") * PARTS), F.lit(PARTS - 1))))
    cut = lambda df: df.withColumn("part", parts).withColumns({"lo": F.greatest("lo", F.col("part") / PARTS), "hi": F.least("hi", (F.col("part") + 1) / PARTS)}).where("lo < hi")
    own = cut(pieces.where("lo < hi").select("query_id", "lo", "hi", F.coalesce(F.col("rank") <= k, F.lit(False)).alias("hit")))
    other = cut(good.select("lo", "hi", "hits")).select("part", F.col("lo").alias("a"), F.col("hi").alias("b"), "hits")
    met = own.join(other, "part").where("greatest(lo, a) < least(hi, b)")
    choice = F.struct((F.col("hits") - F.col("hit").cast("int")).alias("rest"), (-F.greatest("lo", "a")).alias("at"), "hit")
    return met.groupBy("query_id").agg(F.max(choice).alias("c")).select("query_id", F.abs("c.at").alias("blend"), F.col("c.hit").alias("hit"))
