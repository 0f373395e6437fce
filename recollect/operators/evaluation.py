"""Retrieval metrics, blend sweeps and query making."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

KS = (1, 3, 5, 10)


def first_ranks(results: DataFrame, gold: DataFrame, by: list[str] | None = None) -> DataFrame:
    """query_id, rank: the best rank of a gold row of each query (of gold), null where none was found."""
    hits = results.join(gold, ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return gold.select("query_id", *(by or [])).distinct().join(hits, "query_id", "left")


def metrics(ranks: DataFrame, ks: tuple[int, ...] = KS, by: list[str] | None = None) -> DataFrame:
    recalls = [F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in ks]
    return ranks.groupBy(*(by or [])).agg(F.count("*").alias("n"), *recalls, F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"), F.expr("percentile(rank, 0.5)").alias("median_rank"), F.sum(F.when(F.col("rank").isNull(), 1).otherwise(0)).alias("misses"))


def blend_sweep(scored: DataFrame, blends: DataFrame, k: int) -> DataFrame:
    """blend, query_id, id, rank: candidates (query_id, id, vec_n, fts_n), scored once, ranked under each of the few blends (blend, wv, wf)."""
    own = scored.crossJoin(F.broadcast(blends)).withColumn("score", F.col("wv") * F.col("vec_n") + F.col("wf") * F.col("fts_n"))  # a fixed number of blends
    w = Window.partitionBy("blend", "query_id").orderBy(F.col("score").desc(), "id")
    return own.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("blend", "query_id", "id", "rank")


def query_of(title: Column, body: Column, least: int = 8) -> Column:
    """A row's title if it is long enough, else the first 60 % of its body, from 8 to 200 characters."""
    n = F.greatest(F.lit(8), F.least(F.lit(200), F.floor(F.length(body) * 0.6).cast("int")))
    return F.when(F.length(title) >= least, title).otherwise(F.substring(body, F.lit(1), n))


def sample(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """A random but repeatable sample, by a hash of the id."""
    return rows.orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}"))), "id").limit(n)


def safe_k(recalls: list[tuple[int, float]], target: float = 0.85) -> int | None:
    """The least k that reaches the target."""
    return min((k for k, r in recalls if r >= target), default=None)
