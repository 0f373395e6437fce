"""Connected components of links by alternating large-star and small-star steps, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import staging as common


def components(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """id, component (least id reachable) of every id in links(a, b); each round is a written table.

    Ids are of any type that has an order. Minima are combined map-side, and joins with them go by even_join, so that
    the star of a hot id doesn't stay in one task.
    """
    spark = links.sparkSession
    folder = common.new_folder(spark, "components")
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    before = None
    for i in range(most_rounds):
        edges = _small_star(_large_star(edges))
        edges.write.parquet(f"{folder}/{i}")
        edges = spark.read.parquet(f"{folder}/{i}")
        if i > 0:
            common.delete_folder(spark, f"{folder}/{i - 1}")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
        before = now
    raise RuntimeError("links did not settle")


def even_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """left join right on columns of which one value may hold much of left; right has few rows for each.

    The hash of the columns is one more column to join on. It forces an exchange of its own on either side even where
    right is an aggregate dealt by the same columns, and adaptive execution splits a skewed partition of plain exchanges.
    """
    on = [on] if isinstance(on, str) else on
    hashed = lambda df: df.withColumn(HASH, F.xxhash64(*on))
    return hashed(left).join(hashed(right), [*on, HASH], how).drop(HASH)


#: A column of a join, for a while.
HASH = "recollect hash of key"


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of an id is linked with the least of the id's neighbourhood."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return even_join(both, least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of an id, and the id, is linked with the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = even_join(edges, least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", "m")).distinct()
