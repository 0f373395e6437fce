"""Corpus health from summaries that merge: a row a scope and day, held as a table, to which a batch adds only its own.

Counts, sums and maxima are exact however summaries are merged. The distinct count of ids and the quantiles of lengths come
from sketches (HyperLogLog and KLL), whose errors below hold for any order of merging, so no report reads all rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Of the sketches: 2 to this many registers, and items of the largest level. Of a quantile: most difference between the
#: rank asked for and the one given, as a share of rows; of a distinct count: relative standard error.
HLL_BITS, KLL_ITEMS = 12, 400
RANK_ERROR, DISTINCT_ERROR = 0.01, 0.016


def summaries(rows: DataFrame, long_chars: int, at: str = "created_at") -> DataFrame:
    """A summary for each scope and day of rows (id, scope, body, embedding): built where the rows are, then merged by key.

    Null bodies count as rows, not as lengths; rows of a null scope or day are a group of their own.
    """
    size = F.length("body").cast("long")
    return rows.groupBy("scope", F.to_date(at).alias("day")).agg(
        F.count("*").alias("n"), F.count(size).alias("n_bodies"), F.coalesce(F.sum(size), F.lit(0)).alias("chars"), F.max(size).alias("max_chars"), F.count_if(size > long_chars).alias("n_long"),
        F.count_if(F.col("embedding").isNull()).alias("n_without_vector"), F.hll_sketch_agg("id", HLL_BITS).alias("ids"), F.kll_sketch_agg_bigint(size, F.lit(KLL_ITEMS)).alias("lengths"),
    )


def merged(found: DataFrame, by: list[str | Column]) -> DataFrame:
    """Summaries of the same columns by fewer keys: of several batches (scope, day), of a scope, or of all."""
    total = [F.sum(c).alias(c) for c in ("n", "n_bodies", "chars", "n_long", "n_without_vector")]
    return found.groupBy(*by).agg(*total, F.max("max_chars").alias("max_chars"), F.hll_union_agg("ids", False).alias("ids"), F.kll_merge_agg_bigint("lengths").alias("lengths"))


def report(found: DataFrame, by: list[str | Column], share: float = 0.95) -> DataFrame:
    """n, avg_chars, p95_chars, max_chars, n_long, n_without_vector, n_ids by the keys, from summaries alone."""
    own = merged(found, by)
    quantile = F.when(F.col("n_bodies") > 0, F.kll_sketch_get_quantile_bigint("lengths", F.lit(share)))
    names = [c for c in own.columns if c not in ("n", "n_bodies", "chars", "n_long", "n_without_vector", "max_chars", "ids", "lengths")]
    return own.select(*names, "n", F.when(F.col("n_bodies") > 0, F.col("chars") / F.col("n_bodies")).alias("avg_chars"), quantile.alias("p95_chars"), "max_chars", "n_long", "n_without_vector", F.hll_sketch_estimate("ids").alias("n_ids"))


def added(held: DataFrame | None, batch: DataFrame, long_chars: int) -> DataFrame:
    """The held summaries with a batch of new rows merged in: to be written as the next version of the table."""
    new = summaries(batch, long_chars)
    return new if held is None else merged(held.unionByName(new), ["scope", "day"])
