"""Compositions that surfaces show: a brief of a scope, its context, its health, and an agent's diary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text
from . import lifecycle, store

DIARY = "diary:"


def brief(rows: DataFrame, as_of: Column, top: int = 5, newest: int = 5) -> DataFrame:
    """scope, section (important or recent), place, id, title: for every scope, in one pass over each order."""
    weighted = lifecycle.with_weight(rows, as_of)

    def best(section: str, order: list, n: int) -> DataFrame:
        w = Window.partitionBy("scope").orderBy(*order)
        return weighted.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("scope", F.lit(section).alias("section"), "place", "id", "title")

    return best("important", [F.col("weight").desc(), F.col("id")], top).union(best("recent", [F.col("created_at").desc(), F.col("id").desc()], newest))


def context(rows: DataFrame, facts: DataFrame, at: Column, budget: int) -> DataFrame:
    """scope, tokens, n, lines: a scope's rows by weight until their approximate tokens reach the budget; what holds of its facts first."""
    live = facts.where((F.col("valid_from") <= at) & (F.col("valid_until").isNull() | (F.col("valid_until") > at)))
    said = live.select("scope", F.lit(0).alias("part"), F.lit(0.0).alias("by"), "id", F.concat_ws(" ", "subject", "predicate", "object").alias("line"))
    own = lifecycle.with_weight(rows, at).select("scope", F.lit(1).alias("part"), (-F.col("weight")).alias("by"), "id", F.concat_ws(": ", "title", text.clip(F.col("body"), 200)).alias("line"))
    w = Window.partitionBy("scope").orderBy("part", "by", "id")
    sized = said.union(own).withColumn("tokens", text.approx_tokens(F.col("line"))).withColumn("sum", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    kept = sized.where(F.col("sum") <= budget)
    lines = F.array_sort(F.collect_list(F.struct("part", "by", "id", "line")))
    return kept.groupBy("scope").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("lines"))


def doctor(rows: DataFrame, long_chars: int) -> DataFrame:
    """check, value: counts that should be 0 in a healthy store, from one aggregate."""
    health = store.corpus_health(rows, long_chars)
    bad = rows.agg(F.sum(F.when(F.trim("title") == "", 1).otherwise(0)).alias("blank_titles"), F.sum(F.when((F.col("importance") < 0) | (F.col("importance") > 10), 1).otherwise(0)).alias("importance_out_of_range"))
    both = health.select("n_long", "n_without_vector").crossJoin(bad)  # one row each
    return both.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in both.columns]), F.array(*[F.col(c).cast("long") for c in both.columns]))).alias("check", "value"))


def diary_row(agent: Column, body: Column) -> dict[str, Column]:
    """Columns of an entry in an agent's diary."""
    return {"scope": F.concat(F.lit(DIARY), agent), "kind": F.lit("diary"), "title": text.clip(body, 80), "body": body}


def with_slots(ranked: DataFrame, observations: DataFrame, most: int = 3) -> DataFrame:
    """The ranked list (rank), with at most so many observations (score) behind it; `slot` orders all."""
    end = ranked.agg(F.coalesce(F.max("rank"), F.lit(0)).alias("end"))
    own = observations.orderBy(F.col("score").desc(), "id").limit(most)
    own = own.withColumn("_n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("score").desc(), "id")))  # `most` rows
    behind = own.crossJoin(F.broadcast(end)).select("id", "score", (F.col("end") + F.col("_n")).alias("slot"), F.lit("observation").alias("leg"))
    return ranked.select("id", "score", F.col("rank").alias("slot"), F.lit("memory").alias("leg")).union(behind)
