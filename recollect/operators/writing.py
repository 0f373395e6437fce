"""Writes as one job: validate, embed, settle duplicates within the batch and against what is stored, and append."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .. import staging
from . import lifecycle, models, search, store


@dataclass(frozen=True)
class Written:
    """results: position, action (inserted, merged, skipped, or null with an error), match_id, error; inserted: new rows; merged: new versions of stored ones; misses: reinforcements."""

    results: DataFrame
    inserted: DataFrame
    merged: DataFrame
    misses: DataFrame


def write_many(incoming: DataFrame, stored: DataFrame, embedder: models.Embedder, as_of: Column, first_id: int, strategy: str = store.STRATEGY, threshold: float = store.DUPLICATE, miss: float = store.MISS, most_chars: int | None = None) -> Written:
    """The outcome of writing incoming (position, scope, kind, title, body, importance, decay_rate, tags, metadata) beside stored.

    A bad row has an error and doesn't stop others. In order of position, a row that is near an earlier one of its call
    (column `call`, if there is one) is its copy: with strategy update its body is appended to the first one's and its
    tags and metadata replace it, with skip it goes. What is left meets the nearest stored row of its scope the same way.
    append looks for no duplicates. A row that nearly repeats a stored one is a miss of retrieval. A row's id is first_id
    plus its position, so positions must differ over all calls. Calls, and the rows of a call, are settled beside each other, in rounds.
    """
    if strategy not in ("update", "skip", "append"):
        raise ValueError(f"strategy {strategy!r}")
    call = F.col("call") if "call" in incoming.columns else F.lit(0)
    checked = store.validated(incoming.withColumn("call", call.cast("string")))
    told = models.embedded(checked.withColumn("_text", F.concat_ws("\n", "title", "body")), "_text", embedder, most_chars).drop("_text")
    told = told.withColumn("error", F.coalesce("error", "embed_error")).drop("embed_error")
    told = staging.staged(told, "written")
    if told.groupBy("position").count().where("count > 1").limit(1).count():
        raise ValueError("a position is that of one row over all calls, for ids follow from it")
    good = told.where("error is null")
    own = good.select(F.col("position").alias("id"), F.col("call").alias("scope"), "embedding")
    copies = lifecycle.leader_clusters(own, threshold) if strategy != "append" else own.select("scope", F.col("id").alias("cluster_id"), "id", F.lit(True).alias("is_pivot"))
    copies = staging.staged(copies.select(F.col("id").alias("position"), F.col("cluster_id").alias("first")), "copies")
    firsts = _folded(good.join(copies, "position"), strategy)
    best = search.batch_top(firsts.select(F.col("position").alias("id"), "scope", "embedding"), stored.select((-F.col("id") - 1).alias("id"), "scope", "embedding"), "id", "embedding", 1, F.col("scope"), min(threshold, miss))
    best = staging.staged(best.select(F.col("query_id").alias("position"), (-F.col("id") - 1).alias("match_id"), "similarity"), "matches")
    near = best.where((F.col("similarity") >= threshold) & F.lit(strategy != "append"))
    inserted = firsts.join(near, "position", "left_anti").select((F.lit(first_id) + F.col("position")).alias("id"), *[c for c in firsts.columns if c not in ("position", "call", "first", "error")], as_of.alias("created_at"), as_of.alias("updated_at"))
    patch = firsts.join(near, "position").withColumn("id", F.col("match_id"))
    if strategy == "update":  # several rows that match one stored row: the last one's parts hold
        last = patch.groupBy("id").agg(F.max_by(F.struct("title", "body", "tags", "metadata"), "position").alias("p")).select("id", "p.*")
        merged = store.merged(stored, last, as_of)
    else:
        merged = stored.limit(0)
    misses = best.where(F.col("similarity") >= miss).join(firsts.select("position", "scope"), "position").select(F.col("match_id").alias("memory_id"), "scope", F.lit("miss").alias("event_type"), F.lit(0.5).alias("delta"), F.lit("miss:duplicate-write").alias("note"), as_of.alias("created_at"))
    copy = F.col("first") != F.col("position")
    outcome = {"update": "merged", "skip": "skipped", "append": "inserted"}[strategy]
    action = F.when(F.col("error").isNotNull(), None).when(copy | F.col("match_id").isNotNull(), outcome).otherwise("inserted")
    results = told.select("position", "error").join(copies, "position", "left").join(near.select("position", "match_id"), "position", "left")
    return Written(results.select("position", action.alias("action"), "match_id", F.when(copy, F.col("first")).alias("first_position"), "error"), inserted, merged, misses)


def _folded(rows: DataFrame, strategy: str) -> DataFrame:
    """The first row of each group of copies, with the bodies, tags and metadata of the others; a group is of one call."""
    firsts = rows.where("first = position")
    if strategy != "update":
        return firsts
    later = rows.where("first != position").groupBy("first").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "body"))), lambda x: x["body"]), "\n").alias("_bodies"),
        F.max_by("tags", F.when(F.col("tags").isNotNull(), F.col("position"))).alias("_tags"),
        F.max_by("metadata", F.when(F.col("metadata").isNotNull(), F.col("position"))).alias("_metadata"),
    )
    out = firsts.join(later, "first", "left").withColumns({"body": F.concat_ws("\n", "body", "_bodies"), "tags": F.coalesce("_tags", "tags"), "metadata": F.coalesce("_metadata", "metadata")})
    return out.select(*rows.columns)


def updated(stored: DataFrame, patch: DataFrame, embedder: models.Embedder, as_of: Column, most_chars: int | None = None) -> DataFrame:
    """New versions of the rows that patch (id, and what changes) names; a new title or body gets a new vector."""
    new = store.merged(stored, patch, as_of)
    old = stored.select("id", F.col("title").alias("_title"), F.col("body").alias("_body"))
    new = new.join(old, "id").withColumn("_changed", ~(F.col("title").eqNullSafe(F.col("_title")) & F.col("body").eqNullSafe(F.col("_body")))).drop("_title", "_body")
    same = new.where("not _changed").drop("_changed")
    return same.unionByName(models.reembedded(new.where("_changed").drop("_changed"), embedder, most_chars).drop("embed_error"), allowMissingColumns=True)
