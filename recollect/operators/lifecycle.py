"""Decay, clusters, summaries, observations, digests, tiers and purges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import staging
from ..functions import scores, text
from . import graph, greedy, models, search, store

#: Defaults.
DECAYED, CLUSTER, LEADER, REINFORCE = 0.05, 0.85, 0.80, 0.75
WEIGHT_BELOW, RETENTION_DAYS, BATCH, BATCHES = 0.5, 30, 20, 5
TIER2_PROOFS, TIER3_EVENTS, GRACE_DAYS, MOST_DECAYED = 3, 5, 7, 500


def with_weight(rows: DataFrame, as_of: Column) -> DataFrame:
    return rows.withColumn("weight", scores.decay_weight(F.col("importance"), F.col("decay_rate"), F.col("updated_at"), as_of))


def decayed(rows: DataFrame, as_of: Column, threshold: float = DECAYED) -> DataFrame:
    """Rows that decay, are still important, and whose weight has fallen below the threshold."""
    return with_weight(rows, as_of).where((F.col("decay_rate") > 0) & (F.col("importance") > 0) & (F.col("weight") < threshold))


def find_decayed(rows: DataFrame, as_of: Column, threshold: float = DECAYED, limit: int = MOST_DECAYED) -> DataFrame:
    """The oldest first."""
    return decayed(rows, as_of, threshold).orderBy("updated_at", "id").limit(limit)


def expired(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Importance 0 for the rows of ids."""
    marked = rows.join(ids.select("id").withColumn("_hit", F.lit(True)), "id", "left")
    return marked.withColumn("importance", F.when(F.col("_hit"), 0.0).otherwise(F.col("importance"))).drop("_hit")


def clusters(rows: DataFrame, threshold: float = CLUSTER) -> DataFrame:
    """scope, cluster_id, id: connected components of rows of a scope whose cosine reaches the threshold; no singles."""
    found = graph.components(search.near_links(rows, "id", "embedding", threshold, F.col("scope")))
    return found.join(rows.select("id", "scope"), "id").select("scope", F.col("component").alias("cluster_id"), "id")


def leader_clusters(rows: DataFrame, threshold: float = LEADER, order: str = "id") -> DataFrame:
    """scope, cluster_id, id, is_pivot: in order, each row joins the first cluster whose first member is near enough, else founds one.

    order is a column of whole numbers, unique in a scope. Scopes and rows of a scope are settled beside each other, in
    rounds. Rows without a vector are clusters of their own.
    """
    grp = F.coalesce(F.concat(F.lit("="), "scope"), F.lit("")).alias("grp")  # a null scope is one of its own
    own = rows.select(F.col("id").cast("long").alias("id"), grp, F.col(order).cast("long").alias("pos"), "embedding")
    found = greedy.leaders(greedy.stored(own, "embedding"), threshold)
    scope = F.when(F.col("grp") != "", F.substring("grp", 2, F.length("grp")))
    return found.select(scope.alias("scope"), F.col("leader").alias("cluster_id"), "id", (F.col("leader") == F.col("id")).alias("is_pivot"))


def summarization_batches(rows: DataFrame, as_of: Column, below: float = WEIGHT_BELOW, days: int = RETENTION_DAYS, size: int = BATCH, most: int | None = BATCHES) -> DataFrame:
    """scope, batch, position, id: rows of low weight and some age, by scope from the oldest, in chunks; the first `most` chunks of all."""
    old = F.col("updated_at") < as_of - F.make_interval(days=F.lit(days))
    own = with_weight(rows, as_of).where((F.col("weight") < below) & old & (F.col("kind") != "summary"))
    w = Window.partitionBy("scope").orderBy("updated_at", "id")
    placed = own.select("scope", "id", (F.row_number().over(w) - 1).alias("n"))
    placed = placed.select("scope", "id", F.floor(F.col("n") / size).alias("chunk"), (F.col("n") % size).alias("position"))
    if most is None:
        return placed.select("scope", F.col("chunk").alias("batch"), "position", "id")
    first = placed.select("scope", "chunk").distinct().orderBy("scope", "chunk").limit(most)
    return placed.join(F.broadcast(first), ["scope", "chunk"]).select("scope", F.col("chunk").alias("batch"), "position", "id")  # `most` rows


def noop_summary(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """title, body, source_count of each group: joined titles cut at 200, bodies as a list; groups are batches of bounded size."""
    part = F.array_sort(F.collect_list(F.struct(*order, F.coalesce("title", F.lit("")).alias("_t"), F.coalesce("body", F.lit("")).alias("_b"))))
    own = rows.groupBy(*by).agg(part.alias("own"), F.count("*").alias("source_count"))
    titles = F.filter(F.transform("own", lambda x: x["_t"]), lambda t: t != "")
    bodies = F.transform(F.filter(F.transform("own", lambda x: x["_b"]), lambda b: b != ""), lambda b: F.concat(F.lit("- "), b))
    title = F.when(F.size(titles) > 0, F.concat(F.lit("Summary: "), F.substring(F.array_join(titles, " | "), 1, 200))).otherwise(F.concat(F.lit("Summary of "), F.col("source_count").cast("string"), F.lit(" memories")))
    return own.select(*by, title.alias("title"), F.array_join(bodies, "\n").alias("body"), "source_count")


def promoted(session: DataFrame, target: Column, summarize: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A long-term row of a session's rows, with their ids as its sources."""
    found = summarize(session)
    return found.withColumns({"scope": target, "title": F.concat(F.lit("[promoted] "), F.col("title")), "kind": F.lit("summary")})


def best_body(rows: DataFrame, by: list[str]) -> DataFrame:
    """The body of the most important row of each group, the first of equals."""
    return rows.groupBy(*by).agg(F.max_by("body", F.struct("importance", (-F.col("id")).alias("first"))).alias("body"), F.avg("importance").alias("importance"), F.count("*").alias("proof_count"))


QUOTE = 200


def consolidated(rows: DataFrame, known: DataFrame, as_of: Column, threshold: float = LEADER, reinforce: float = REINFORCE) -> DataFrame:
    """What each cluster of unconsolidated rows does: scope, cluster_id, ids, quotes, action, observation_id, body, importance.

    action is reinforced, with the nearest observation if that is near enough to the cluster's pivot, or synthesised.
    ids and quotes (bodies cut at QUOTE) go in order of ids.
    """
    own = rows.where("consolidated_at is null and embedding is not null")
    member = leader_clusters(own, threshold)
    pivots = member.where("is_pivot").join(own.select("id", "embedding"), "id")
    best = search.batch_top(pivots.select(F.col("id"), "scope", "embedding"), known.select((-F.col("id") - 1).alias("id"), "scope", "embedding"), "id", "embedding", 1, F.col("scope"), reinforce)
    best = best.select(F.col("query_id").alias("cluster_id"), (-F.col("id") - 1).alias("observation_id"))
    full = member.join(own.select("id", "body", "importance"), "id")
    bodies = best_body(full, ["scope", "cluster_id"])
    said = full.groupBy("scope", "cluster_id").agg(F.array_sort(F.collect_list(F.struct("id", text.clip(F.coalesce("body", F.lit("")), QUOTE).alias("quote")))).alias("own"))
    said = said.select("scope", "cluster_id", F.col("own.id").alias("ids"), F.col("own.quote").alias("quotes"))
    out = bodies.join(said, ["scope", "cluster_id"]).join(best, "cluster_id", "left")
    action = F.when(F.col("observation_id").isNotNull(), "reinforced").otherwise("synthesised")
    return out.select("scope", "cluster_id", "ids", "quotes", action.alias("action"), "observation_id", "body", "importance", "proof_count", as_of.alias("at"))


def reinforced(observations: DataFrame, outcome: DataFrame, as_of: Column) -> DataFrame:
    """Observations with what consolidation found added: proofs, evidence, quotes, time and trend (from the new count)."""
    own = F.array_sort(F.collect_list(F.struct("cluster_id", "ids", "quotes")))
    add = outcome.where("action = 'reinforced'").groupBy(F.col("observation_id").alias("id")).agg(own.alias("own"))
    out = observations.join(add.select("id", F.flatten("own.ids").alias("more"), F.flatten("own.quotes").alias("more_quotes")), "id", "left")
    last = F.when(F.col("more").isNotNull(), as_of).otherwise(F.col("last_reinforced"))
    out = out.withColumns({"proof_count": F.col("proof_count") + F.coalesce(F.size("more"), F.lit(0)), "evidence_ids": F.concat("evidence_ids", F.coalesce("more", F.array().cast("array<long>"))), "last_reinforced": last})
    if "evidence_quotes" in observations.columns:
        out = out.withColumn("evidence_quotes", F.concat("evidence_quotes", F.coalesce("more_quotes", F.array().cast("array<string>"))))
    return out.withColumn("freshness_trend", scores.freshness(F.col("last_reinforced"), F.col("proof_count"), as_of)).drop("more", "more_quotes")


def synthesised(outcome: DataFrame, embedder: models.Embedder, first_id: int) -> DataFrame:
    """New observations of the clusters that reinforce none, with vectors of their own bodies; ids follow from the clusters'."""
    own = outcome.where("action = 'synthesised' and body != ''")
    new = own.select((F.lit(first_id) + F.col("cluster_id")).alias("id"), "scope", "body", F.col("proof_count").cast("int"), F.col("ids").alias("evidence_ids"), F.col("quotes").alias("evidence_quotes"), F.lit("new").alias("freshness_trend"), F.col("at").alias("last_reinforced"), F.col("at").alias("created_at"), F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.col("importance"))).alias("importance"))
    return models.embedded(new, "body", embedder).drop("was_truncated", "embed_error")


def tier_promotions(rows: DataFrame, observations: DataFrame, events: DataFrame, proofs: int = TIER2_PROOFS, least: int = TIER3_EVENTS) -> DataFrame:
    """id, old_tier, new_tier: 1 to 2 as evidence of a well-proven observation that isn't stale, 2 to 3 after enough mistakes or commands."""
    evidence = observations.where((F.col("proof_count") >= proofs) & (F.col("freshness_trend") != "stale")).select(F.explode("evidence_ids").alias("id")).distinct()
    up2 = rows.where("tier = 1").join(evidence, "id", "left_semi").select("id", F.col("tier").alias("old_tier"), F.lit(2).alias("new_tier"))
    often = events.where(F.col("event_type").isin("mistake", "direct_command")).groupBy("memory_id").count().where(F.col("count") >= least)
    up3 = rows.where("tier = 2").join(often, rows["id"] == often["memory_id"], "left_semi").select("id", F.col("tier").alias("old_tier"), F.lit(3).alias("new_tier"))
    return up2.union(up3)


def purged(rows: DataFrame, run_start: Column, days: int = GRACE_DAYS) -> DataFrame:
    """Without tier-0 rows that were consolidated before the grace time."""
    return rows.where(~F.coalesce((F.col("tier") == 0) & (F.col("consolidated_at") < run_start - F.make_interval(days=F.lit(days))), F.lit(False)))


def escalation(rows: DataFrame, events: DataFrame, alpha: float = 0.4) -> DataFrame:
    """id, old and new importance and tier of rows by their number of mistakes."""
    n = events.where("event_type = 'mistake'").groupBy(F.col("memory_id").alias("id")).agg(F.count("*").alias("n_mistakes"))
    out = rows.join(n, "id", "left").withColumn("n_mistakes", F.coalesce("n_mistakes", F.lit(0)))
    new = scores.escalated(F.col("importance"), F.col("n_mistakes"), alpha)
    return out.select("id", "n_mistakes", F.col("importance").cast("double").alias("old_importance"), new.alias("new_importance"), scores.tier_of(new).alias("new_tier"))


#: Rows of a scope that one digest takes.
DIGEST_ROWS = 500


def digest_clusters(rows: DataFrame, events: DataFrame, threshold: float = LEADER, most: int | None = DIGEST_ROWS) -> DataFrame:
    """scope, cluster_id, place (from 1 in its scope), best_id, importance, ids, n_mistakes: clusters of the tier-0 rows a digest takes.

    Of each scope the most important rows, then the oldest, form clusters in that order; the first of the most important
    members is the best one. With `most` of None a scope's rows are all taken.
    """
    w = Window.partitionBy("scope").orderBy(F.col("importance").desc(), "created_at", "id")
    own = rows.where("tier = 0 and consolidated_at is null").withColumn("_rn", F.row_number().over(w))
    own = own if most is None else own.where(F.col("_rn") <= most)
    member = leader_clusters(own, threshold, order="_rn").join(own.select("id", "_rn", "importance"), "id")
    mistakes = events.where("event_type = 'mistake'").groupBy(F.col("memory_id").alias("id")).agg(F.count("*").alias("n"))
    found = member.join(mistakes, "id", "left").groupBy("scope", "cluster_id").agg(
        F.min("_rn").alias("first"), F.max_by(F.struct("id", "importance"), F.struct("importance", (-F.col("_rn")).alias("r"))).alias("best"), F.sort_array(F.collect_list("id")).alias("ids"), F.sum(F.coalesce("n", F.lit(0))).alias("n_mistakes")
    )
    place = F.row_number().over(Window.partitionBy("scope").orderBy("first"))
    return found.select("scope", "cluster_id", place.alias("place"), F.col("best.id").alias("best_id"), F.col("best.importance").alias("importance"), "ids", "n_mistakes")


def digested(rows: DataFrame, known: DataFrame, events: DataFrame, as_of: Column, embedder: models.Embedder, first_id: int) -> dict[str, DataFrame]:
    """A digest of tier-0 rows: clusters, escalation, outcome (of consolidation), observations, promotions, and the rows it leaves.

    Consolidation runs once a scope, after its first cluster was looked at. A cluster whose best row is like no
    observation (none with a positive cosine: for the first cluster those before, for others also those that
    consolidation adds) has its best row escalated by the cluster's mistakes. All its rows are stamped; rows stamped
    longer than the grace time ago are purged.
    """
    clusters = staging.staged(digest_clusters(rows, events), "clusters")
    touched = rows.join(clusters.select("scope").distinct(), "scope", "left_semi")
    outcome = staging.staged(consolidated(touched, known, as_of), "outcome")
    new = staging.staged(synthesised(outcome, embedder, first_id), "observations")
    after = reinforced(known, outcome, as_of).unionByName(new, allowMissingColumns=True)
    best = clusters.join(rows.select(F.col("id").alias("best_id"), "embedding"), "best_id")
    like = lambda c, o: search.batch_top(c.select(F.col("best_id").alias("id"), "scope", "embedding"), o.select((-F.col("id") - 1).alias("id"), "scope", "embedding"), "id", "embedding", 1, F.col("scope"), 1e-12).select(F.col("query_id").alias("best_id"))
    hit = like(best.where("place = 1"), known).union(like(best.where("place > 1"), known.select("id", "scope", "embedding").union(new.select("id", "scope", "embedding"))))
    new_importance = scores.escalated(F.col("importance"), F.col("n_mistakes"))
    escalation = clusters.where("n_mistakes > 0").join(hit, "best_id", "left_anti").select(F.col("best_id").alias("id"), F.col("importance").cast("double").alias("old_importance"), new_importance.alias("new_importance"), scores.tier_of(new_importance).alias("new_tier"), "n_mistakes")
    escalation = staging.staged(escalation, "escalation")
    done = outcome.select(F.explode("ids").alias("id")).union(clusters.select(F.explode("ids"))).distinct().withColumn("_done", F.lit(True))
    out = rows.join(done, "id", "left").join(escalation.select("id", "new_importance", "new_tier"), "id", "left")
    out = out.withColumns({"consolidated_at": F.when(F.col("_done"), as_of).otherwise(F.col("consolidated_at")), "importance": F.coalesce("new_importance", F.col("importance").cast("double")), "tier": F.coalesce("new_tier", "tier")}).drop("_done", "new_importance", "new_tier")
    return {"clusters": clusters, "escalation": escalation, "outcome": outcome, "observations": after, "promotions": tier_promotions(out, after, events), "rows": purged(out, as_of)}


def summarise_run(rows: DataFrame, as_of: Column, summariser: Callable = models.noop, first_id: int = 0, dry_run: bool = False, **options) -> dict[str, DataFrame]:
    """Rows of low weight and some age by batches: summaries (with an error where there is none), and the rows with each batch replaced by its summary."""
    batches = summarization_batches(rows, as_of, **options)
    own = batches.join(rows.select("id", "title", "body", "importance"), "id")
    found = staging.staged(models.summarised(own, ["scope", "batch"], ["position"], summariser), "summaries")
    good = found.where("error is null")
    key = F.pmod(F.xxhash64("scope", "batch"), F.lit(1 << 40))
    summary = good.select((F.lit(first_id) + key).alias("id"), "scope", F.lit("summary").alias("kind"), "title", "body", F.lit(1.0).alias("importance"), F.lit(0.0).alias("decay_rate"), as_of.alias("created_at"), as_of.alias("updated_at"))
    left = rows if dry_run else store.replaced(rows, good.select(F.explode("source_ids").alias("id")), summary)
    return {"summaries": found, "rows": left}


def consolidate_run(rows: DataFrame, as_of: Column, summariser: Callable | None = None, first_id: int = 0, dry_run: bool = False, threshold: float = CLUSTER) -> dict[str, DataFrame]:
    """Expires decayed rows, finds near-duplicate clusters, and, with a summariser, puts a summary in place of each cluster."""
    gone = find_decayed(rows, as_of)
    found = staging.staged(clusters(rows, threshold), "clusters")
    out = rows if dry_run else expired(rows, gone)
    merged = found.limit(0).select("scope", "cluster_id")
    if summariser and not dry_run:
        own = found.join(rows.select("id", "title", "body"), "id")
        told = staging.staged(models.summarised(own, ["scope", "cluster_id"], ["id"], summariser), "summaries").where("error is null")
        summary = told.select((F.lit(first_id) + F.col("cluster_id")).alias("id"), "scope", F.lit("summary").alias("kind"), "title", "body", F.lit(1.0).alias("importance"), F.lit(0.0).alias("decay_rate"), as_of.alias("created_at"), as_of.alias("updated_at"))
        out, merged = store.replaced(out, told.select(F.explode("source_ids").alias("id")), summary), told.select("scope", "cluster_id")
    return {"expired": gone.select("id"), "clusters": found, "merged": merged, "rows": out}


def promote_session(rows: DataFrame, source: str, target: str, as_of: Column, summariser: Callable = models.noop, new_id: int = 0, delete_source: bool = False, limit: int = 200) -> DataFrame:
    """rows with a long-term summary of a session's oldest rows, which has their ids as its sources; the session's rows may go."""
    if not source or not target or source == target:
        raise ValueError("a session's scope and another one to promote it to are required")
    own = store.list_by_scope(rows, source, limit)
    told = models.summarised(own.withColumn("_at", F.unix_micros("created_at")), ["scope"], ["_at", "id"], summariser).where("error is null")
    title = F.when(F.col("title").startswith("[promoted] "), F.col("title")).otherwise(F.concat(F.lit("[promoted] "), "title"))
    meta = F.create_map(F.lit("promoted_from"), F.col("scope"), F.lit("source_ids"), F.array_join(F.col("source_ids").cast("array<string>"), ","))
    row = told.select(F.lit(new_id).cast("long").alias("id"), F.lit(target).alias("scope"), F.lit("summary").alias("kind"), title.alias("title"), "body", F.lit(1.0).alias("importance"), F.lit(0.0).alias("decay_rate"), meta.alias("metadata"), as_of.alias("created_at"), as_of.alias("updated_at"))
    left = rows.join(own.select("id"), "id", "left_anti") if delete_source else rows
    return left.unionByName(row, allowMissingColumns=True)


def folded_events(rows: DataFrame, events: DataFrame) -> DataFrame:
    """id, importance, tier after reversals and misses, applied in order of time and id: the rules don't commute.

    A row's events are one ordered array, folded in the JVM; only reversals and misses of it are gathered.
    """
    own = events.where(F.col("event_type").isin("reversal", "miss"))
    delta = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.col("delta").cast("double"), F.lit(0.5))))
    by = own.groupBy(F.col("memory_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("created_at", F.col("id").alias("event_id"), "event_type", delta.alias("delta")))).alias("own"))
    fold = lambda c, e: F.when(e["event_type"] == "miss", scores.bumped(c, e["delta"])).otherwise(scores.diminished(c, e["delta"]))
    out = rows.join(by, "id").withColumn("importance", F.aggregate("own", F.col("importance").cast("double"), fold))
    return out.select("id", "importance", scores.tier_of(F.col("importance")).alias("tier"), F.size("own").alias("n_events"))
