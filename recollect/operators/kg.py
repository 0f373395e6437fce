"""Valid-time facts: subject, predicate, object, and the half-open time in which they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

KEY = ["scope", "subject", "predicate"]


def holds_at(at: Column) -> Column:
    return (F.col("valid_from") <= at) & (F.col("valid_until").isNull() | (F.col("valid_until") > at))


def superseded(facts: DataFrame) -> DataFrame:
    """Each open fact closes where the next of its subject and predicate begins; ties by id."""
    w = Window.partitionBy(*KEY).orderBy("valid_from", "id")
    return facts.withColumn("valid_until", F.coalesce("valid_until", F.lead("valid_from").over(w)))


def asserted(facts: DataFrame, new: DataFrame, supersede: bool = True) -> DataFrame:
    """Facts with new ones added; with supersede, open facts of the same subject and predicate close at the new one's start."""
    if supersede:
        first = new.groupBy(*KEY).agg(F.min("valid_from").alias("closing"))
        facts = facts.join(first, KEY, "left")
        closes = F.col("valid_until").isNull() & F.col("closing").isNotNull() & (F.col("valid_from") <= F.col("closing"))
        facts = facts.withColumn("valid_until", F.when(closes, F.col("closing")).otherwise(F.col("valid_until"))).drop("closing")
    return facts.unionByName(new, allowMissingColumns=True)


def _matching(facts: DataFrame, **wanted: str | None) -> DataFrame:
    for k, v in wanted.items():
        if v is not None:
            if not v:
                raise ValueError(f"{k} must not be empty")
            facts = facts.where(F.col(k) == v)
    return facts


def query(facts: DataFrame, at: Column | None = None, everything: bool = False, limit: int = 100, **wanted: str | None) -> DataFrame:
    """Facts that hold at a time (open ones without it), newest first."""
    own = _matching(facts, **wanted)
    if not everything:
        own = own.where(F.col("valid_until").isNull() if at is None else holds_at(at))
    return own.orderBy(F.col("valid_from").desc(), F.col("id").desc()).limit(max(1, min(1000, limit)))


def current(facts: DataFrame, at: Column) -> DataFrame:
    return facts.where(holds_at(at))


def timeline(facts: DataFrame, **wanted: str | None) -> DataFrame:
    return _matching(facts, **wanted).orderBy("valid_from", "id")


def invalidated(facts: DataFrame, at: Column, condition: Column) -> DataFrame:
    """Open facts that meet the condition close at a time, but not before they began; `closed` marks them."""
    closing = condition & F.col("valid_until").isNull()
    return facts.withColumns({"closed": closing, "valid_until": F.when(closing, F.greatest(at, F.col("valid_from"))).otherwise(F.col("valid_until"))})


def as_of_join(events: DataFrame, facts: DataFrame, event_key: list[str], event_time: str) -> DataFrame:
    """Each event with the fact of its key that holds at its time: the last that began, if it hasn't ended.

    Both sides are one stream a key, sorted by time, in which the last fact is carried on: no pair but the answer is made.
    """
    columns = [c for c in facts.columns if c not in KEY]
    left = events.select(*[F.col(e).alias(k) for e, k in zip(event_key, KEY)], F.col(event_time).alias("_at"), F.lit(1).alias("_side"), F.struct(*events.columns).alias("_event"), F.lit(None).alias("_fact"))
    right = facts.select(*KEY, F.col("valid_from").alias("_at"), F.lit(0).alias("_side"), F.lit(None).alias("_event"), F.struct(*columns).alias("_fact"))
    w = Window.partitionBy(*KEY).orderBy("_at", "_side", F.col("_fact.id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = left.unionByName(right).withColumn("_last", F.last("_fact", ignorenulls=True).over(w)).where("_side = 1")
    live = F.col("_last").isNotNull() & (F.col("_last.valid_until").isNull() | (F.col("_last.valid_until") > F.col("_at")))
    return found.select("_event.*", *[F.when(live, F.col(f"_last.{c}")).alias(f"fact_{c}") for c in columns])


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, other, leg: edges (source, target) one hop out (callee) and in (caller) of nodes (node)."""
    out = nodes.join(edges, F.col("node") == F.col("source")).select("node", F.col("target").alias("other"), F.lit("callee").alias("leg"))
    back = nodes.join(edges, F.col("node") == F.col("target")).select("node", F.col("source").alias("other"), F.lit("caller").alias("leg"))
    return out.union(back).distinct()
