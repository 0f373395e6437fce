"""Memory rows as an append-only log: a version of a row for each change, the latest of which holds; deletes are tombstones."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import staging
from ..functions import scores, text, vectors
from . import graph, greedy, search

#: Defaults of writes.
DUPLICATE, MISS, STRATEGY = 0.95, 0.90, "update"
LOG = ("_version", "_op")


def current(log: DataFrame, key: str = "id") -> DataFrame:
    """The rows that hold: of each key the highest version, unless it deletes."""
    w = Window.partitionBy(key).orderBy(F.col("_version").desc())
    return log.withColumn("_rn", F.row_number().over(w)).where("_rn = 1 and _op != 'D'").drop("_rn", *LOG)


def versioned(rows: DataFrame, version: int, op: str = "U") -> DataFrame:
    return rows.withColumns({"_version": F.lit(version).cast("long"), "_op": F.lit(op)})


def append(spark, path: str, rows: DataFrame, version: int, op: str = "U") -> None:
    """One commit: all rows of a write, tombstones among them, appear together; files are dealt by scope for pruning."""
    versioned(rows, version, op).write.mode("append").partitionBy("scope").parquet(path)


def compacted(log: DataFrame) -> DataFrame:
    return versioned(current(log), 0)


def get(rows: DataFrame, id_: int) -> DataFrame:
    return rows.where(F.col("id") == id_).drop("embedding")


def recent(rows: DataFrame, scope=None, kind: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """Newest first."""
    own = search.filtered(rows, scope=scope, kind=kind)
    return own.orderBy(F.col("created_at").desc(), F.col("id").desc()).offset(max(0, offset)).limit(max(1, min(200, limit)))


def list_by_scope(rows: DataFrame, scope: str, limit: int = 200, include_summaries: bool = False) -> DataFrame:
    """Oldest first."""
    own = rows.where(F.col("scope") == scope)
    own = own if include_summaries else own.where("kind != 'summary'")
    return own.orderBy("created_at", "id").limit(max(1, min(1000, limit)))


def validated(rows: DataFrame) -> DataFrame:
    """Adds `error`, null for good rows, and fills in kind, importance, decay_rate and tier; errors don't stop others."""
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    error = F.when(blank("scope"), "scope required").when(blank("title"), "title required").when(blank("body"), "body required")
    importance, decay = F.coalesce("importance", F.lit(1.0)), F.coalesce("decay_rate", F.lit(0.0))
    tier = F.coalesce(scores.clamped_tier(F.col("tier")), scores.tier_of(importance)) if "tier" in rows.columns else scores.tier_of(importance)
    return rows.withColumns({"error": F.coalesce(error, scores.importance_error(importance, decay)), "kind": F.coalesce("kind", F.lit("fact")), "importance": importance, "decay_rate": decay, "tier": tier})


def write_actions(incoming: DataFrame, stored: DataFrame, duplicate: float = DUPLICATE, miss: float = MISS, strategy: str = STRATEGY) -> DataFrame:
    """id, match_id, similarity, action, is_miss for each incoming row: the most similar stored row of its scope decides.

    inserted: none reaches the threshold, or the strategy is append; merged: update; skipped: skip.
    """
    best = search.batch_top(incoming, stored, "id", "embedding", 1, F.col("scope")).select(F.col("query_id").alias("id"), F.col("id").alias("match_id"), "similarity")
    action = F.when(F.col("similarity") >= duplicate, {"update": "merged", "skip": "skipped", "append": "inserted"}[strategy]).otherwise("inserted")
    out = incoming.select("id").join(best, "id", "left")
    return out.withColumns({"action": action, "is_miss": F.coalesce(F.col("similarity") >= miss, F.lit(False))})


def first_of_equals(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """Within a batch the first of equal rows stays; `kept_id` is its id for the others."""
    w = Window.partitionBy(*group)
    return rows.withColumn("kept_id", F.min(order).over(w)).withColumn("is_first", F.col(order) == F.col("kept_id"))


def first_of_near(rows: DataFrame, id_col: str, body: str, threshold: float = DUPLICATE) -> DataFrame:
    """id, kept_id, is_first of rows in order of id: a row whose hash embedding's cosine with an earlier kept row reaches the threshold is a copy of the first such row.

    The rows are settled in rounds (greedy.leaders). Equal texts are embedded once. Texts without words, and null ones, stay.
    """
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(body).alias("body"))
    said = own.where(F.col("body").rlike("[A-Za-z0-9]"))
    digests = said.select("id", F.unhex(F.md5("body")).alias("digest"))
    firsts = digests.groupBy("digest").agg(F.min("id").alias("first_id"))
    copies = staging.staged(graph.even_join(digests, firsts, "digest").select("id", "first_id"), "copies")

    def embedded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                data = greedy.packed(vectors.token_sums_of(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(data, pa.binary())], ["id", "data"])

    firsts = copies.where("id = first_id").select("id")
    told = said.join(firsts, "id", "left_semi").select("id", "body").mapInArrow(embedded, "id long, data binary")
    told = told.select("id", F.lit("").alias("grp"), F.col("id").alias("pos"), F.lit(vectors.DIM).alias("dim"), "data")
    found = greedy.leaders(told, threshold).select(F.col("id").alias("first_id"), F.col("leader").alias("kept_id"))
    of = graph.even_join(copies, found, "first_id").select("id", "kept_id")
    out = own.select("id").join(of, "id", "left")
    return out.select("id", F.coalesce("kept_id", "id").alias("kept_id")).withColumn("is_first", F.col("id") == F.col("kept_id"))


def merged(old: DataFrame, patch: DataFrame, as_of: Column) -> DataFrame:
    """Non-empty title, body, tags and metadata of the patch replace the old; importance and decay stay."""
    p = patch.select(F.col("id"), *[F.col(c).alias(f"p_{c}") for c in ("title", "body", "tags", "metadata") if c in patch.columns])
    out = old.join(p, "id")
    for c in ("title", "body", "tags", "metadata"):
        if f"p_{c}" in out.columns:
            filled = F.col(f"p_{c}").isNotNull() & ((F.size(f"p_{c}") > 0) if c in ("tags", "metadata") else (F.col(f"p_{c}") != ""))
            out = out.withColumn(c, F.when(filled, F.col(f"p_{c}")).otherwise(F.col(c))).drop(f"p_{c}")
    return out.withColumn("updated_at", as_of)


def delete_where(rows: DataFrame, scope=None, kind: str | None = None, metadata: dict | None = None) -> DataFrame:
    """What is left; a filter is required."""
    if not (scope or kind or metadata):
        raise ValueError("delete_where without a filter")
    return rows.join(search.filtered(rows, scope, kind, metadata=metadata).select("id"), "id", "left_anti")


def replaced(rows: DataFrame, ids: DataFrame, summary: DataFrame) -> DataFrame:
    """Rows without ids, and the summary: to be written as one commit."""
    return rows.join(ids.select("id"), "id", "left_anti").unionByName(summary, allowMissingColumns=True)


def fingerprint(title: Column, body: Column, dim: int) -> Column:
    return F.concat(F.md5(F.concat(title, F.lit("|"), body)), F.lit(f":{dim}"))


def stale_embeddings(rows: DataFrame, known: DataFrame, dim: int) -> DataFrame:
    """Rows whose text or dimension isn't that of the known fingerprint (id, fingerprint); updated_at isn't touched."""
    own = rows.withColumn("now", fingerprint(F.col("title"), F.col("body"), dim))
    return own.join(known, "id", "left").where(~F.col("now").eqNullSafe(F.col("fingerprint"))).drop("fingerprint")


def scope_counts(rows: DataFrame) -> DataFrame:
    """scope, n, total: the total is a window over the few aggregated rows."""
    counts = rows.groupBy("scope").agg(F.count("*").alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))


def kind_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind").agg(F.count("*").alias("n"))


def corpus_health(rows: DataFrame, long_chars: int) -> DataFrame:
    size = F.length("body")
    return rows.agg(
        F.count("*").alias("n"),
        F.avg(size).alias("avg_chars"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY length(body))").alias("p95_chars"),
        F.max(size).alias("max_chars"),
        F.sum(F.when(size > long_chars, 1).otherwise(0)).alias("n_long"),
        F.sum(F.when(F.col("embedding").isNull(), 1).otherwise(0)).alias("n_without_vector"),
    )


def session_scope(user: str, session: str) -> str:
    return f"user:{user}:session:{session}"


def captured_turns(turns: DataFrame, user: Column, session: Column) -> DataFrame:
    """Chat rows of user and assistant turns (role, text): scope, kind, title, body, tags, importance."""
    own = turns.where(F.col("role").isin("user", "assistant") & F.col("text").isNotNull() & (F.col("text") != ""))
    return own.withColumns(
        {
            "scope": F.concat(F.lit("user:"), user, F.lit(":session:"), session),
            "kind": F.lit("chat"),
            "title": F.concat(F.col("role"), F.lit(": "), text.clip(F.col("text"), 80)),
            "body": F.col("text"),
            "tags": F.array(F.lit("chat"), F.col("role")),
            "importance": F.lit(1.0),
        }
    )


def captured_decisions(decisions: DataFrame, user: Column) -> DataFrame:
    """Long-term rows of decisions (content, perhaps title): scope, kind, title, body, tags, importance."""
    own = decisions.where(F.trim(F.coalesce("content", F.lit(""))) != "")
    title = F.coalesce("title", text.clip(F.col("content"), 80)) if "title" in decisions.columns else text.clip(F.col("content"), 80)
    return own.select(F.concat(F.lit("user:"), user).alias("scope"), F.lit("decision").alias("kind"), title.alias("title"), F.col("content").alias("body"), F.array(F.lit("decision")).alias("tags"), F.lit(2.0).alias("importance"))


def tool_body(tool: Column, success: Column, args: Column, result: Column) -> Column:
    cut = lambda c: text.clip(F.coalesce(c, F.lit("")), 400)
    return F.concat(F.lit("tool: "), tool, F.lit("\nsuccess: "), success.cast("string"), F.lit("\nargs: "), cut(args), F.lit("\nresult: "), cut(result))
