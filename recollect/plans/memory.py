"""Queries of the store: scans, writes, filters, counts and captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import staging
from ..functions import scores, text
from ..operators import health, search, store
from .fixtures import MEMORIES, as_of, day, memories, rounded, seconds, table
from .registry import query


@query(f"WITH {MEMORIES} SELECT id, scope, kind, title, tier, epoch(updated_at)::BIGINT AS updated_at FROM m WHERE id = 42")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.get(memories(spark, sf_dir), 42).select("id", "scope", "kind", "title", "tier", seconds("updated_at").alias("updated_at"))


@query(f"WITH {MEMORIES} SELECT id, scope, kind, epoch(created_at)::BIGINT AS created_at FROM m WHERE scope = 'src3' ORDER BY m.created_at DESC, id DESC LIMIT 20 OFFSET 5")
def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.recent(memories(spark, sf_dir).drop("embedding"), "src3", offset=5).select("id", "scope", "kind", seconds("created_at").alias("created_at"))


@query(f"WITH {MEMORIES} SELECT id, kind, title FROM m WHERE scope = 'src2' AND kind <> 'summary' ORDER BY created_at, id LIMIT 200")
def list_by_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.list_by_scope(memories(spark, sf_dir), "src2").select("id", "kind", "title")


@query(f"WITH {MEMORIES} SELECT id, scope, kind, tier FROM m WHERE part = '4' AND kind = 'fr' AND tier BETWEEN 0 AND 2")
def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.filtered(memories(spark, sf_dir), kind="fr", tier_min=-3, tier_max=2.9, metadata={"part": 4, "lang": "fr"}).select("id", "scope", "kind", "tier")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, event_type FROM events WHERE json_extract_string(props, '$.k') = '7'")
def json_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), "event_type").where("k = '7'")


@query("SELECT source AS scope, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM documents GROUP BY source")
def scope_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.scope_counts(table(spark, sf_dir, "documents").withColumnRenamed("source", "scope"))


@query("SELECT event_type AS kind, count(*) AS n FROM events GROUP BY event_type")
def kind_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.kind_counts(table(spark, sf_dir, "events").withColumnRenamed("event_type", "kind"))


@query(f"WITH {MEMORIES} SELECT count(*) AS n, round(avg(length(body)), 6) AS avg_chars, CAST(quantile_disc(length(body), 0.95) AS INTEGER) AS p95_chars, CAST(max(length(body)) AS INTEGER) AS max_chars, CAST(sum(CASE WHEN length(body) > 6000 THEN 1 ELSE 0 END) AS BIGINT) AS n_long, CAST(sum(CASE WHEN e IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_without_vector FROM m")
def corpus_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.corpus_health(memories(spark, sf_dir), 6000).withColumn("avg_chars", rounded("avg_chars"))


@query("SELECT event_id AS id, CASE WHEN user_id % 10 = 0 THEN 'title required' WHEN value > 200 THEN 'importance must be in [0, 10]' END AS error, CASE WHEN least(value, 200) / 20 < 0.3 THEN 0 WHEN least(value, 200) / 20 < 0.6 THEN 1 WHEN least(value, 200) / 20 < 0.85 THEN 2 ELSE 3 END AS tier FROM events")
def validated_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.lit("s").alias("scope"), F.when(F.col("user_id") % 10 == 0, " ").otherwise(F.col("event_type")).alias("title"), F.lit("b").alias("body"), F.lit(None).cast("string").alias("kind"), (F.col("value") / 20).alias("importance"), F.lit(None).cast("double").alias("decay_rate"))
    return store.validated(rows).select("id", "error", "tier")


@query("""
WITH b AS (SELECT doc_id AS id, source AS scope, lang AS kind, text AS body FROM documents),
u AS (SELECT id, scope, kind, body || ' edited' AS body FROM b WHERE id % 3 = 0), d AS (SELECT id FROM b WHERE id % 7 = 0)
SELECT id, scope, kind, md5(coalesce(u.body, b.body)) AS body FROM b LEFT JOIN u USING (id, scope, kind) ANTI JOIN d USING (id)""")
def latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of inserts, updates and tombstones, read as the rows that hold."""
    base = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("scope"), F.col("lang").alias("kind"), F.col("text").alias("body"))
    log = store.versioned(base, 1).union(store.versioned(base.where("id % 3 = 0").withColumn("body", F.concat("body", F.lit(" edited"))), 2)).union(store.versioned(base.where("id % 7 = 0"), 3, "D"))
    return store.current(log).withColumn("body", F.md5("body"))


@query(f"WITH {MEMORIES} SELECT id, scope, kind FROM m WHERE NOT (scope = 'src4' AND kind = 'en' AND part = '2')")
def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.delete_where(memories(spark, sf_dir), "src4", "en", {"part": 2}).select("id", "scope", "kind")


@query(f"WITH {MEMORIES}, c AS (SELECT id FROM m WHERE scope = 'src1' AND tier = 0) SELECT id, scope, kind FROM m ANTI JOIN c USING (id) UNION ALL SELECT -1, 'src1', 'summary'")
def replace_with_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memories(spark, sf_dir).select("id", "scope", "kind", "tier")
    summary = spark.createDataFrame([(-1, "src1", "summary")], "id long, scope string, kind string")
    return store.replaced(rows, rows.where("scope = 'src1' and tier = 0"), summary).select("id", "scope", "kind")


@query(f"WITH {MEMORIES}, p AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'new title' ELSE '' END AS title FROM m WHERE id % 5 = 0) SELECT id, CASE WHEN p.title <> '' THEN p.title ELSE m.title END AS title, importance, epoch(as_of)::BIGINT AS updated_at FROM m JOIN p USING (id)")
def merged_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memories(spark, sf_dir).select("id", "title", "importance", "updated_at")
    patch = rows.where("id % 5 = 0").select("id", F.when(F.col("id") % 2 == 0, "new title").otherwise("").alias("title"))
    return store.merged(rows, patch, as_of()).select("id", "title", "importance", seconds("updated_at").alias("updated_at"))


@query(f"WITH {MEMORIES} SELECT id, md5(title || '|' || body) || ':384' AS now FROM m WHERE id % 4 = 1 OR id % 9 = 0")
def stale_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memories(spark, sf_dir).select("id", "title", "body")
    known = rows.where("id % 4 != 1").select("id", F.when(F.col("id") % 9 == 0, "old").otherwise(store.fingerprint(F.col("title"), F.col("body"), 384)).alias("fingerprint"))
    return store.stale_embeddings(rows, known, 384).select("id", "now")


@query("SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY md5(text)) AS kept_id, doc_id = min(doc_id) OVER (PARTITION BY md5(text)) AS is_first FROM documents")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("digest"))
    return store.first_of_equals(rows, ["digest"], "id").select("id", "kept_id", "is_first")


@query()
def near_duplicates_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates by the cosine of hash embeddings, the first row of a group wins; the tests hold them against a loop."""
    return store.first_of_near(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""
WITH v AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS scope, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT a.id, b.id AS match_id, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.scope = b.scope WHERE a.id % 20 = 0 AND b.id % 20 <> 0),
t AS (SELECT id, arg_max(match_id, (c, -match_id)) AS match_id, max(c) AS c FROM p GROUP BY id)
SELECT v.id, match_id, round(c, 6) AS similarity, CASE WHEN c >= 0.35 THEN 'merged' ELSE 'inserted' END AS action, coalesce(c >= 0.3, false) AS is_miss FROM v LEFT JOIN t USING (id) WHERE v.id % 20 = 0""")
def write_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("scope"), "embedding")
    return store.write_actions(rows.where("id % 20 = 0"), rows.where("id % 20 != 0"), 0.35, 0.3).withColumn("similarity", rounded("similarity"))


@query("""
SELECT conv_id, turn, 'user:u' || conv_id % 10 || ':session:' || conv_id AS scope, 'chat' AS kind, role || ': ' || CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '…' ELSE text END AS title, md5(text) AS body, 'chat,' || role AS tags
FROM conversations WHERE role IN ('user', 'assistant') AND text <> ''""")
def capture_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.captured_turns(table(spark, sf_dir, "conversations"), F.concat(F.lit("u"), (F.col("conv_id") % 10).cast("string")), F.col("conv_id").cast("string"))
    return rows.select("conv_id", "turn", "scope", "kind", "title", F.md5("body").alias("body"), F.array_join("tags", ",").alias("tags"))


@query("SELECT event_id, 'tool: ' || event_type || chr(10) || 'success: ' || CASE WHEN event_type <> 'error' THEN 'true' ELSE 'false' END || chr(10) || 'args: ' || props || chr(10) || 'result: ' AS body FROM events")
def capture_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", store.tool_body(F.col("event_type"), F.col("event_type") != "error", F.col("props"), F.lit(None).cast("string")).alias("body"))


@query(f"WITH {MEMORIES} SELECT id, tier, round(weight, 6) AS weight, ceil(length(body) / 4.0)::BIGINT AS tokens, CASE WHEN length(title) > 20 THEN substr(title, 1, 20) || '…' ELSE title END AS clipped FROM w")
def decay_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memories(spark, sf_dir).drop("embedding")
    weight = scores.decay_weight(F.col("importance"), F.col("decay_rate"), F.col("updated_at"), as_of())
    return rows.select("id", "tier", rounded(weight).alias("weight"), text.approx_tokens(F.col("body")).alias("tokens"), text.clip(F.col("title"), 20).alias("clipped"))


@query("SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.!?]\\s'), lambda s: trim(s, ' ' || chr(10) || chr(9))), lambda s: s <> '')) AS n FROM documents")
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.sentences(F.col("text"))).alias("n"))


@query(f"WITH {MEMORIES} SELECT id, CASE WHEN length(title) >= 8 THEN title ELSE substr(body, 1, greatest(8, least(200, CAST(floor(length(body) * CAST(0.6 AS DOUBLE)) AS INTEGER)))) END AS query FROM m")
def query_from_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import evaluation

    return memories(spark, sf_dir).select("id", evaluation.query_of(F.col("title"), F.col("body")).alias("query"))


@query()
def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampling operator: 50 rows by a seeded hash."""
    from ..operators import evaluation

    return evaluation.sample(memories(spark, sf_dir).select("id", "scope"), 50, 7)


@query(f"""WITH {MEMORIES} SELECT scope, count(*) AS n, round(avg(length(body)), 6) AS avg_chars, max(length(body)) AS max_chars, CAST(sum(CASE WHEN length(body) > 6000 THEN 1 ELSE 0 END) AS BIGINT) AS n_long, CAST(sum(CASE WHEN e IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_without_vector,
 count(*) FILTER (length(body) <= q) BETWEEN 0.94 * count(*) AND 0.96 * count(*) + 1 AS p95_holds, true AS ids_hold
FROM m JOIN (SELECT scope AS s, quantile_disc(length(body), 0.95) AS q FROM m GROUP BY scope) ON s = scope GROUP BY scope""")
def health_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health of each scope from summaries of two batches, and whether their sketches keep their stated errors."""
    rows = memories(spark, sf_dir)
    held = staging.staged(health.added(None, rows.where("id % 2 = 0"), 6000), "health")
    held = staging.staged(health.added(held, rows.where("id % 2 = 1"), 6000), "health")
    found = health.report(held, ["scope"])
    exact = rows.join(found.select("scope", "p95_chars"), "scope").groupBy("scope").agg(F.count("*").alias("all"), F.count_if(F.length("body") <= F.col("p95_chars")).alias("below"), F.count_distinct("id").alias("exact_ids"))
    p95 = F.col("below").between((0.95 - health.RANK_ERROR) * F.col("all"), (0.95 + health.RANK_ERROR) * F.col("all") + 1)
    ids = F.abs(F.col("n_ids") - F.col("exact_ids")) <= 1 + 4 * health.DISTINCT_ERROR * F.col("exact_ids")
    return found.join(exact, "scope").select("scope", "n", rounded("avg_chars").alias("avg_chars"), "max_chars", "n_long", "n_without_vector", p95.alias("p95_holds"), ids.alias("ids_hold"))
