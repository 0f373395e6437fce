"""Queries of lifecycle, feedback, learning and sensing, and of the streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import staging
from ..functions import scores, vectors
from ..operators import learning, lifecycle, models, search, sensing
from ..streaming import jobs
from .fixtures import FEEDBACK, MEMORIES, TURNS, as_of, day, memories, reinforcements, retrievals, rounded, seconds, table, turns
from .registry import query


@query(f"WITH {MEMORIES} SELECT id, scope, round(weight, 6) AS weight FROM w WHERE decay_rate > 0 AND importance > 0 AND w.weight < 0.1")
def decayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.decayed(memories(spark, sf_dir).drop("embedding", "body"), as_of(), 0.1).select("id", "scope", rounded("weight").alias("weight"))


@query(f"WITH {MEMORIES} SELECT id, scope, round(weight, 6) AS weight FROM w WHERE decay_rate > 0 AND importance > 0 AND w.weight < 0.5 ORDER BY updated_at, id LIMIT 500")
def find_decayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.find_decayed(memories(spark, sf_dir).drop("embedding", "body"), as_of(), 0.5).select("id", "scope", rounded("weight").alias("weight"))


@query(f"WITH {MEMORIES} SELECT id, CASE WHEN decay_rate > 0 AND importance > 0 AND weight < 0.1 THEN 0 ELSE round(importance, 6) END AS importance FROM w")
def expire_decayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memories(spark, sf_dir).drop("embedding", "body")
    return lifecycle.expired(rows, lifecycle.decayed(rows, as_of(), 0.1)).select("id", rounded("importance").alias("importance"))


BATCHED = f"""WITH {MEMORIES}, o AS (SELECT scope, id, title, body, row_number() OVER (PARTITION BY scope ORDER BY updated_at, id) - 1 AS n FROM w WHERE weight < 0.5 AND updated_at < as_of - INTERVAL 30 DAY AND kind <> 'summary')"""


@query(BATCHED + " SELECT scope, n // 20 AS batch, n % 20 AS position, id FROM o")
def summarization_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.summarization_batches(memories(spark, sf_dir).drop("embedding", "body"), as_of(), most=None)


@query(BATCHED + ", f AS (SELECT DISTINCT scope, n // 20 AS batch FROM o ORDER BY scope, batch LIMIT 5) SELECT scope, n // 20 AS batch, n % 20 AS position, id FROM o JOIN f ON o.scope = f.scope AND n // 20 = batch".replace("SELECT scope, n // 20 AS batch, n % 20", "SELECT o.scope, n // 20 AS batch, n % 20"))
def first_summarization_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.summarization_batches(memories(spark, sf_dir).drop("embedding", "body"), as_of())


@query(BATCHED + " SELECT scope, n // 20 AS batch, 'Summary: ' || substr(string_agg(title, ' | ' ORDER BY n) FILTER (title <> ''), 1, 200) AS title, md5(string_agg('- ' || body, chr(10) ORDER BY n) FILTER (body <> '')) AS body, count(*) AS source_count FROM o GROUP BY scope, n // 20")
def noop_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memories(spark, sf_dir).drop("embedding")
    batches = lifecycle.summarization_batches(rows, as_of(), most=None).join(rows.select("id", "title", "body"), "id")
    found = lifecycle.noop_summary(batches, ["scope", "batch"], ["position"])
    return found.select("scope", "batch", "title", F.md5("body").alias("body"), "source_count")


@query("""
WITH t AS (SELECT conv_id, turn, role || ': ' || CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '…' ELSE text END AS title, text AS body FROM conversations WHERE role IN ('user', 'assistant') AND text <> '')
SELECT conv_id, 'user:u:long_term' AS scope, 'summary' AS kind, '[promoted] Summary: ' || substr(string_agg(title, ' | ' ORDER BY turn), 1, 200) AS title, md5(string_agg('- ' || body, chr(10) ORDER BY turn)) AS body, count(*) AS source_count FROM t GROUP BY conv_id""")
def session_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import store

    rows = store.captured_turns(table(spark, sf_dir, "conversations"), F.lit("u"), F.col("conv_id").cast("string"))
    found = lifecycle.promoted(rows, F.lit("user:u:long_term"), lambda r: lifecycle.noop_summary(r, ["conv_id"], ["turn"]))
    return found.select("conv_id", "scope", "kind", "title", F.md5("body").alias("body"), "source_count")


@query(f"WITH {MEMORIES} SELECT id, CASE WHEN d < 7 AND p >= 3 THEN 'strengthening' WHEN d < 30 THEN 'stable' WHEN d < 90 THEN 'weakening' ELSE 'stale' END AS trend, round(1 + 0.1 * (greatest(0, least(1, 0.5 + ln(CAST(p AS DOUBLE)) / 10)) - 0.5), 6) AS boost FROM (SELECT id, id % 9 + 1 AS p, (epoch(as_of) - epoch(created_at)) / 86400 AS d FROM m)")
def freshness_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    proofs = F.col("id") % 9 + 1
    return memories(spark, sf_dir).select("id", scores.freshness(F.col("created_at"), proofs, as_of()).alias("trend"), rounded(scores.proof_boost(proofs)).alias("boost"))


@query(f"WITH {MEMORIES}, c AS (SELECT *, CASE WHEN id % 2 = 0 THEN updated_at END AS consolidated_at FROM m) SELECT id, tier FROM c WHERE NOT coalesce(tier = 0 AND consolidated_at < as_of - INTERVAL 7 DAY, false)")
def purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memories(spark, sf_dir).withColumn("consolidated_at", F.when(F.col("id") % 2 == 0, F.col("updated_at")))
    return lifecycle.purged(rows, as_of()).select("id", "tier")


PARTS = f"{FEEDBACK}, p AS (SELECT p_partkey AS id, CAST(p_partkey % 12 AS DOUBLE) / 10 AS importance FROM part)"
TIER = "CASE WHEN {0} < 0.3 THEN 0 WHEN {0} < 0.6 THEN 1 WHEN {0} < 0.85 THEN 2 ELSE 3 END"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 12 / F.lit(10.0)).alias("importance"))
    return rows.withColumn("tier", scores.tier_of(F.col("importance")))


@query(f"WITH {PARTS}, n AS (SELECT memory_id, count(*) AS c FROM ev WHERE event_type = 'mistake' GROUP BY memory_id), x AS (SELECT id, coalesce(c, 0) AS c, importance, greatest(importance, 1 - 1 / (1 + CAST(0.4 AS DOUBLE) * coalesce(c, 0))) AS new FROM p LEFT JOIN n ON id = memory_id) SELECT id, c AS n_mistakes, round(importance, 6) AS old_importance, round(new, 6) AS new_importance, {TIER.format('new')} AS new_tier FROM x")
def reinforcement_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lifecycle.escalation(_parts(spark, sf_dir), reinforcements(spark, sf_dir))
    return found.select("id", "n_mistakes", rounded("old_importance").alias("old_importance"), rounded("new_importance").alias("new_importance"), "new_tier")


def _promoted(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    evidence = lines.groupBy("l_suppkey").agg(F.collect_set("l_partkey").alias("evidence_ids"))
    own = table(spark, sf_dir, "supplier").join(evidence, F.col("s_suppkey") == F.col("l_suppkey")).select((F.col("s_suppkey") % 6).alias("proof_count"), F.when(F.col("s_suppkey") % 4 == 0, "stale").otherwise("stable").alias("freshness_trend"), "evidence_ids")
    return lifecycle.tier_promotions(_parts(spark, sf_dir), own, reinforcements(spark, sf_dir))


@query(f"""WITH {PARTS}, t AS (SELECT *, {TIER.format('importance')} AS tier FROM p),
o AS (SELECT s_suppkey AS id, s_suppkey % 6 AS proofs, s_suppkey % 4 = 0 AS stale FROM supplier), e AS (SELECT DISTINCT l_partkey AS id FROM lineitem JOIN o ON l_suppkey = o.id WHERE proofs >= 3 AND NOT stale),
n AS (SELECT memory_id FROM ev WHERE event_type IN ('mistake', 'direct_command') GROUP BY memory_id HAVING count(*) >= 5)
SELECT id, tier AS old_tier, 2 AS new_tier FROM t SEMI JOIN e USING (id) WHERE tier = 1 UNION ALL SELECT id, tier, 3 FROM t SEMI JOIN n ON id = memory_id WHERE tier = 2""")
def tier_promotion_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _promoted(spark, sf_dir, table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct())


@query(f"""WITH RECURSIVE {PARTS}, x AS (SELECT memory_id AS id, row_number() OVER (PARTITION BY memory_id ORDER BY created_at, ev.id) AS n, event_type FROM ev JOIN p ON p.id = memory_id),
f AS (SELECT id, importance AS c, CAST(0 AS BIGINT) AS n FROM p WHERE id IN (SELECT id FROM x) UNION ALL
 SELECT f.id, CASE WHEN event_type = 'praise' THEN greatest(c, least(1, c + (1 - c) * 0.5 * 0.5)) ELSE greatest(0, least(1, c - (c - 0.3) * 0.5 * 0.5)) END, x.n FROM f JOIN x ON f.id = x.id AND x.n = f.n + 1)
SELECT id, round(arg_max(c, n), 6) AS importance, max(n) AS n_events FROM f GROUP BY id""")
def event_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mistakes taken as reversals and praise as misses, applied in order."""
    events = reinforcements(spark, sf_dir).withColumn("event_type", F.when(F.col("event_type") == "mistake", "reversal").otherwise("miss"))
    return lifecycle.folded_events(_parts(spark, sf_dir), events).select("id", rounded("importance").alias("importance"), F.col("n_events").cast("long").alias("n_events"))


HARVEST = f"""WITH {FEEDBACK}, s AS (SELECT memory_id AS positive, max(struct_pack(weight := CASE event_type WHEN 'mistake' THEN CAST(3 AS DOUBLE) ELSE 2 END, signal := event_type)) AS best FROM ev GROUP BY memory_id),
x AS (SELECT id, query, created_at, candidate_ids, unnest(candidate_ids) AS positive FROM log), l AS (SELECT * FROM x SEMI JOIN s USING (positive) QUALIFY row_number() OVER (PARTITION BY positive ORDER BY created_at DESC, id DESC) <= 5),
h AS (SELECT query, positive, list_filter(candidate_ids, lambda c: c <> positive) AS negatives, best.weight AS weight, best.signal AS signal FROM l JOIN s USING (positive)), t AS (SELECT * FROM h WHERE len(negatives) > 0)"""


@query(HARVEST + " SELECT query, positive, array_to_string(negatives, ',') AS negatives, weight, signal FROM t")
def harvest_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = learning.harvest(reinforcements(spark, sf_dir), retrievals(spark, sf_dir))
    return found.select("query", "positive", F.array_join(F.col("negatives").cast("array<string>"), ",").alias("negatives"), "weight", "signal")


@query(HARVEST + " SELECT positive AS id, count(*) AS reuse_count FROM t GROUP BY positive")
def reuse_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.reuse_counts(learning.harvest(reinforcements(spark, sf_dir), retrievals(spark, sf_dir)))


@query(f"WITH {FEEDBACK}, v AS (SELECT id, CASE WHEN id % 7 = 0 THEN -memory_id ELSE memory_id END AS memory_id, event_type FROM ev), r AS (SELECT DISTINCT unnest(candidate_ids) AS memory_id FROM log) SELECT id, v.memory_id, CASE WHEN event_type = 'mistake' AND r.memory_id IS NULL THEN 'miss' ELSE event_type END AS final_type FROM v LEFT JOIN r ON v.memory_id = r.memory_id")
def miss_reclassify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh event is about a memory that was never shown."""
    events = reinforcements(spark, sf_dir).withColumn("memory_id", F.when(F.col("id") % 7 == 0, -F.col("memory_id")).otherwise(F.col("memory_id")))
    return learning.misses(events, retrievals(spark, sf_dir)).select("id", "memory_id", "final_type")


@query("SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) % 5 AS fold, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) % 3 = 0 AS is_gate FROM orders")
def kfold_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    order, by = ["o_orderdate", "o_orderkey"], ["o_custkey"]
    rows = learning.split(learning.folds(table(spark, sf_dir, "orders"), order, 5, by), order, by=by)
    return rows.select("o_custkey", "o_orderkey", F.col("fold").cast("long").alias("fold"), "is_gate")


#: Weights whose loss is gated.
GATED = {"score": 0.9, "vec_score": 0.2, "fts_score": 0.1, "importance": 0.3, "tier": -0.1, "reuse": 0.05, "bias": 0.0}


@query(f"SELECT round(avg(ln(1 + exp(-({' + '.join(f'({GATED[k]}) * (CAST((l_orderkey * {i + 3} % 11) AS DOUBLE) / 10 - CAST((l_partkey * {i + 5} % 13) AS DOUBLE) / 12)' for i, k in enumerate(search.FEATURES))})))), 6) AS loss, count(*) AS n FROM lineitem")
def gate_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, p = F.col("l_orderkey"), F.col("l_partkey")
    pairs = table(spark, sf_dir, "lineitem").select(*[(o * (i + 3) % 11 / F.lit(10.0)).alias(f"p_{k}") for i, k in enumerate(search.FEATURES)], *[(p * (i + 5) % 13 / F.lit(12.0)).alias(f"n_{k}") for i, k in enumerate(search.FEATURES)])
    return learning.gate_loss(pairs, GATED).select(rounded("loss").alias("loss"), "n")


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("scope")).agg(F.count("*").alias("n"))
    rows = rows.select("scope", F.lit("reranker").alias("kind"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("version"), "n")
    return rows.select("scope", "kind", "version", F.create_map(F.lit("score"), F.col("version").cast("double")).alias("weights"), (F.col("version") == F.col("n")).alias("is_current"))


@query("WITH n AS (SELECT CAST(o_custkey AS VARCHAR) AS scope, count(*) AS n FROM orders GROUP BY o_custkey) SELECT scope, 'reranker' AS kind, n + CASE WHEN CAST(scope AS BIGINT) % 2 = 0 THEN 1 ELSE 0 END AS version, CAST(CASE WHEN CAST(scope AS BIGINT) % 2 = 0 THEN 0.5 ELSE n END AS DOUBLE) AS score FROM n")
def registry_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = _registry(spark, sf_dir)
    new = registry.where("is_current and cast(scope as long) % 2 = 0").select("scope", "kind", F.create_map(F.lit("score"), F.lit(0.5)).alias("weights"))
    found = learning.current_weights(learning.registered(registry, new))
    return found.select("scope", "kind", F.col("version").cast("long").alias("version"), F.col("weights")["score"].alias("score"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS scope, CASE WHEN o_custkey = 7 AND count(*) > 1 THEN count(*) - 1 ELSE count(*) END AS version FROM orders GROUP BY o_custkey")
def registry_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = learning.current_weights(learning.rolled_back(_registry(spark, sf_dir), "7", "reranker"))
    return found.select("scope", F.col("version").cast("long").alias("version"))


def _confidence_sql(kind: str) -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches(x, '{_re2(p)}') THEN {c} END" for p, k, c in sensing.SIGNALS if k == kind)
    return f"greatest({cases})"


def _re2(p: str) -> str:
    return p.replace("(?<![a-z])", "(?:^|[^a-z])").replace("(?![a-z])", "(?:$|[^a-z])").replace("'", "''")


@query(f"""WITH {TURNS}, l AS (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM t WHERE role = 'user'),
s AS ({" UNION ALL ".join(f"SELECT id, '{k}' AS kind, '{e}' AS event_type, CAST({_confidence_sql(k)} AS DOUBLE) AS confidence FROM l" for k, e in sensing.EVENT_OF.items())}) SELECT * FROM s WHERE confidence IS NOT NULL""")
def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensing.signals(turns(spark, sf_dir)).select("id", "kind", "event_type", "confidence")


@query(f"""WITH {TURNS}, k AS (SELECT id, CASE event_type WHEN 'click' THEN ['User has mentioned: prefers tea over coffee', 'User has mentioned: likes long walks', 'User has mentioned: never skip breakfast'] WHEN 'view' THEN ['User has mentioned: preference for trains, and i find maps useful'] ELSE [] END AS p FROM t JOIN events ON id = event_id) SELECT id, unnest(p) AS preference FROM k""")
def preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensing.preferences(turns(spark, sf_dir), "id", "text")


@query(f"""WITH {TURNS}, l AS (SELECT DISTINCT scope, text FROM t JOIN events ON id = event_id WHERE role = 'user' AND event_type = 'purchase'), k AS (SELECT DISTINCT scope FROM t WHERE CAST(scope AS BIGINT) % 3 = 0)
SELECT scope, count(*) AS n FROM l ANTI JOIN k USING (scope) GROUP BY scope""")
def sensing_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Praise whose marker the notes of its scope don't have yet."""
    own = turns(spark, sf_dir)
    praise = sensing.signals(own).where("kind = 'praise'").select("scope", "kind", "text").distinct()
    noted = praise.where("cast(scope as long) % 3 = 0")
    notes = noted.select("scope", sensing.marker(F.concat_ws("|", "kind", "text")).alias("note"))
    return sensing.unseen(praise, notes).groupBy("scope").agg(F.count("*").alias("n"))


@query("SELECT a.doc_id AS id, len(list_intersect(list_distinct(regexp_extract_all(translate(a.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]{4,}')), regexp_extract_all(translate(b.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]{4,}'))) AS shared FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def grounding_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import text

    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    pairs = rows.join(rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other")), "doc_id")
    return pairs.select(F.col("doc_id").alias("id"), text.shared_words(F.col("text"), F.col("other")).cast("long").alias("shared"))


@query()
def leader_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-dependent greedy clusters."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("scope"), "embedding")
    return lifecycle.leader_clusters(rows, 0.3)


def _unconsolidated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("scope"), F.concat(F.lit("body "), F.col("vec_id").cast("string")).alias("body"), "embedding", (F.col("vec_id") % 12 / F.lit(10.0)).alias("importance"), F.lit(None).cast("timestamp").alias("consolidated_at"), as_of().alias("updated_at"), day("2024-01-01", F.col("vec_id") % 50).alias("created_at"))
    rows = rows.withColumn("tier", scores.tier_of(F.col("importance")))
    known = rows.where("id % 10 = 0").select("id", "scope", "embedding", F.lit(3).alias("proof_count"), F.array("id").alias("evidence_ids"), F.array("body").alias("evidence_quotes"), F.lit("stable").alias("freshness_trend"), as_of().alias("last_reinforced"))
    return rows.where("id % 10 != 0"), known


@query()
def consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, known = _unconsolidated(spark, sf_dir)
    found = lifecycle.consolidated(rows, known, as_of(), 0.3, 0.25)
    joined = lambda c, by: F.array_join(F.col(c).cast("array<string>"), by).alias(c)
    return found.select("scope", "cluster_id", joined("ids", ","), "action", "observation_id", "body", joined("quotes", "|"), rounded("importance").alias("importance"), "proof_count")


@query()
def reinforced_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, known = _unconsolidated(spark, sf_dir)
    found = lifecycle.reinforced(known, lifecycle.consolidated(rows, known, as_of(), 0.3, 0.25), as_of())
    return found.select("id", "scope", F.col("proof_count").cast("long").alias("proof_count"), F.size("evidence_ids").cast("long").alias("n_evidence"), "freshness_trend")


@query()
def digest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a digest leaves of the rows, with the stamps of those it consolidated."""
    rows, known = _unconsolidated(spark, sf_dir)
    parts = lifecycle.digested(rows, known, reinforcements(spark, sf_dir), as_of(), models.HashEmbedder(64), 1_000_000)
    return parts["rows"].select("id", "scope", "tier", seconds("consolidated_at").alias("consolidated_at"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return jobs.as_timestamps(stream).withColumn("scope", F.col("user_id").cast("string"))


@query("""
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS scope, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT scope, ts, sum(new) OVER (PARTITION BY scope ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e),
g AS (SELECT scope, min(ts) AS first, max(ts) + INTERVAL 6 HOUR AS idle_at, count(*) AS n_writes FROM s GROUP BY scope, k)
SELECT scope, floor(epoch(first))::BIGINT AS first, floor(epoch(idle_at))::BIGINT AS idle_at, n_writes FROM g WHERE g.idle_at <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_idle_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jobs.drained(spark, jobs.idle_scopes(_events(spark, sf_dir), idle=6 * 3600), staging.new_folder(spark, "idle"))
    return out.select("scope", seconds("first").alias("first"), seconds("idle_at").alias("idle_at"), "n_writes")


@query("SELECT epoch(date_trunc('hour', ts))::BIGINT AS since, event_type, count(*) AS n FROM events GROUP BY ALL HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR".replace("GROUP BY ALL", "GROUP BY date_trunc('hour', ts), event_type"))
def stream_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jobs.drained(spark, jobs.windowed_counts(_events(spark, sf_dir), "event_type"), staging.new_folder(spark, "counts"))
    return out.select(seconds("since").alias("since"), "event_type", "n")


@query()
def stream_debounced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of a digest, at most one in six hours a scope."""
    out = jobs.drained(spark, jobs.debounced(_events(spark, sf_dir).select("scope", "ts"), every=6 * 3600), staging.new_folder(spark, "claims"))
    return out.select("scope", F.unix_micros("claimed_at").alias("claimed_at"))
