"""Queries of reports, reranking around a pool, and companions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scores
from ..operators import kg, reports, search, sensing
from .fixtures import CANDIDATES, FACTS, MEMORIES, TERMS, as_of, day, facts, memories, query_vector, rounded, table, turns
from .learning import preferences  # noqa: F401  (its SQL is used below)
from .registry import SQL, query


@query(f"""WITH {MEMORIES}
SELECT scope, 'important' AS section, row_number() OVER (PARTITION BY scope ORDER BY weight DESC, id) AS place, id, title FROM w QUALIFY place <= 5
UNION ALL SELECT scope, 'recent', row_number() OVER (PARTITION BY scope ORDER BY created_at DESC, id DESC) AS place, id, title FROM w QUALIFY place <= 5""")
def brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.brief(memories(spark, sf_dir).drop("embedding", "body"), as_of()).withColumn("place", F.col("place").cast("long"))


@query(f"WITH {MEMORIES} SELECT unnest(['n_long', 'n_without_vector', 'blank_titles', 'importance_out_of_range']) AS \"check\", CAST(unnest([sum(CASE WHEN length(body) > 6000 THEN 1 ELSE 0 END), sum(CASE WHEN e IS NULL THEN 1 ELSE 0 END), sum(CASE WHEN trim(title) = '' THEN 1 ELSE 0 END), 0]) AS BIGINT) AS value FROM m")
def doctor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.doctor(memories(spark, sf_dir), 6000)


@query(f"""WITH {FACTS}, c AS (SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS scope, o_orderpriority || ': ' || o_orderstatus || ' ' || o_orderkey AS line,
 CAST(o_orderkey % 12 AS DOUBLE) / 10 * exp(-((o_orderkey % 5) * CAST(0.02 AS DOUBLE)) * (epoch(TIMESTAMP '2024-03-01') - epoch(TIMESTAMP '2024-01-01' + to_days(CAST(o_orderkey % 60 AS INTEGER)))) / 86400) AS weight FROM orders),
l AS (SELECT subject AS scope, 0 AS part, CAST(0 AS DOUBLE) AS weight, id, subject || ' ' || predicate || ' ' || object AS line FROM k WHERE valid_until IS NULL AND valid_from <= TIMESTAMP '2024-03-01' UNION ALL SELECT scope, 1, weight, id, line FROM c),
t AS (SELECT *, CAST(ceil(length(line) / CAST(4 AS DOUBLE)) AS BIGINT) AS t FROM l),
s AS (SELECT *, sum(t) OVER (PARTITION BY scope ORDER BY part, weight DESC, id ROWS UNBOUNDED PRECEDING) AS r FROM t)
SELECT scope, CAST(sum(t) AS BIGINT) AS tokens, count(*) AS n, md5(string_agg(line, chr(10) ORDER BY part, weight DESC, id)) AS lines FROM s WHERE r <= 30 GROUP BY scope""")
def context_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders, by customer, with differing weights and a budget that ends among them."""
    o, scope = F.col("o_orderkey"), F.col("o_custkey").cast("string").alias("scope")
    rows = table(spark, sf_dir, "orders").select(o.alias("id"), scope, F.col("o_orderpriority").alias("title"), F.concat("o_orderstatus", F.lit(" "), o.cast("string")).alias("body"), (o % 12 / F.lit(10.0)).alias("importance"), (o % 5 * F.lit(0.02)).alias("decay_rate"), day("2024-01-01", o % 60).alias("updated_at"))
    known = kg.superseded(facts(spark, sf_dir).withColumn("scope", F.col("subject")))
    return reports.context(rows, known, as_of(), 30).withColumn("lines", F.md5("lines"))


@query(f"""WITH {MEMORIES}, f AS (SELECT * FROM w), {CANDIDATES},
h AS (SELECT id, row_number() OVER (ORDER BY (CAST(0.7 AS DOUBLE) * vec_n + CAST(0.3 AS DOUBLE) * fts_n) * weight DESC, id) AS r, title, body FROM n),
p AS (SELECT id, len(list_intersect(list_distinct(regexp_extract_all(translate(title || ' ' || body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9_]{{2,}}')), ['theon', 'ander', 'onthe', 'anded', 'thent'])) AS s FROM h WHERE r <= 20),
o AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS place FROM p UNION ALL SELECT id, r AS place FROM h WHERE r > 20)
SELECT id, place FROM o""")
def rerank_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 reranked by overlap, the rest behind them in their own order."""
    pool = search.candidates(memories(spark, sf_dir), query_vector(spark, sf_dir), TERMS, 10, as_of())
    pool = search.ranked(pool, "score")
    first, rest = pool.where("rank <= 20"), pool.where("rank > 20").drop("rank")
    placed = search.with_overflow(search.rerank_noop(first, "Theon Ander onthe anded thent").drop("rank"), rest)
    from pyspark.sql import Window

    return placed.select("id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("place")).cast("long").alias("place"))  # a bounded pool


@query(f"""WITH {MEMORIES}, q AS (SELECT CAST(embedding AS DOUBLE[]) AS qe FROM embeddings WHERE vec_id = 0), s AS (SELECT id, coalesce(list_cosine_similarity(e, qe), 0) AS c, e IS NOT NULL AS has FROM m, q),
a AS (SELECT id, c, row_number() OVER (ORDER BY c DESC, id) AS slot FROM s QUALIFY slot <= 10), b AS (SELECT id, c, row_number() OVER (ORDER BY c DESC, id) AS n FROM s WHERE has AND id % 2 = 1 QUALIFY n <= 3)
SELECT id, round(c, 6) AS score, slot, 'memory' AS leg FROM a UNION ALL SELECT id, round(c, 6), 10 + n, 'observation' FROM b""")
def observation_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import vectors

    scored = memories(spark, sf_dir).select("id", vectors.cosine(F.col("embedding"), vectors.vector(query_vector(spark, sf_dir))).alias("score"), F.col("embedding").isNotNull().alias("has"))
    top = search.ranked(scored.orderBy(F.col("score").desc(), "id").limit(10), "score")
    out = reports.with_slots(top, scored.where("has and id % 2 = 1"))
    return out.select("id", rounded("score").alias("score"), F.col("slot").cast("long").alias("slot"), "leg")


def _companions(rows: DataFrame) -> DataFrame:
    found = sensing.companions(rows.select("id", "scope", F.col("text").alias("body"), F.create_map().cast("map<string,string>").alias("metadata")))
    return found.select("scope", "kind", "title", F.col("metadata")["source_id"].alias("source_id"))


@query(f"SELECT CAST(user_id AS VARCHAR) AS scope, 'fact' AS kind, preference AS title, CAST(id AS VARCHAR) AS source_id FROM ({SQL['preferences']}) JOIN events ON id = event_id")
def preference_companions_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _companions(turns(spark, sf_dir))


@query("SELECT 'diary:u' || user_id AS scope, 'diary' AS kind, CASE WHEN length(props) > 80 THEN substr(props, 1, 80) || '…' ELSE props END AS title, event_id FROM events")
def diary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.withColumns(reports.diary_row(F.concat(F.lit("u"), F.col("user_id").cast("string")), F.col("props"))).select("scope", "kind", "title", "event_id")


@query("SELECT source, lang, CAST(grouping_id(source, lang) AS BIGINT) AS level, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (source, lang)")
def scope_kind_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").rollup("source", "lang").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT user_id, event_type, count(*) AS n, CASE WHEN max(value) >= 95 THEN 3 WHEN max(value) >= 50 THEN 2 ELSE 1 END AS tier, round(greatest(0, 1 - 1 / (1 + CAST(0.4 AS DOUBLE) * count(*))), 6) AS escalated FROM events GROUP BY user_id, event_type")
def escalation_by_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("value").alias("m"))
    tier = F.when(F.col("m") >= 95, 3).when(F.col("m") >= 50, 2).otherwise(1)
    return rows.select("user_id", "event_type", "n", tier.alias("tier"), rounded(scores.escalated(F.lit(0.0), F.col("n"))).alias("escalated"))
