"""Engine tables derived from the driver's, as DataFrames and as common table expressions of the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import scores

#: The time at which everything that depends on time is asked.
AS_OF = "2024-03-01 00:00:00"
#: Two frequent words of the documents, for lexical legs.
TERMS = ["the", "of"]


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(c: Column | str) -> Column:
    return F.unix_seconds(F.col(c) if isinstance(c, str) else c)


def day(first: str, n: Column) -> Column:
    return F.timestamp_seconds(F.unix_seconds(F.lit(f"{first} 00:00:00").cast("timestamp")) + n * 86400)


def rounded(c: Column | str, places: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, places)


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, emb = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    i = F.col("doc_id")
    own = docs.select(
        i.alias("id"), F.col("source").alias("scope"), F.col("lang").alias("kind"), F.substring("text", 1, 60).alias("title"), F.col("text").alias("body"),
        ((i % 12) / F.lit(10.0)).alias("importance"), ((i % 5) * F.lit(0.02)).alias("decay_rate"), day("2024-01-01", i % 60).alias("updated_at"), day("2023-12-01", i % 45).alias("created_at"),
        F.create_map(F.lit("lang"), F.col("lang"), F.lit("part"), (i % 7).cast("string")).alias("metadata"),
    )
    own = own.withColumn("tier", scores.tier_of(F.col("importance")))
    return own.join(emb, F.col("id") == F.col("vec_id"), "left").drop("vec_id")


MEMORIES = f"""
m AS (SELECT doc_id AS id, source AS scope, lang AS kind, substr(text, 1, 60) AS title, text AS body, CAST(embedding AS DOUBLE[]) AS e, CAST(doc_id % 12 AS DOUBLE) / 10 AS importance,
 (doc_id % 5) * CAST(0.02 AS DOUBLE) AS decay_rate, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 60 AS INTEGER)) AS updated_at, TIMESTAMP '2023-12-01' + to_days(CAST(doc_id % 45 AS INTEGER)) AS created_at,
 CASE WHEN CAST(doc_id % 12 AS DOUBLE) / 10 < 0.3 THEN 0 WHEN CAST(doc_id % 12 AS DOUBLE) / 10 < 0.6 THEN 1 WHEN CAST(doc_id % 12 AS DOUBLE) / 10 < 0.85 THEN 2 ELSE 3 END AS tier,
 CAST(doc_id % 7 AS VARCHAR) AS part, TIMESTAMP '{AS_OF}' AS as_of
 FROM documents LEFT JOIN embeddings ON doc_id = vec_id),
w AS (SELECT *, importance * exp(-decay_rate * greatest(0, epoch(as_of) - epoch(updated_at)) / 86400) AS weight FROM m)"""

#: Words of a text, as the engine takes them.
WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')"

#: Candidates of a hybrid search from m: all ids, both legs, normalised scores; s is the filtered table.
CANDIDATES = f"""
q AS (SELECT CAST(embedding AS DOUBLE[]) AS qe FROM embeddings WHERE vec_id = 0),
t AS (SELECT *, {WORDS.format("title || ' ' || body")} AS tokens FROM f),
s AS (SELECT t.*, coalesce(list_cosine_similarity(e, qe), 0) AS vec_score,
 CASE WHEN list_contains(tokens, 'the') AND list_contains(tokens, 'of') THEN round(ln(1 + len(list_filter(tokens, lambda x: x = 'the'))) + ln(1 + len(list_filter(tokens, lambda x: x = 'of'))), 12) ELSE 0 END AS fts_score FROM t, q),
ids AS (SELECT id FROM (SELECT id FROM s ORDER BY e IS NOT NULL DESC, vec_score DESC, id LIMIT 50) UNION SELECT id FROM (SELECT id FROM s WHERE fts_score > 0 ORDER BY fts_score DESC, id LIMIT 50)),
c AS (SELECT s.* FROM s SEMI JOIN ids USING (id)),
n AS (SELECT *, CASE WHEN max(vec_score) OVER () > 0 THEN vec_score / max(vec_score) OVER () ELSE 0 END AS vec_n, CASE WHEN max(fts_score) OVER () > 0 THEN fts_score / max(fts_score) OVER () ELSE 0 END AS fts_n FROM c)"""


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """One vector, as a constant of a plan."""
    return [float(x) for x in table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]]


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("id"), F.lit("orders").alias("scope"), F.col("o_custkey").cast("string").alias("subject"), F.lit("status").alias("predicate"), F.col("o_orderstatus").alias("object"), F.col("o_orderdate").cast("timestamp").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_until"))


FACTS = """
f AS (SELECT o_orderkey AS id, 'orders' AS scope, CAST(o_custkey AS VARCHAR) AS subject, 'status' AS predicate, o_orderstatus AS object, o_orderdate AS valid_from FROM orders),
k AS (SELECT *, lead(valid_from) OVER (PARTITION BY scope, subject, predicate ORDER BY valid_from, id) AS valid_until FROM f)"""


def retrievals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), table(spark, sf_dir, "orders")
    shown = lines.repartition("l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("candidate_ids"))
    return shown.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("id"), F.lit("shop").alias("scope"), F.col("l_orderkey").cast("string").alias("query"), "candidate_ids", F.col("o_orderdate").cast("timestamp").alias("created_at"))


def reinforcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("R", "A"))
    kind = F.when(F.col("l_returnflag") == "R", "mistake").otherwise("praise")
    return lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("memory_id"), F.lit("shop").alias("scope"), kind.alias("event_type"), F.lit(0.5).alias("delta"), F.col("l_shipdate").cast("timestamp").alias("created_at"))


FEEDBACK = """
log AS (SELECT l_orderkey AS id, 'shop' AS scope, CAST(l_orderkey AS VARCHAR) AS query, list_sort(list(DISTINCT l_partkey)) AS candidate_ids, any_value(o_orderdate) AS created_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey),
ev AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS memory_id, 'shop' AS scope, CASE l_returnflag WHEN 'R' THEN 'mistake' ELSE 'praise' END AS event_type, 0.5 AS delta, l_shipdate AS created_at FROM lineitem WHERE l_returnflag IN ('R', 'A'))"""

#: Sentences said by users, by kind of event.
SAID = {
    "error": "No, that's wrong. We don't do it this way, you should have asked.",
    "signup": "From now on always sort the results, and make sure to keep the order.",
    "purchase": "Yes, exactly. That's right, thank you.",
    "click": "I prefer tea over coffee. I really like long walks! I never skip breakfast.",
    "view": "The weather is fine today. I usually prefer trains, and I find maps useful",
}


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    said = F.lit(None).cast("string")
    for kind, sentence in SAID.items():
        said = F.when(F.col("event_type") == kind, sentence).otherwise(said)
    return events.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("scope"), F.when(F.col("event_id") % 4 == 3, "assistant").otherwise("user").alias("role"), said.alias("text"), F.col("ts").cast("timestamp").alias("created_at"))


TURNS = "t AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS scope, CASE WHEN event_id % 4 = 3 THEN 'assistant' ELSE 'user' END AS role, CASE event_type {} END AS text, ts AS created_at FROM events)".format(
    " ".join("WHEN '{}' THEN '{}'".format(k, v.replace("'", "''")) for k, v in SAID.items())
)
