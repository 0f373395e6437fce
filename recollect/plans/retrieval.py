"""Queries of search, ranking and vectors."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import staging
from ..functions import fts, scores, text, timewindow, vectors
from ..operators import blockmax, codes, evaluation, graph, lifecycle, search, tuning
from .fixtures import AS_OF, CANDIDATES, MEMORIES, TERMS, WORDS, as_of, day, memories, query_vector, rounded, seconds, table
from .registry import query

NOW = datetime.fromisoformat(AS_OF)


@query("SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS similarity FROM embeddings ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) DESC, vec_id LIMIT 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    return search.vector_top(rows, query_vector(spark, sf_dir), 10).select("id", rounded("similarity").alias("similarity"))


#: The ten nearest rows of each query.
NEAREST = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query_id, id, round(c, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) AS rank FROM s QUALIFY rank <= 10"""


@query(NEAREST)
def vector_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    found = search.batch_top(rows.where("vec_id % 20 = 0"), rows, "vec_id", "embedding", 10)
    return found.select("query_id", "id", rounded("similarity").alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query(NEAREST)
def vector_topk_coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vector_topk_batch from an index of 8-bit codes with error bounds: only rows whose bound may reach are read in full."""
    rows = table(spark, sf_dir, "embeddings")
    index = staging.staged(codes.index(rows, "vec_id", "embedding"), "codes")
    found = codes.top(rows.where("vec_id % 20 = 0"), rows, index, "vec_id", "embedding", 10)
    return found.select("query_id", "id", rounded("similarity").alias("similarity"), F.col("rank").cast("long").alias("rank"))


def _searched(rows: DataFrame) -> DataFrame:
    return rows.select("id", "scope", "kind", "tier", rounded("vec_score").alias("vec_score"), rounded("fts_score").alias("fts_score"), rounded("weight").alias("weight"), rounded("score").alias("score"))


SEARCHED = "SELECT id, scope, kind, tier, round(vec_score, 6) AS vec_score, round(fts_score, 6) AS fts_score, round(weight, 6) AS weight, round(({wv} * vec_n + {wf} * fts_n) * weight, 6) AS score FROM n ORDER BY ({wv} * vec_n + {wf} * fts_n) * weight DESC, id LIMIT {limit}"


def _search_sql(condition: str = "true", wv: float = 0.7, wf: float = 0.3, limit: int = 10) -> str:
    return f"WITH {MEMORIES}, f AS (SELECT * FROM w WHERE {condition}), {CANDIDATES} " + SEARCHED.format(wv=f"CAST({wv} AS DOUBLE)", wf=f"CAST({wf} AS DOUBLE)", limit=limit)


@query(_search_sql())
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(search.hybrid(memories(spark, sf_dir), query_vector(spark, sf_dir), TERMS, as_of()))


@query(_search_sql("scope IN ('src1', 'src3', 'src5') AND kind = 'en' AND tier BETWEEN 1 AND 3 AND updated_at >= TIMESTAMP '2024-01-05' AND updated_at < TIMESTAMP '2024-02-20' AND part = '3'"))
def hybrid_search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    time = lambda x: F.lit(x).cast("timestamp")
    rows = search.filtered(memories(spark, sf_dir), ["src1", "src3", "", "src5"], "en", time("2024-01-05"), time("2024-02-20"), 1, 7, {"part": 3})
    return _searched(search.hybrid(rows, query_vector(spark, sf_dir), TERMS, as_of()))


@query(_search_sql("scope IN ('src1', 'src2', 'src9')", limit=25))
def multi_scope_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.filtered(memories(spark, sf_dir), search.resolve_scopes("src1", "src2", "src1", "src9"))
    return _searched(search.hybrid(rows, query_vector(spark, sf_dir), TERMS, as_of(), limit=25))


@query(_search_sql(wv=0.3, wf=0.7))
def code_blend_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(search.hybrid(memories(spark, sf_dir), query_vector(spark, sf_dir), TERMS, as_of(), blend=search.CODE_BLEND))


WINDOW = timewindow.parse("what happened in january", NOW)


@query(f"""WITH {MEMORIES}, p AS (SELECT *, greatest(0, 1 - abs(epoch(created_at) - {WINDOW.centre}) / {WINDOW.half}) AS temporal FROM m WHERE epoch(created_at) BETWEEN {WINDOW.centre - 3 * WINDOW.half} AND {WINDOW.centre + 3 * WINDOW.half})
SELECT id, round(temporal, 6) AS temporal FROM p ORDER BY p.temporal DESC, id LIMIT 50""")
def temporal_leg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.temporal_leg(memories(spark, sf_dir).drop("embedding", "body"), WINDOW, 50).select("id", rounded("temporal").alias("temporal"))


@query(f"WITH {MEMORIES} SELECT id, round(1 + 0.2 * (greatest(0, 1 - abs(epoch(created_at) - {WINDOW.centre}) / {WINDOW.half}) - 0.5), 6) AS score FROM m")
def proximity_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memories(spark, sf_dir).select("id", "created_at", F.lit(1.0).alias("score"))
    return search.proximity_boosted(rows, WINDOW).select("id", rounded("score").alias("score"))


@query(f"""WITH {MEMORIES}, f AS (SELECT * FROM w), {CANDIDATES},
a AS (SELECT id, row_number() OVER (ORDER BY vec_score DESC, id) AS rank FROM n), b AS (SELECT id, row_number() OVER (ORDER BY fts_score DESC, id) AS rank FROM n), d AS (SELECT id, row_number() OVER (ORDER BY created_at DESC, id) AS rank FROM n)
SELECT id, round(sum(1.0 / (60 + CAST(rank AS DOUBLE))), 6) AS rrf_score FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM d) GROUP BY id""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = search.candidates(memories(spark, sf_dir), query_vector(spark, sf_dir), TERMS, 10, as_of()).select("id", "vec_score", "fts_score", "created_at")
    return search.rrf([search.ranked(pool, by) for by in ("vec_score", "fts_score", "created_at")]).select("id", rounded("rrf_score").alias("rrf_score"))


def _boost_sql(needles: list[str], by: float) -> str:
    found = " OR ".join(f"contains(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{n}')" for n in needles)
    return f"WITH {MEMORIES} SELECT id, round(importance * CASE WHEN {found} THEN {1 + by} ELSE 1 END, 6) AS score FROM m"


@query(_boost_sql(["theon", "ander"], 0.15))
def name_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memories(spark, sf_dir).select("id", "body", F.col("importance").alias("score"))
    return search.boosted(rows, search.names_in("What did Theon tell Ander about it?"), search.NAME_BOOST).select("id", rounded("score").alias("score"))


@query(_boost_sql(["of the", "de la"], 0.40))
def phrase_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memories(spark, sf_dir).select("id", "body", F.col("importance").alias("score"))
    return search.boosted(rows, search.phrases_in("who wrote \"of the\" or 'de la'"), search.PHRASE_BOOST).select("id", rounded("score").alias("score"))


@query(f"""WITH {MEMORIES}, s AS (SELECT id, len(list_intersect(list_distinct(regexp_extract_all(translate(title || ' ' || body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9_]{{2,}}')), ['the', 'theon', 'and', 'ander'])) AS n FROM m)
SELECT id, round(CASE WHEN max(n) OVER () > 0 THEN CAST(n AS DOUBLE) / max(n) OVER () ELSE 0 END, 6) AS rerank FROM s""")
def rerank_noop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memories(spark, sf_dir).select("id", "title", "body")
    return search.rerank_noop(rows, "The Theon and Ander").select("id", rounded("rerank").alias("rerank"))


#: Weights of a reranker, as a trainer would have left them.
RERANKER = {"bias": 0.1, "score": 0.8, "vec_score": 0.3, "fts_score": -0.2, "importance": 0.5, "tier": 0.25, "reuse": 0.4}


@query(f"""WITH {MEMORIES}, f AS (SELECT * FROM w), {CANDIDATES},
h AS (SELECT id, kind, (CAST(0.7 AS DOUBLE) * vec_n + CAST(0.3 AS DOUBLE) * fts_n) * weight AS score, vec_score, fts_score, importance, CAST(tier AS DOUBLE) AS tier, ln(1 + CAST(id % 5 AS DOUBLE)) AS reuse FROM n),
x AS (SELECT id, kind, {", ".join(f"CASE WHEN max({c}) OVER p > min({c}) OVER p THEN ({c} - min({c}) OVER p) / (max({c}) OVER p - min({c}) OVER p) ELSE 0 END AS f_{c}" for c in search.FEATURES)} FROM h WINDOW p AS (PARTITION BY kind))
SELECT id, kind, round({RERANKER["bias"]} + {" + ".join(f"({RERANKER[c]}) * f_{c}" for c in search.FEATURES)}, 6) AS rerank FROM x""")
def rerank_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = search.candidates(memories(spark, sf_dir), query_vector(spark, sf_dir), TERMS, 10, as_of()).withColumn("reuse_count", F.col("id") % 5)
    return search.rerank_learned(pool, ["kind"], RERANKER).select("id", "kind", rounded("rerank").alias("rerank"))


@query(f"""WITH {MEMORIES}, o AS (SELECT id, list_cosine_similarity(e, (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS s, CAST(id % 9 + 1 AS DOUBLE) AS p, (epoch(as_of) - epoch(updated_at)) / 86400 AS d FROM m WHERE e IS NOT NULL),
r AS (SELECT id, s * (1 + CAST(0.1 AS DOUBLE) * (greatest(0, least(1, CAST(0.5 AS DOUBLE) + ln(p) / 10)) - CAST(0.5 AS DOUBLE))) * CASE WHEN (d >= 7 OR p < 3) AND d >= 30 AND d >= 90 THEN CAST(0.85 AS DOUBLE) ELSE 1 END AS score FROM o)
SELECT id, round(score, 6) AS score FROM r WHERE r.score > 0 ORDER BY r.score DESC, id LIMIT 3""")
def observation_leg(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = memories(spark, sf_dir).where("embedding is not null").select("id", "embedding", (F.col("id") % 9 + 1).alias("proof_count"), "updated_at")
    own = own.withColumn("freshness_trend", scores.freshness(F.col("updated_at"), F.col("proof_count"), as_of()))
    return search.observations(own, query_vector(spark, sf_dir)).select("id", rounded("score").alias("score"))


@query("""
WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT id, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS norm, round(list_sum(list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y))))), 6) AS unit_sum FROM v""")
def vector_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    unit = vectors.normalized(F.col("embedding"))
    return rows.select(F.col("vec_id").alias("id"), rounded(vectors.norm(F.col("embedding"))).alias("norm"), rounded(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x)).alias("unit_sum"))


DJB2 = "list_reduce(list_transform(regexp_extract_all(hex({}), '..'), lambda b: CAST('0x' || b AS BIGINT)), lambda h, b: (h * 33 + b) % {}, CAST(5381 AS BIGINT))"


@query(f"""
WITH w AS (SELECT doc_id, unnest({WORDS.format("text")}) AS w FROM documents),
k AS (SELECT doc_id, 'w:' || w AS token FROM w WHERE length(w) >= 2 UNION ALL SELECT doc_id, 'g:' || substr(' ' || w || ' ', i, 3) FROM w, unnest(range(1, length(w) + 1)) g(i)),
c AS (SELECT doc_id, token, count(*) AS n FROM k GROUP BY ALL),
h AS (SELECT token, {DJB2.format("token", 2147483647)} % 384 AS bucket, CASE WHEN {DJB2.format("(token || '#sign')", 2147483647)} % 2 = 0 THEN 1 ELSE -1 END AS sign FROM (SELECT DISTINCT token FROM c))
SELECT doc_id, bucket, CAST(sum(n * sign) AS BIGINT) AS value FROM c JOIN h USING (token) GROUP BY doc_id, bucket HAVING sum(n * sign) <> 0""")
def hash_embed_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.sparse_embedding(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"SELECT doc_id, lpad(lower(to_hex({DJB2.format(r'''regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g')''', 4294967296)})), 8, '0') AS checksum FROM documents")
def source_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.source_checksum(F.col("text")).alias("checksum"))


#: Hyperplanes of the LSH queries.
PLANES = vectors.hyperplanes(64, 8, 12, 20240301)


@query(NEAREST)
def lsh_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest rows of the query set among all rows; how near they are at least is known from the buckets, where these hold enough near rows."""
    rows = table(spark, sf_dir, "embeddings").withColumn("keys", vectors.lsh_keys(F.col("embedding"), PLANES))
    sure = search.sure_cosine(*PLANES.shape[:2])
    found = search.lsh_top_whole(rows.where("vec_id % 20 = 0"), rows, "vec_id", "embedding", "keys", 10, sure)
    return found.select("query_id", "id", rounded("similarity").alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query("""
WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS scope, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.scope = b.scope AND a.id <> b.id AND list_cosine_similarity(a.e, b.e) >= 0.3),
r(a, b) AS (SELECT DISTINCT a, a FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT scope, m AS cluster_id, id FROM v JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) c ON v.id = c.a""")
def clusters_cc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("scope"), "embedding")
    return lifecycle.clusters(rows, 0.3)


@query()
def graph_components_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all customers and suppliers that a line links; the recursive SQL is too slow for these, the tests hold them against union-find."""
    orders, lines = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    edges = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select((F.col("o_custkey") * 2).alias("a"), (F.col("l_suppkey") * 2 + 1).alias("b"))
    return graph.components(edges)


@query()
def fts_cover_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memories(spark, sf_dir).select("id", fts.cover_density(F.col("title"), F.col("body"), "the onion of thing").alias("rank"))
    return rows.select("id", rounded("rank").alias("rank"))


@query()
def hash_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search by text alone: the hash embedder for rows and query, and stemmed terms with cover density."""
    said = "the onion of thing"
    rows = memories(spark, sf_dir).withColumn("embedding", vectors.hash_embedding(F.concat_ws(" ", "title", "body")))
    vector = [float(x) for x in vectors.hash_embed(said)]
    return _searched(search.hybrid(rows, vector, [], as_of(), rank=fts.cover_density(F.col("title"), F.col("body"), said)))


GOLD = """
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT a.vec_id AS query_id, a.label AS ql, b.vec_id AS id, b.label AS l, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) AS rank FROM s QUALIFY rank <= 20),
f AS (SELECT query_id, any_value(ql) AS label, min(rank) FILTER (ql = l) AS rank FROM k GROUP BY query_id)"""


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    found = search.batch_top(rows.where("vec_id % 20 = 0"), rows, "vec_id", "embedding", 20)
    label = rows.select("vec_id", "label")
    own = found.join(label.toDF("query_id", "label"), "query_id").join(label.toDF("id", "other"), "id")
    return own.groupBy("query_id", "label").agg(F.min(F.when(F.col("label") == F.col("other"), F.col("rank"))).alias("rank"))


METRICS = "count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END), 6) AS recall_3, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS recall_10, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, round(quantile_cont(rank, 0.5), 6) AS median_rank, CAST(sum(CASE WHEN rank IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS misses"


def _rounded_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    return df.select(*by, "n", *[rounded(c).alias(c) for c in ("recall_1", "recall_3", "recall_5", "recall_10", "mrr", "median_rank")], "misses")


@query(GOLD + f" SELECT {METRICS} FROM f")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_metrics(evaluation.metrics(_ranks(spark, sf_dir)), [])


@query(GOLD + f" SELECT label, {METRICS} FROM f GROUP BY label")
def recall_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_metrics(evaluation.metrics(_ranks(spark, sf_dir), by=["label"]), ["label"])


#: The best gold rank within ten of each query under each of eleven blends.
SWEPT = """
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT a.vec_id AS query_id, a.label AS ql, b.vec_id AS id, b.label AS l, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) AS r FROM s QUALIFY r <= 20),
x AS (SELECT i AS blend, query_id, id, ql = l AS gold, row_number() OVER (PARTITION BY i, query_id ORDER BY (10 - i) / CAST(10 AS DOUBLE) * c + i / CAST(10 AS DOUBLE) * CAST(id % 11 AS DOUBLE) / 10 DESC, id) AS rank FROM k, range(0, 11) g(i)),
f AS (SELECT blend, query_id, min(rank) FILTER (gold AND rank <= 10) AS rank FROM x GROUP BY blend, query_id)
"""


def _scored(rows: DataFrame) -> DataFrame:
    found = search.batch_top(rows.where("vec_id % 20 = 0"), rows, "vec_id", "embedding", 20)
    return found.select("query_id", "id", F.col("similarity").alias("vec_n"), ((F.col("id") % 11) / F.lit(10.0)).alias("fts_n"))


@query(SWEPT + f"SELECT blend, {METRICS} FROM f GROUP BY blend")
def blend_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eleven blends over one scored set of candidates."""
    rows = table(spark, sf_dir, "embeddings")
    scored = _scored(rows)
    blends = spark.range(0, 11, 1, 1).select(F.col("id").alias("blend"), ((10 - F.col("id")) / F.lit(10.0)).alias("wv"), (F.col("id") / F.lit(10.0)).alias("wf"))
    best = evaluation.blend_sweep(scored, blends, 10)
    label = rows.select("vec_id", "label")
    own = best.join(label.toDF("query_id", "label"), "query_id").join(label.toDF("id", "other"), "id")
    ranks = own.groupBy("blend", "query_id").agg(F.min(F.when(F.col("label") == F.col("other"), F.col("rank"))).alias("rank"))
    return _rounded_metrics(evaluation.metrics(ranks, by=["blend"]), ["blend"])


@query(SWEPT + "SELECT blend, count(*) AS n, count(rank) AS hits FROM f GROUP BY blend")
def blend_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the eleven blends, read from the curve of hits over all blends."""
    rows = table(spark, sf_dir, "embeddings")
    scored = staging.staged(_scored(rows), "scored")
    label = rows.select("vec_id", "label")
    same = scored.join(label.toDF("query_id", "label"), "query_id").join(label.toDF("id", "other"), "id").where("label = other")
    gold = scored.select("query_id").distinct().withColumn("id", F.lit(-1)).union(same.select("query_id", "id"))  # a query without a gold row counts too
    pieces = staging.staged(tuning.rank_pieces(scored, gold), "pieces")
    points = spark.range(0, 11, 1, 1).select(F.col("id").alias("blend"), (F.col("id") / F.lit(10.0)).alias("b"))
    on = F.when((F.col("b") == 0) | (F.col("b") == 1), (F.col("lo") == F.col("b")) & (F.col("hi") == F.col("b"))).otherwise((F.col("lo") < F.col("b")) & (F.col("b") <= F.col("hi")))
    n = pieces.agg(F.count_distinct("query_id").alias("n"))
    found = tuning.curve(pieces, 10).join(F.broadcast(points), on).crossJoin(F.broadcast(n))  # eleven rows, and one
    return found.select("blend", "n", F.col("hits").cast("long").alias("hits"))


#: Words of the documents that share the stems of STEMMED: these alone, so that SQL needs no stemmer.
STEMMED, FORMS = "tions thties", ("tion(s|es|ed|ing)?", "tht(i|is|ies|ied|iing)")
RANKS = f"""k AS (SELECT id, unnest(w) AS w, generate_subscripts(w, 1) AS pos FROM (SELECT id, {WORDS.format("title || ' ' || body")} AS w FROM m)),
g AS (SELECT id, pos, CASE WHEN regexp_full_match(w, '{FORMS[0]}') THEN 1 WHEN regexp_full_match(w, '{FORMS[1]}') THEN 2 END AS t FROM k),
l AS (SELECT *, lag(pos) OVER o AS last_pos, lag(t) OVER o AS last_t FROM g WHERE t IS NOT NULL WINDOW o AS (PARTITION BY id ORDER BY pos)),
ranks AS (SELECT id, sum(CAST(1 AS DOUBLE) / (pos - last_pos)) AS rank FROM l WHERE t <> last_t GROUP BY id)"""


def stemmed_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memories(spark, sf_dir).select("id", "title", "body")
    index = staging.staged(fts.postings(rows, "id", F.concat_ws(" ", "title", "body")), "postings")
    return fts.ranked(index, "id", STEMMED)


@query(f"WITH {MEMORIES}, {RANKS} SELECT id, round(rank, 6) AS fts_score FROM ranks")
def fts_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cover density of stems, from an index of positions."""
    return stemmed_ranks(spark, sf_dir).select("id", rounded("fts_score").alias("fts_score"))


@query(f"""WITH {MEMORIES}, {RANKS}, f AS (SELECT * FROM w), q AS (SELECT CAST(embedding AS DOUBLE[]) AS qe FROM embeddings WHERE vec_id = 0),
s AS (SELECT f.*, coalesce(list_cosine_similarity(e, qe), 0) AS vec_score, coalesce(rank, 0) AS fts_score FROM f LEFT JOIN ranks USING (id), q), ids AS {CANDIDATES.split("ids AS ")[1]} """ + SEARCHED.format(wv="CAST(0.7 AS DOUBLE)", wf="CAST(0.3 AS DOUBLE)", limit=10))
def stemmed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search whose lexical leg is read from an index of stems and positions."""
    return _searched(search.hybrid(memories(spark, sf_dir), query_vector(spark, sf_dir), [], as_of(), ranks=stemmed_ranks(spark, sf_dir)))


@query(f"WITH {MEMORIES}, {RANKS} SELECT id, round(rank, 6) AS fts_score FROM ranks ORDER BY ranks.rank DESC, id LIMIT 10")
def fts_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of greatest cover density, from an index whose blocks of rows have the most they can score."""
    rows = memories(spark, sf_dir).select("id", "title", "body")
    index = blockmax.build(rows, "id", F.concat_ws(" ", "title", "body"))
    return blockmax.top(index, "id", STEMMED, 10).select("id", rounded("fts_score").alias("fts_score"))
