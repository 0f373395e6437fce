"""Queries of single rules and of order-dependent ones, whose SQL is a recursion."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import paraphrase, scores, timewindow, vectors
from ..operators import codeindex, lifecycle
from ..sources import benchmarks
from . import knowledge
from .fixtures import AS_OF, memories, rounded, table
from .registry import SQL, query


def leaders_sql(rows: str, threshold: float) -> str:
    """A recursion r(scope, n, pivots, id, cluster_id) over v(scope, id, e, n): each row joins the first pivot that is near, else becomes one."""
    return f"""WITH RECURSIVE {rows},
r AS (SELECT scope, n, [{{'id': id, 'e': e}}] AS pivots, id, id AS cluster_id FROM v WHERE n = 1
 UNION ALL SELECT scope, n, CASE WHEN hit IS NULL THEN list_append(pivots, {{'id': id, 'e': e}}) ELSE pivots END, id, coalesce(hit, id)
 FROM (SELECT v.scope, v.n, v.id, v.e, r.pivots, list_filter(r.pivots, lambda p: list_cosine_similarity(p.e, v.e) >= {threshold})[1].id AS hit FROM r JOIN v ON v.scope = r.scope AND v.n = r.n + 1))"""


VECTORS = "v AS (SELECT CAST(label AS VARCHAR) AS scope, vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (PARTITION BY label ORDER BY {order}) AS n FROM embeddings WHERE {where})"
SQL["leader_clusters"] = leaders_sql(VECTORS.format(order="vec_id", where="true"), 0.3) + " SELECT scope, cluster_id, id, cluster_id = id AS is_pivot FROM r"

OUTCOME = leaders_sql(VECTORS.format(order="vec_id", where="vec_id % 10 <> 0"), 0.3) + """,
o AS (SELECT CAST(label AS VARCHAR) AS scope, vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 10 = 0),
best AS (SELECT v.id AS cluster_id, arg_max(o.id, list_cosine_similarity(v.e, o.e)) AS observation_id FROM v JOIN r ON r.id = v.id AND r.cluster_id = r.id JOIN o ON o.scope = v.scope WHERE list_cosine_similarity(v.e, o.e) >= 0.25 GROUP BY v.id),
c AS (SELECT scope, cluster_id, string_agg(id, ',' ORDER BY id) AS ids, string_agg('body ' || id, '|' ORDER BY id) AS quotes, 'body ' || first(id ORDER BY id % 12 DESC, id) AS body, round(avg(CAST(id % 12 AS DOUBLE) / 10), 6) AS importance, count(*) AS proof_count FROM r GROUP BY scope, cluster_id)"""
SQL["consolidation"] = OUTCOME + " SELECT c.*, CASE WHEN observation_id IS NULL THEN 'synthesised' ELSE 'reinforced' END AS action, observation_id FROM c LEFT JOIN best USING (cluster_id)"
SQL["reinforced_observations"] = OUTCOME + ", n AS (SELECT observation_id, sum(proof_count) AS n FROM c JOIN best USING (cluster_id) GROUP BY observation_id) SELECT id, scope, CAST(3 + coalesce(n, 0) AS BIGINT) AS proof_count, CAST(1 + coalesce(n, 0) AS BIGINT) AS n_evidence, 'strengthening' AS freshness_trend FROM o LEFT JOIN n ON observation_id = id"
SQL["digest_clusters"] = leaders_sql(VECTORS.format(order="vec_id % 12 DESC, vec_id % 50, vec_id", where="vec_id % 10 <> 0 AND vec_id % 12 < 3"), 0.3) + """,
m AS (SELECT l_partkey AS id, count(*) AS n_mistakes FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey),
c AS (SELECT scope, cluster_id, min(n) AS first, first(id ORDER BY id % 12 DESC, n) AS best_id, string_agg(id, ',' ORDER BY id) AS ids, CAST(sum(coalesce(n_mistakes, 0)) AS BIGINT) AS n_mistakes FROM r LEFT JOIN m USING (id) GROUP BY scope, cluster_id)
SELECT scope, cluster_id, row_number() OVER (PARTITION BY scope ORDER BY first) AS place, best_id, round(CAST(best_id % 12 AS DOUBLE) / 10, 6) AS importance, ids, n_mistakes FROM c"""
SQL["stream_debounced"] = """
WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS scope, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
r AS (SELECT scope, n, t AS last, true AS claimed FROM e WHERE n = 1
 UNION ALL SELECT e.scope, e.n, CASE WHEN e.t - r.last >= 21600000000 THEN e.t ELSE r.last END, e.t - r.last >= 21600000000 FROM r JOIN e ON e.scope = r.scope AND e.n = r.n + 1)
SELECT scope, last AS claimed_at FROM r WHERE claimed"""
SQL["sampled"] = "SELECT doc_id AS id, source AS scope FROM documents ORDER BY md5(doc_id || ':7'), doc_id LIMIT 50"

#: Title and module of a symbol, from its path and full name.
TITLED = "t AS (SELECT *, replace(regexp_replace(path, '\\.[a-z]+$', ''), '/', '.') AS module, replace(regexp_replace(path, '\\.[a-z]+$', ''), '/', '.') || '.' || regexp_replace(full_name, '^[^.:]+[.:]', '') AS title FROM y)"
SQL["code_outlines"] = f"WITH {knowledge.SYMBOLS}, {TITLED} SELECT path, string_agg(format('{{:5d}}  {{}}', line, title), chr(10) ORDER BY line, title) AS outline FROM t GROUP BY path"


@query(f"""WITH {knowledge.SYMBOLS}, {TITLED}
SELECT 'codeindex:parts' AS scope, 'symbol' AS kind, title, CASE WHEN docstring <> '' THEN docstring || ' — ' ELSE '' END || symbol_type || ' ' || title || CASE WHEN arity > 0 THEN '(' || arity || CASE WHEN vararg THEN '+' ELSE '' END || ' args)' ELSE '' END AS body, CASE WHEN exported THEN 1.5 ELSE 0.8 END AS importance,
 '{{"path":"' || path || '","line":"' || line || '","name":"' || regexp_replace(full_name, '^.*[.:]', '') || '","full_name":"' || full_name || '","symbol_type":"' || symbol_type || '","module":"' || module || '"}}' AS metadata FROM t
UNION ALL SELECT 'codeindex:parts', 'dependency', 'lib.f' || k || ' -> ' || i, path || ' requires ' || i, 0.2, '{{"from_path":"' || path || '","module":"' || i || '","line":"' || line || '"}}' FROM (
 SELECT k, 'lib/f' || k || '.lua' AS path, 'lib.f' || (CAST(k AS BIGINT) - CAST(k AS BIGINT) % 3) AS i, 2 AS line FROM k WHERE l = 0 UNION ALL SELECT k, 'lib/f' || k || '.py', unnest(['os', 'json']), 1 FROM k WHERE l = 1
 UNION ALL SELECT k, 'lib/f' || k || '.py', 'lib.f' || k, 2 FROM k WHERE l = 1 UNION ALL SELECT k, 'lib/f' || k || '.js', './f' || k, 1 FROM k WHERE l = 2)""")
def code_symbol_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol and dependency rows of an ingested tree."""
    rows = codeindex.rows_of(knowledge._sources(spark, sf_dir), "parts")
    return rows["symbols"].union(rows["dependencies"]).select("scope", "kind", "title", "body", "importance", F.to_json("metadata").alias("metadata"))


@query(f"SELECT module, '[' || leg || '] ' || module || ': ' || string_agg(DISTINCT name, ', ' ORDER BY name) AS text FROM ({SQL['explore_one_hop']}) GROUP BY module, leg")
def explore_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codeindex.explore_text(knowledge.explore_one_hop(spark, sf_dir))


#: Fewer and shorter tables than a search has, so that SQL can draw the same hyperplanes.
FEW_PLANES = vectors.hyperplanes(64, 2, 4, 20240301)


@query("""
WITH RECURSIVE g(i, s) AS (SELECT 0, CAST(20240301 AS BIGINT) UNION ALL SELECT i + 1, s * 16807 % 2147483647 FROM g WHERE i < 512),
u AS (SELECT i - 1 AS k, CAST(s AS DOUBLE) / 2147483647 AS x FROM g WHERE i > 0),
z AS (SELECT a.k + o AS k, sqrt(-2 * ln(a.x)) * CASE o WHEN 0 THEN cos(2 * pi() * b.x) ELSE sin(2 * pi() * b.x) END AS w FROM u a JOIN u b ON a.k % 2 = 0 AND b.k = a.k + 1, range(0, 2) t(o)),
p AS (SELECT k // 64 AS plane, list(w ORDER BY k) AS w FROM z GROUP BY k // 64),
b AS (SELECT vec_id, plane // 4 AS t, string_agg(CASE WHEN list_inner_product(CAST(embedding AS DOUBLE[]), w) >= 0 THEN '1' ELSE '0' END, '' ORDER BY plane) AS bits FROM embeddings, p GROUP BY vec_id, plane // 4)
SELECT vec_id AS id, string_agg(t || ':' || bits, ',' ORDER BY t) AS keys FROM b GROUP BY vec_id""")
def lsh_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bucket of each vector in each table of hyperplanes."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("id"), F.array_join(vectors.lsh_keys(F.col("embedding"), FEW_PLANES), ",").alias("keys"))


@query("""
WITH RECURSIVE g(i, s) AS (SELECT 0, CAST(20240301 AS BIGINT) UNION ALL SELECT i + 1, s * 16807 % 2147483647 FROM g WHERE i < 512),
u AS (SELECT i - 1 AS k, CAST(s AS DOUBLE) / 2147483647 AS x FROM g WHERE i > 0),
z AS (SELECT a.k + o AS k, sqrt(-2 * ln(a.x)) * CASE o WHEN 0 THEN cos(2 * pi() * b.x) ELSE sin(2 * pi() * b.x) END AS w FROM u a JOIN u b ON a.k % 2 = 0 AND b.k = a.k + 1, range(0, 2) t(o)),
p AS (SELECT k // 64 AS plane, list(w ORDER BY k) AS w FROM z GROUP BY k // 64),
b AS (SELECT vec_id, plane // 4 AS t, string_agg(CASE WHEN list_inner_product(CAST(embedding AS DOUBLE[]), w) >= 0 THEN '1' ELSE '0' END, '' ORDER BY plane) AS bits FROM embeddings, p GROUP BY vec_id, plane // 4),
c AS (SELECT DISTINCT x.vec_id AS query_id, y.vec_id AS id FROM b x JOIN b y ON x.t = y.t AND x.bits = y.bits AND x.vec_id <> y.vec_id WHERE x.vec_id % 20 = 0),
s AS (SELECT query_id, c.id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) AS similarity FROM c JOIN embeddings q ON q.vec_id = query_id JOIN embeddings r ON r.vec_id = c.id)
SELECT query_id, id, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY s.similarity DESC, id) AS rank FROM s QUALIFY rank <= 5""")
def lsh_bucket_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rows among those that share a bucket with a query; lsh_topk sends what this may miss to all rows."""
    from ..operators import search

    rows = table(spark, sf_dir, "embeddings").withColumn("keys", vectors.lsh_keys(F.col("embedding"), FEW_PLANES))
    found = search.lsh_top(rows.where("vec_id % 20 = 0"), rows, "vec_id", "embedding", "keys", 5)
    return found.select("query_id", "id", rounded("similarity").alias("similarity"), F.col("rank").cast("long").alias("rank"))


def _weights() -> tuple[dict, dict]:
    """A full and a low-rank projection whose numbers follow a rule."""
    full = [((7 * i + 3 * j) % 11 - 5) / 10 for i in range(64) for j in range(64)]
    return {"dim": 64, "m": full}, {"kind": "lowrank", "dim": 64, "rank": 2, "U": [((i + 2 * k) % 5 - 2) / 10 for i in range(64) for k in range(2)], "V": [((2 * j + k) % 7 - 3) / 10 for k in range(2) for j in range(64)]}


@query("""
WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
f AS (SELECT id, e, list_transform(range(0, 64), lambda i: list_sum(list_transform(range(0, 64), lambda j: CAST((7 * i + 3 * j) % 11 - 5 AS DOUBLE) / 10 * e[j + 1]))) AS y FROM v),
h AS (SELECT *, list_transform(range(0, 2), lambda k: list_sum(list_transform(range(0, 64), lambda j: CAST((2 * j + k) % 7 - 3 AS DOUBLE) / 10 * e[j + 1]))) AS c FROM f),
l AS (SELECT id, y, list_transform(range(0, 64), lambda i: e[i + 1] + CAST(i % 5 - 2 AS DOUBLE) / 10 * c[1] + CAST((i + 2) % 5 - 2 AS DOUBLE) / 10 * c[2]) AS z FROM h)
SELECT id, round(y[1] / sqrt(list_inner_product(y, y)), 6) AS full_first, round(list_sum(y) / sqrt(list_inner_product(y, y)), 6) AS full_sum, round(z[1] / sqrt(list_inner_product(z, z)), 6) AS low_first, round(list_sum(z) / sqrt(list_inner_product(z, z)), 6) AS low_sum FROM l""")
def projected_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors under a full and under a low-rank projection."""
    full, low = _weights()
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), vectors.projected(F.col("embedding"), full).alias("y"), vectors.projected(F.col("embedding"), low).alias("z"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return rows.select("id", rounded(F.col("y")[0]).alias("full_first"), rounded(total("y")).alias("full_sum"), rounded(F.col("z")[0]).alias("low_first"), rounded(total("z")).alias("low_sum"))


@query("SELECT source AS scope, md5(first(text ORDER BY doc_id % 12 DESC, doc_id)) AS body_md5, round(avg(CAST(doc_id % 12 AS DOUBLE) / 10), 6) AS importance, count(*) AS proof_count FROM documents GROUP BY source")
def best_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The body of the most important row of each scope, the mean importance and the number of rows."""
    found = lifecycle.best_body(memories(spark, sf_dir).drop("embedding"), ["scope"])
    return found.select("scope", F.md5("body").alias("body_md5"), rounded("importance").alias("importance"), "proof_count")


@query("SELECT doc_id AS id, {} AS negates FROM documents".format(" OR ".join("contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{}')".format(x.replace("'", "''")) for x in scores.NEGATIONS)))
def negations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import text

    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), scores.negates(text.ascii_lower(F.col("text"))).alias("negates"))


@query("""
WITH e AS (SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN date_trunc('year', ts) - to_years(CAST(event_id % 7 AS INT)) WHEN 1 THEN date_trunc('month', ts) END AS a, CASE event_id % 5 WHEN 0 THEN INTERVAL 1 YEAR ELSE INTERVAL 1 MONTH END AS n, event_id % 5 AS kind, event_id % 28 + 2 AS d FROM events)
SELECT id, CASE WHEN kind < 2 THEN epoch(a) + (epoch(a + n) - epoch(a)) / 2 - 1 WHEN kind = 2 THEN epoch(TIMESTAMP '2024-03-01') - d * 43200.0 WHEN kind = 3 THEN epoch(TIMESTAMP '2024-02-29 12:00:00') END AS centre,
 CASE WHEN kind < 2 THEN (epoch(a + n) - epoch(a)) / 2 - 1 WHEN kind = 2 THEN d * 43200.0 WHEN kind = 3 THEN 43200.0 END AS half FROM e""")
def date_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of time that phrases made of the events name, as of the fixtures' date."""
    i, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    said = F.when(i % 5 == 0, F.concat(F.lit("what happened in "), (F.year(ts) - i % 7).cast("string"))).when(i % 5 == 1, F.concat(F.lit("Notes written in "), F.date_format(ts, "MMMM"), F.lit("?")))
    said = said.when(i % 5 == 2, F.concat(F.lit("the last "), (i % 28 + 2).cast("string"), F.lit(" days"))).when(i % 5 == 3, F.lit("What did I do yesterday")).otherwise(F.lit("nothing of time"))
    found = table(spark, sf_dir, "events").select(i.alias("id"), timewindow.windows_of(said, datetime.fromisoformat(AS_OF)).alias("w"))
    return found.select("id", "w.centre", "w.half")


@query("SELECT event_id AS id, CAST(CASE event_id % 4 WHEN 3 THEN epoch(date_trunc('day', ts)) ELSE epoch(date_trunc('minute', ts)) END AS BIGINT) AS at FROM events")
def dataset_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as benchmarks write them, read back."""
    i, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    said = F.when(i % 4 == 0, F.date_format(ts, "yyyy/MM/dd (E) HH:mm")).when(i % 4 == 1, F.date_format(ts, "h:mm a 'on' d MMMM, yyyy")).when(i % 4 == 2, F.date_format(ts, "yyyy-MM-dd HH:mm:00")).otherwise(F.date_format(ts, "yyyy-MM-dd"))
    return table(spark, sf_dir, "events").select(i.alias("id"), F.unix_seconds(benchmarks.parsed_date(said)).alias("at"))


SYNONYM_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in paraphrase.SYNONYMS.items()) + "}"
MOVES = ", ".join(f"{{'n': CASE WHEN regexp_matches(b, '{p}') THEN length(regexp_extract(b, '{p}', 1)) ELSE -1 END, 'a': regexp_extract(b, '{p}', 1), 'z': regexp_extract(b, '{p}', 2)}}" for x in paraphrase.PREPOSITIONS for w in (x, x.capitalize()) for p in [rf"(?s)\A(.*?)\s+({w}\s+[A-Za-z0-9\s,''\"]+)\z"])


@query(rf"""WITH d AS (SELECT doc_id AS id, coalesce(text, '') AS t, regexp_extract(coalesce(text, ''), '[.?!]\z') AS p FROM documents), e AS (SELECT *, left(t, length(t) - length(p)) AS b FROM d),
k AS (SELECT *, list_transform(regexp_extract_all(t, '[A-Za-z0-9'']+\s*[[:punct:]]?\s*'), lambda x: {{'w': regexp_extract(x, '^[A-Za-z0-9'']+'), 'r': regexp_replace(x, '^[A-Za-z0-9'']+', '')}}) AS k, list_sort([{MOVES}], 'DESC')[1] AS m FROM e),
s AS (SELECT *, list_transform(k, lambda x: {{'w': x.w, 'r': x.r, 'o': {SYNONYM_MAP}[lower(x.w)]}}) AS s FROM k)
SELECT id, md5(CASE WHEN len(list_filter(s, lambda x: x.o IS NOT NULL)) > 0 THEN array_to_string(list_transform(s, lambda x: CASE WHEN x.o IS NULL THEN x.w WHEN regexp_matches(x.w, '^[A-Z]') THEN upper(x.o[1]) || x.o[2:] ELSE x.o END || x.r), '') ELSE 'Specifically, ' || t END) AS swapped_md5,
 md5(CASE WHEN m.n >= 0 THEN upper(m.z[1]) || m.z[2:] || ', ' || translate(m.a[1], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || m.a[2:] || p ELSE 'Regarding the topic, ' || t END) AS moved_md5,
 md5(CASE WHEN len(list_filter(k, lambda x: list_contains({paraphrase.DROPPED}, lower(x.w)))) > 0 THEN regexp_replace(regexp_replace(array_to_string(list_transform(k, lambda x: CASE WHEN list_contains({paraphrase.DROPPED}, lower(x.w)) THEN '' ELSE x.w END || x.r), ''), '\s+', ' ', 'g'), '\A | \z', '', 'g') ELSE 'Note: ' || t END) AS dropped_md5 FROM s""")
def paraphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rule of paraphrasing on every text."""
    said = F.coalesce(F.col("text"), F.lit(""))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), *[F.md5(f(said)).alias(f"{f.__name__}_md5") for f in paraphrase.RULES])
