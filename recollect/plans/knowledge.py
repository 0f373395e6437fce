"""Queries of the knowledge graph and the code index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text
from ..operators import codeindex, kg
from ..sources import diffs
from .fixtures import FACTS, facts, seconds, table
from .registry import query

AT = "1998-01-01 00:00:00"


def _at():
    return F.lit(AT).cast("timestamp")


def _shown(df: DataFrame) -> DataFrame:
    return df.select("id", "subject", "object", seconds("valid_from").alias("valid_from"), seconds("valid_until").alias("valid_until"))


SHOWN = "id, subject, object, epoch(valid_from)::BIGINT AS valid_from, epoch(valid_until)::BIGINT AS valid_until"


@query(f"WITH {FACTS} SELECT {SHOWN} FROM k")
def kg_supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(kg.superseded(facts(spark, sf_dir)))


@query(f"WITH {FACTS} SELECT {SHOWN} FROM k WHERE valid_until IS NULL")
def kg_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(kg.superseded(facts(spark, sf_dir)).where("valid_until is null"))


@query(f"WITH {FACTS} SELECT {SHOWN} FROM k WHERE valid_from <= TIMESTAMP '{AT}' AND (valid_until IS NULL OR valid_until > TIMESTAMP '{AT}')")
def kg_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(kg.current(kg.superseded(facts(spark, sf_dir)), _at()))


@query(f"WITH {FACTS} SELECT {SHOWN} FROM k WHERE subject = '7' AND predicate = 'status' AND valid_from <= TIMESTAMP '{AT}' AND (valid_until IS NULL OR valid_until > TIMESTAMP '{AT}') ORDER BY k.valid_from DESC, id DESC LIMIT 100")
def kg_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(kg.query(kg.superseded(facts(spark, sf_dir)), at=_at(), subject="7", predicate="status"))


@query(f"WITH {FACTS} SELECT {SHOWN} FROM k WHERE subject = '7'")
def kg_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(kg.timeline(kg.superseded(facts(spark, sf_dir)), subject="7"))


@query(f"WITH {FACTS} SELECT id, subject, object, epoch(valid_from)::BIGINT AS valid_from, epoch(CASE WHEN object = 'F' AND valid_until IS NULL THEN greatest(TIMESTAMP '2000-01-01', valid_from) ELSE valid_until END)::BIGINT AS valid_until, object = 'F' AND valid_until IS NULL AS closed FROM k")
def kg_invalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = kg.invalidated(kg.superseded(facts(spark, sf_dir)), F.lit("2000-01-01").cast("timestamp"), F.col("object") == "F")
    return own.select("id", "subject", "object", seconds("valid_from").alias("valid_from"), seconds("valid_until").alias("valid_until"), "closed")


@query(f"""WITH {FACTS}, n AS (SELECT c_custkey, 'VIP' AS object FROM customer WHERE c_custkey % 3 = 0),
j AS (SELECT k.*, n.c_custkey IS NOT NULL AND valid_until IS NULL AND valid_from <= TIMESTAMP '2000-06-01' AS hit FROM k LEFT JOIN n ON subject = CAST(c_custkey AS VARCHAR))
SELECT subject, object, epoch(valid_from)::BIGINT AS valid_from, epoch(CASE WHEN hit THEN TIMESTAMP '2000-06-01' ELSE valid_until END)::BIGINT AS valid_until FROM j
UNION ALL SELECT CAST(c_custkey AS VARCHAR), object, epoch(TIMESTAMP '2000-06-01')::BIGINT, NULL FROM n""")
def kg_assert(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.lit("orders").alias("scope"), F.col("c_custkey").cast("string").alias("subject"), F.lit("status").alias("predicate"), F.lit("VIP").alias("object"), F.lit("2000-06-01").cast("timestamp").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_until"))
    own = kg.asserted(kg.superseded(facts(spark, sf_dir)), new)
    return own.select("subject", "object", seconds("valid_from").alias("valid_from"), seconds("valid_until").alias("valid_until"))


@query(f"""WITH {FACTS}, e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS subject, TIMESTAMP '1995-01-01' + to_days(CAST(event_id % 2400 AS INTEGER)) AS moment FROM events),
j AS (SELECT event_id, arg_max(k, (valid_from, id)) AS k FROM e JOIN k ON e.subject = k.subject AND valid_from <= moment GROUP BY event_id)
SELECT e.event_id, CASE WHEN j.k.valid_until IS NULL OR j.k.valid_until > moment THEN j.k.id END AS fact_id, CASE WHEN j.k.valid_until IS NULL OR j.k.valid_until > moment THEN j.k.object END AS fact_object FROM e LEFT JOIN j USING (event_id)""")
def kg_as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.unix_seconds(F.lit("1995-01-01 00:00:00").cast("timestamp"))
    events = table(spark, sf_dir, "events").select("event_id", F.lit("orders").alias("scope"), F.col("user_id").cast("string").alias("subject"), F.lit("status").alias("predicate"), F.timestamp_seconds(start + F.col("event_id") % 2400 * 86400).alias("at"))
    return kg.as_of_join(events, kg.superseded(facts(spark, sf_dir)), ["scope", "subject", "predicate"], "at").select("event_id", "fact_id", "fact_object")


NATIONS = """
n AS (SELECT 'n' || n_nationkey AS module, 'r' || n_regionkey AS region FROM nation),
e AS (SELECT module AS source, region AS target FROM n UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
y AS (SELECT 'n' || c_nationkey AS module, 'c' || c_custkey AS name FROM customer UNION ALL SELECT 's' || s_suppkey, 'p' || s_suppkey FROM supplier UNION ALL SELECT 'r' || n_regionkey, 'x' || n_nationkey FROM nation)"""


def _edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nation, supplier, customer = (table(spark, sf_dir, t) for t in ("nation", "supplier", "customer"))
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = nation.select(tag("n", "n_nationkey").alias("source"), tag("r", "n_regionkey").alias("target")).union(supplier.select(tag("s", "s_suppkey"), tag("n", "s_nationkey"))).distinct()
    symbols = customer.select(tag("n", "c_nationkey").alias("module"), tag("c", "c_custkey").alias("name")).union(supplier.select(tag("s", "s_suppkey"), tag("p", "s_suppkey"))).union(nation.select(tag("r", "n_regionkey"), tag("x", "n_nationkey")))
    return edges, symbols


@query(f"""WITH {NATIONS}, hit AS (SELECT module FROM n WHERE region = 'r1'),
legs AS (SELECT module, 0 AS o, 'matched' AS leg FROM hit UNION ALL SELECT source, 1, 'caller' FROM e SEMI JOIN hit ON target = module UNION ALL SELECT target, 2, 'callee' FROM e SEMI JOIN hit ON source = module),
b AS (SELECT module, arg_min(leg, o) AS leg FROM legs GROUP BY module)
SELECT DISTINCT y.module, name, leg FROM y JOIN b ON y.module = b.module""")
def explore_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, symbols = _edges(spark, sf_dir)
    matched = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("module"))
    return codeindex.explore(matched, edges, symbols)


@query(f"WITH {NATIONS} SELECT DISTINCT module AS node, target AS other, 'callee' AS leg FROM n JOIN e ON module = source UNION SELECT module, source, 'caller' FROM n JOIN e ON module = target")
def kg_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _ = _edges(spark, sf_dir)
    nodes = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"))
    return kg.neighbours(edges, nodes)


CHECKED = """
b AS (SELECT source || '/' || doc_id || '.lua' AS path, doc_id AS i, md5(text) AS c FROM documents),
old AS (SELECT path, c FROM b WHERE i % 10 <> 1), cur AS (SELECT path, CASE WHEN i % 10 = 3 THEN 'edited' ELSE c END AS c FROM b WHERE i % 10 <> 2)"""


@query(f"WITH {CHECKED} SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' WHEN o.c = n.c THEN 'unchanged' ELSE 'modified' END AS status FROM old o FULL JOIN cur n ON o.path = n.path")
def checksum_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    base = table(spark, sf_dir, "documents").select(i, F.concat("source", F.lit("/"), i.cast("string"), F.lit(".lua")).alias("path"), F.md5("text").alias("checksum"))
    current = base.where(i % 10 != 2).withColumn("checksum", F.when(i % 10 == 3, "edited").otherwise(F.col("checksum")))
    return codeindex.sync(base.where(i % 10 != 1).select("path", "checksum"), current.select("path", "checksum"))


@query("""
WITH b AS (SELECT doc_id AS i, 'f' || doc_id AS full_name FROM documents), o AS (SELECT full_name, i AS line, i % 4 AS arity FROM b WHERE i % 10 <> 1), n AS (SELECT full_name, i AS line, CASE WHEN i % 10 = 3 THEN 9 ELSE i % 4 END AS arity FROM b WHERE i % 10 <> 2)
SELECT coalesce(o.full_name, n.full_name) AS full_name, CASE WHEN o.full_name IS NULL THEN 'added' WHEN n.full_name IS NULL THEN 'removed' WHEN o.arity = n.arity THEN 'unchanged' ELSE 'changed' END AS change FROM o FULL JOIN n USING (full_name)""")
def symbol_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    base = table(spark, sf_dir, "documents").select(i, F.concat(F.lit("f"), i.cast("string")).alias("full_name"), i.alias("line"), (i % 4).alias("arity"), F.lit(False).alias("vararg"), F.lit("").alias("docstring"))
    return codeindex.symbol_changes(base.where(i % 10 != 1), base.where(i % 10 != 2).withColumn("arity", F.when(i % 10 == 3, 9).otherwise(F.col("arity"))))


def _hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(o.alias("hunk_id"), F.col("o_custkey").alias("file_path"), (o % 40).alias("from_line"), (5 + o % 3).alias("from_count"), F.array(F.lit("a"), F.lit("b")).alias("added"))


def _line_symbols(lines: DataFrame) -> DataFrame:
    return lines.select(F.col("l_suppkey").alias("path"), (F.col("l_linenumber") * 7 % 50).alias("line"), F.col("l_partkey").cast("string").alias("name"))


@query("""
WITH h AS (SELECT o_orderkey AS hunk_id, o_custkey AS path, o_orderkey % 40 AS a, 5 + o_orderkey % 3 AS n FROM orders),
y AS (SELECT l_suppkey AS path, l_linenumber * 7 % 50 AS line, CAST(l_partkey AS VARCHAR) AS name FROM lineitem)
SELECT hunk_id, name, line FROM h JOIN y ON h.path = y.path AND line BETWEEN a AND a + n + 2 QUALIFY row_number() OVER (PARTITION BY hunk_id ORDER BY line, name) <= 10""")
def hunk_attribution_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codeindex.attributed(_hunks(spark, sf_dir), _line_symbols(table(spark, sf_dir, "lineitem")))


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(p, '\\.[A-Za-z0-9_]+$', ''), '/(init|index|__init__)$', ''), '/', '.', 'g') AS module, trim(regexp_replace(regexp_replace(p, '\\.[A-Za-z0-9_]+$', ''), '[/\\\\.\\-_\\s]+', ' ', 'g')) AS words FROM (SELECT page_id, regexp_extract(url, '://(.*)$', 1) AS p FROM pages)")
def path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", r"://(.*)$", 1)
    return table(spark, sf_dir, "pages").select("page_id", text.path_module(path).alias("module"), text.path_words(path).alias("words"))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source file for each part, in one of three languages."""
    i, k = F.col("p_partkey"), F.col("p_partkey").cast("string")
    lua = F.concat(F.lit("local M = {}\nlocal util = require('lib.f"), (i - i % 3).cast("string"), F.lit("')\n-- Does part "), k, F.lit("\nfunction M.run_"), k, F.lit("(a, b, ...)\nend\nlocal function help_"), k, F.lit("()\nend\nreturn M\n"))
    py = F.concat(F.lit("import os, json\nfrom lib.f"), k, F.lit(" import x\nclass Part"), k, F.lit(":\n    def size(self, *args):\n        \"\"\"Size of it.\"\"\"\n        return 1\n\ndef _make(a, b):\n    return a\n"))
    js = F.concat(F.lit("import { x } from './f"), k, F.lit("'\n// Makes it\nexport function make"), k, F.lit("(a, ...rest) {\n}\nclass Box {\n  open(lid) {\n  }\n}\nconst go = (x) => x\n"))
    source = F.when(i % 3 == 0, lua).when(i % 3 == 1, py).otherwise(js)
    return table(spark, sf_dir, "part").select(F.concat(F.lit("lib/f"), k, F.when(i % 3 == 0, ".lua").when(i % 3 == 1, ".py").otherwise(".js")).alias("path"), source.alias("text"))


SYMBOLS = """
k AS (SELECT CAST(p_partkey AS VARCHAR) AS k, p_partkey % 3 AS l FROM part),
y AS (SELECT 'lib/f' || k || '.lua' AS path, 'M.run_' || k AS full_name, 'function' AS symbol_type, true AS exported, 4 AS line, 2 AS arity, true AS vararg, 'Does part ' || k AS docstring FROM k WHERE l = 0
 UNION ALL SELECT 'lib/f' || k || '.lua', 'help_' || k, 'function', false, 6, 0, false, '' FROM k WHERE l = 0
 UNION ALL SELECT 'lib/f' || k || '.py', 'Part' || k, 'class', true, 3, 0, false, '' FROM k WHERE l = 1
 UNION ALL SELECT 'lib/f' || k || '.py', 'Part' || k || '.size', 'method', true, 4, 2, true, 'Size of it.' FROM k WHERE l = 1
 UNION ALL SELECT 'lib/f' || k || '.py', '_make', 'function', false, 8, 2, false, '' FROM k WHERE l = 1
 UNION ALL SELECT 'lib/f' || k || '.js', 'make' || k, 'function', true, 3, 2, true, 'Makes it' FROM k WHERE l = 2
 UNION ALL SELECT 'lib/f' || k || '.js', 'Box', 'class', true, 5, 0, false, '' FROM k WHERE l = 2
 UNION ALL SELECT 'lib/f' || k || '.js', 'Box.open', 'method', true, 6, 1, false, '' FROM k WHERE l = 2
 UNION ALL SELECT 'lib/f' || k || '.js', 'go', 'function', false, 9, 1, false, '' FROM k WHERE l = 2)"""


@query(f"WITH {SYMBOLS} SELECT * FROM y")
def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = codeindex.parsed(_sources(spark, sf_dir)).where("row_kind = 'symbol'")
    return found.select("path", "full_name", "symbol_type", "exported", "line", "arity", "vararg", "docstring")


@query("""
WITH k AS (SELECT CAST(p_partkey AS VARCHAR) AS k, CAST(p_partkey - p_partkey % 3 AS VARCHAR) AS b, p_partkey % 3 AS l FROM part)
SELECT 'lib/f' || k || '.lua' AS path, 'lib.f' || b AS imported, CASE WHEN b IN (SELECT k FROM k WHERE l = 0) THEN 'lib/f' || b || '.lua' END AS target FROM k WHERE l = 0
UNION ALL SELECT 'lib/f' || k || '.py', unnest(['os', 'json', 'lib.f' || k]), NULL FROM k WHERE l = 1 UNION ALL SELECT 'lib/f' || k || '.js', './f' || k, NULL FROM k WHERE l = 2""")
def code_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _sources(spark, sf_dir)
    found = codeindex.parsed(files).where("row_kind = 'import'").select("path", "imported")
    return codeindex.resolved(found, files.select("path")).select("path", "imported", "target")


@query()
def code_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol, dependency and file rows of an ingested tree."""
    rows = codeindex.rows_of(_sources(spark, sf_dir), "parts")
    return rows["symbols"].union(rows["dependencies"]).union(rows["files"]).select("scope", "kind", "title", "body", "importance", F.to_json("metadata").alias("metadata"))


@query()
def code_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codeindex.outline_text(codeindex.rows_of(_sources(spark, sf_dir))["symbols"])


@query("SELECT 'o' || o_orderkey AS key, 'src/c' || o_custkey || '.lua' AS file_path, o_orderkey % 90 + 1 AS from_line, 3 AS from_count, o_orderkey % 90 + 2 AS to_line, 3 AS to_count, '-- ' || o_orderstatus || '|new' AS added, '- gone|old' AS removed FROM orders")
def diff_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diff for each order; a removed and an added line look like headers of a file."""
    o, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    name = F.concat(F.lit("src/c"), c, F.lit(".lua"))
    diff = F.concat(F.lit("diff --git a/x b/x\n--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\n@@ -"), (o % 90 + 1).cast("string"), F.lit(",3 +"), (o % 90 + 2).cast("string"), F.lit(",3 @@ f\n same\n-- gone\n-old\n+-- "), F.col("o_orderstatus"), F.lit("\n+new\n"))
    found = diffs.hunks_of(table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), o.cast("string")).alias("key"), diff.alias("diff")), "key", "diff")
    return found.select("key", "file_path", F.col("from_line").cast("long").alias("from_line"), "from_count", F.col("to_line").cast("long").alias("to_line"), "to_count", F.array_join("added", "|").alias("added"), F.array_join("removed", "|").alias("removed"))
