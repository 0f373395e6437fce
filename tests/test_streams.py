"""Streams with state: claims that end, late rows, summaries of idle scopes."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from recollect.operators import codeindex
from recollect.streaming import jobs

START = datetime(2024, 1, 1)


def files(spark, folder, batches, columns="scope string, ts timestamp"):
    for i, rows in enumerate(batches):
        spark.createDataFrame([(*r[:-1], START + timedelta(minutes=r[-1])) for r in rows], columns).coalesce(1).write.mode("append").parquet(f"{folder}/{i}")


def test_claims_end_and_late_rows_are_dropped(spark, tmp_path):
    batches = [[("a", 0), ("a", 10), ("b", 20)], [("a", 59), ("a", 60), ("a", 130), ("c", 100)], [("a", 5), ("b", 400)], [("d", 5000)]]
    for i, rows in enumerate(batches):
        files(spark, f"{tmp_path}/in/{i}", [rows])
        stream = spark.readStream.schema("scope string, ts timestamp").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        query = jobs.debounced(stream, every=3600, late="30 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
        query.awaitTermination()
        state = spark.read.format("statestore").option("stateVarName", "last").load(f"{tmp_path}/log")
        if i == 1:
            assert state.count() == 2  # b's claim of minute 20 blocks nothing beyond minute 80, and the watermark is at 100
    got = sorted((r["scope"], int((r["claimed_at"] - START).total_seconds() // 60)) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("a", 0), ("a", 60), ("a", 130), ("b", 20), ("b", 400), ("c", 100), ("d", 5000)]
    assert [r[0] for r in state.select("key.scope").collect()] == ["d"]


def test_idle_scopes_are_summarised(spark, tmp_path):
    now = F.lit(START + timedelta(days=100)).cast("timestamp")
    rows = [(i, "ab"[i % 2], "fact", f"t{i}", f"body {i}", 1.0, 0.5, START - timedelta(days=i + 1)) for i in range(8)]
    memory = spark.createDataFrame(rows, "id long, scope string, kind string, title string, body string, importance double, decay_rate double, updated_at timestamp").withColumn("created_at", F.col("updated_at"))
    files(spark, f"{tmp_path}/in", [[("a", 0), ("a", 10), ("b", 20), ("b", 500)]])
    stream = spark.readStream.schema("scope string, ts timestamp").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    seen = {}

    def write(parts, number):
        found = [(r["scope"], r["title"], sorted(r["source_ids"])) for r in parts["summaries"].collect()]
        seen[number] = (found, sorted(r["scope"] for r in parts["rows"].collect()))

    jobs.summarising(stream, lambda: memory.where("scope = 'a'"), write, f"{tmp_path}/log", now, late="1 hour", days=0).awaitTermination()
    told = [x for x in seen.values() if x[0]]
    assert len(told) == 1 and told[0][0][0][0] == "a" and told[0][0][0][2] == [0, 2, 4, 6] and told[0][1] == ["a"]


def test_an_index_follows_a_stream_of_files(spark, tmp_path):
    lua = lambda i, n: f"local M = {{}}\nlocal u = require('lib.f{n}')\nfunction M.run_{i}(a)\nend\nreturn M\n"
    first = [(f"lib/f{i}.lua", 1, lua(i, i + 1)) for i in range(6)]
    second = [("lib/f0.lua", 2, lua(0, 1)), ("lib/f1.lua", 2, lua(1, 9)), ("lib/f1.lua", 3, lua(1, 8)), ("lib/f2.lua", 2, None), ("lib/new.py", 2, "import os\ndef go():\n    pass\n")]
    third = [("lib/f2.lua", 5, lua(2, 7)), ("lib/f3.lua", 4, None), ("lib/f3.lua", 3, lua(3, 3)), ("lib/none.lua", 4, None)]
    columns, folder = "path string, changed long, text string", f"file://{tmp_path}/index"
    now = {}
    rows = lambda df: sorted((r["scope"], r["kind"], r["title"], r["body"], str(sorted(r["metadata"].items()))) for r in df.collect())
    for number, batch in enumerate((first, second, third)):
        spark.createDataFrame(batch, columns).coalesce(1).write.parquet(f"{tmp_path}/in/{number}")
        stream = spark.readStream.schema(columns).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        jobs.indexing(stream, folder, f"{tmp_path}/log", "p").awaitTermination()
        for path, _, body in sorted(batch, key=lambda x: x[1]):
            now[path] = body
        tree = spark.createDataFrame([(k, v) for k, v in now.items() if v is not None], "path string, text string")
        expected = codeindex.rows_of(tree, "p")
        whole = expected["symbols"].unionByName(expected["dependencies"]).unionByName(expected["files"])
        fact = lambda df: sorted(tuple(r) for r in df.select("scope", "subject", "predicate", "object").collect())
        assert rows(jobs.index_of(spark, folder)) == rows(whole) and fact(jobs.index_of(spark, folder, "facts")) == fact(expected["facts"])
        jobs.index_batch(spark.createDataFrame(batch, columns), number, folder, "p")  # run again
        assert rows(jobs.index_of(spark, folder)) == rows(whole)
    parsed = spark.read.parquet(f"{tmp_path}/index/rows").where("kind = 'file' and batch = 1").select("title").collect()
    assert sorted(r["title"] for r in parsed) == ["lib/f1.lua", "lib/new.py"]
