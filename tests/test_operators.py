import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect import schema
from recollect.operators import codeindex, evaluation, graph, kg, learning, lifecycle, projection, search, sensing, store
from recollect.sources import code, diffs, files


def test_leader_clusters_equal_a_loop(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    rows = [(i, f"s{i % 2}", x[i].tolist() if i % 11 else None) for i in range(60)]
    expected = {}
    pivots: dict = {}
    for i, scope, v in rows:
        found = None
        if v is not None:
            u = np.array(v) / np.linalg.norm(v)
            found = next((k for k, p in pivots.setdefault(scope, []) if p @ u >= 0.3), None)
            if found is None:
                pivots[scope].append((i, u))
        expected[i] = i if found is None else found
    df = spark.createDataFrame(rows, "id long, scope string, embedding array<double>")
    assert {r["id"]: r["cluster_id"] for r in lifecycle.leader_clusters(df, 0.3).collect()} == expected


def test_clusters_are_components(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [0.95, 0.3]), (3, "a", [0.8, 0.6]), (4, "a", [0.0, 1.0]), (5, "b", [1.0, 0.0]), (6, "a", None)]
    df = spark.createDataFrame(rows, "id long, scope string, embedding array<float>")
    assert {(r["cluster_id"], r["id"]) for r in lifecycle.clusters(df, 0.9).collect()} == {(1, 1), (1, 2), (1, 3)}


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(500, 501)], "a long, b long"))
    found = {r["id"]: r["component"] for r in graph.components(edges).collect()}
    assert all(found[i] == 0 for i in range(201)) and found[501] == 500 and len(found) == 203
    assert graph.components(edges.where("a < 0")).count() == 0


def test_batch_top_equals_numpy(spark):
    x = np.random.default_rng(2).normal(size=(90, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    found = {(r["query_id"], r["rank"]): r["id"] for r in search.batch_top(df.where("id % 20 = 0"), df, "id", "v", 4).collect()}
    assert found == {(q, k + 1): int(np.argsort(-s[q])[k]) for q in range(0, 90, 20) for k in range(4)}


def test_facts_at_a_time(spark):
    rows = spark.createDataFrame([(1, "s", "ui", "theme", "dark", "2025-01-01", None), (2, "s", "ui", "theme", "light", "2025-06-01", None)], "id long, scope string, subject string, predicate string, object string, f string, valid_until string")
    facts = kg.superseded(rows.select("id", "scope", "subject", "predicate", "object", F.col("f").cast("timestamp").alias("valid_from"), F.col("valid_until").cast("timestamp")))
    at = lambda t: [r["object"] for r in kg.query(facts, at=F.lit(t).cast("timestamp")).collect()]
    assert at("2025-04-01") == ["dark"] and at("2025-08-01") == ["light"] and at("2025-06-01") == ["light"] and at("2024-01-01") == []
    with pytest.raises(ValueError):
        kg.query(facts, subject="")


def test_filters_refuse_what_they_would_ignore(spark):
    with pytest.raises(ValueError):
        search.scope_filter(["", ""])
    with pytest.raises(ValueError):
        search.metadata_filter({"a b": 1})
    with pytest.raises(ValueError):
        store.delete_where(spark.range(1))


def test_names_and_phrases():
    assert search.names_in("What did Alice tell my iPhone, Bob?") == ["alice", "phone", "bob"]
    assert search.phrases_in("say \"Hello There\" or 'Good Bye'") == ["hello there", "good bye"]
    assert search.resolve_scopes("o", None, "o") == ["o", "global"]


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        ("I switched from vim to emacs.", {"switched from vim to emacs"}),
        ("I prefer tea over coffee!", {"prefers tea over coffee"}),
        ("I usually prefer trains. I usually prefer trains.", {"preference for trains"}),
        ("My preference is dark mode", {"preference for dark mode"}),
        ("I always test first? I never skip lunch.", {"always test first", "never skip lunch"}),
        ("I don't like noise.", {"dislikes noise"}),
        ("I find maps useful", {"finds maps useful"}),
        ("I'm comfortable with risk.", {"comfortable with risk"}),
        ("I used to smoke.", {"used to smoke"}),
        ("The weather is fine.", set()),
    ],
)
def test_preferences(spark, body, expected):
    rows = spark.createDataFrame([(1, body)], "id long, body string")
    assert {r["preference"] for r in sensing.preferences(rows, "id", "body").collect()} == {sensing.PREFIX + x for x in expected}


def test_signals_of_user_turns_only(spark):
    rows = spark.createDataFrame([(1, "user", "No, that's wrong. Always ask."), (2, "assistant", "No, that's wrong"), (3, None, "Exactly!"), (4, "user", None)], "id long, role string, text string")
    found = {(r["id"], r["kind"]): r["confidence"] for r in sensing.signals(rows).collect()}
    assert found == {(1, "correction"): 0.9, (1, "command"): 0.8, (3, "praise"): 0.8}


def test_companions_skip_synthetic_rows(spark):
    rows = spark.createDataFrame([(1, "s", "I love tea.", {"is_synthetic": "true"}), (2, "s", "I love jam.", {})], "id long, scope string, body string, metadata map<string,string>")
    assert [r["title"] for r in sensing.companions(rows).collect()] == [sensing.PREFIX + "likes jam"]


def test_harvest_prefers_the_heavier_signal(spark):
    events = spark.createDataFrame([(1, 7, "s", "praise", "2024-01-01"), (2, 7, "s", "mistake", "2024-01-02"), (3, 9, "s", "praise", "2024-01-01")], "id long, memory_id long, scope string, event_type string, created_at string")
    log = spark.createDataFrame([(1, "s", "q", [7, 8], "2024-01-01"), (2, "s", "only", [9], "2024-01-01")], "id long, scope string, query string, candidate_ids array<long>, created_at string")
    (row,) = learning.harvest(events, log).collect()
    assert (row["query"], row["positive"], row["negatives"], row["weight"], row["signal"]) == ("q", 7, [8], 3.0, "mistake")


def test_trainer_lowers_the_loss_and_gates(spark):
    rng = np.random.default_rng(5)
    pairs, weights = rng.normal(size=(40, len(search.FEATURES))), rng.choice([1.0, 2.0, 3.0], size=40)
    w = dict(search.PRIOR)
    for _ in range(7):  # one number at a time
        for d, weight in zip(pairs.tolist(), weights.tolist()):
            margin = sum(w[k] * x for k, x in zip(search.FEATURES, d))
            for k, x in zip(search.FEATURES, d):
                w[k] += 0.1 * (weight * x / (1 + np.exp(margin)) - 0.01 * (w[k] - search.PRIOR[k]))
    found = learning.fit(pairs, weights, epochs=7)
    assert found.keys() == w.keys() and all(abs(found[k] - w[k]) < 1e-9 for k in w)
    assert learning.mean_loss(pairs[:5], learning.fit(pairs[:5], weights[:5])) < learning.mean_loss(pairs[:5], search.PRIOR)
    assert learning.mean_loss(pairs[:0], w) == 0.0 and all(np.isfinite(list(learning.fit(pairs * 1e6, weights, epochs=2).values())))
    assert learning.decide(10, 0.1, 0.9) == "skip" and learning.decide(20, 0.1, 0.9) == "promote" and learning.decide(20, 0.9, 0.9) == "reject"


def test_projections():
    rng = np.random.default_rng(3)
    triples = [(rng.normal(size=6), rng.normal(size=6), [rng.normal(size=6)]) for _ in range(8)]
    x = rng.normal(size=6)
    assert np.allclose(projection.apply(projection.identity(6), x), x / np.linalg.norm(x))
    assert np.allclose(projection.raw(projection.identity_lowrank(6, 2), x), x)
    assert projection.apply(None, x) is x
    for train, start in ((projection.train, projection.identity(6)), (projection.train_lowrank, projection.identity_lowrank(6))):
        assert projection.loss(train(triples, 6), triples) < projection.loss(start, triples)


def test_registry_promotes_and_rolls_back(spark):
    registry = spark.createDataFrame([("s", "k", 1, {"a": 1.0}, True)], "scope string, kind string, version int, weights map<string,double>, is_current boolean")
    two = learning.registered(registry, spark.createDataFrame([("s", "k", {"a": 2.0})], "scope string, kind string, weights map<string,double>"))
    now = lambda r: [(x["version"], x["weights"]["a"]) for x in learning.current_weights(r).collect()]
    assert now(two) == [(2, 2.0)] and now(learning.rolled_back(two, "s", "k")) == [(1, 1.0)] and now(learning.rolled_back(registry, "s", "k")) == [(1, 1.0)]


def test_log_of_versions(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, body string")
    log = store.versioned(base, 1).union(store.versioned(spark.createDataFrame([(2, "B")], "id long, body string"), 2)).union(store.versioned(base.where("id = 3"), 3, "D"))
    rows = lambda x: sorted((r["id"], r["body"]) for r in x.collect())
    assert rows(store.current(log)) == [(1, "a"), (2, "B")] == rows(store.current(store.compacted(log)))


def test_symbols_of_three_languages():
    lua = code.parse("local M = {}\n-- Adds.\n-- ----\nfunction M.add(a, b, ...)\nend\nfunction M:go()\nend\nlocal x = require('a.b')\n", "m.lua")
    assert [(s["full_name"], s["symbol_type"], s["arity"], s["vararg"], s["exported"], s["docstring"]) for s in lua.symbols] == [("M.add", "function", 2, True, True, "Adds."), ("M:go", "method", 0, False, True, "")]
    assert lua.imports == [("a.b", 8)]
    py = code.parse("from a.b import c\nimport d, e.f as g\nclass K:\n    async def m(self, *a):\n        '''Doc.'''\n\ndef _f():\n    pass\n", "x.py")
    assert [s["full_name"] for s in py.symbols] == ["K", "K.m", "_f"] and [m for m, _ in py.imports] == ["a.b", "d", "e.f"] and py.symbols[1]["docstring"] == "Doc."
    js = code.parse("import x from 'y'\nexport class A {\n  run(a) {\n    if (a) {\n    }\n  }\n}\nexport const f = (a, b) => a\n", "z.ts")
    assert [(s["full_name"], s["exported"]) for s in js.symbols] == [("A", True), ("A.run", True), ("f", True)] and js.imports == [("y", 1)]
    assert code.parse("x", "y.md").symbols == []


def test_definitions_over_lines_and_in_strings():
    names = lambda text, path: [(s["full_name"], s["symbol_type"], s["line"], s["arity"], s["vararg"]) for s in code.parse(text, path).symbols]
    py = '@wraps(f)\ndef long(\n    a, b=(1, 2),\n    *rest, **more,\n):\n    x = """\ndef not_one(): pass\n"""\n    def inner(): pass\nclass K:\n    @property\n    def v(self): pass\n'
    assert names(py, "a.py") == [("long", "function", 2, 4, True), ("inner", "function", 9, 0, False), ("K", "class", 10, 0, False), ("K.v", "method", 12, 1, False)]
    assert names("def a(): pass\n)(\ndef b(): pass\n", "a.py") == [("a", "function", 1, 0, False)] and names("\0(", "a.py") == []
    js = '// function no() {}\nconst s = "class X {";\nexport async function f(\n  a,\n  {b, c} = {},\n  ...d\n) {}\nclass K extends L {\n  static go(a) { if (a) { run(a); } }\n  get v() { return 1 }\n  field = call(1)\n}\nlet g = async x => x, n = 5\nconst h = function* (a, b) {}\n'
    assert names(js, "a.js") == [("f", "function", 3, 3, True), ("K", "class", 8, 0, False), ("K.go", "method", 9, 1, False), ("K.v", "method", 10, 0, False), ("g", "function", 13, 1, False), ("h", "function", 14, 2, False)]
    lua = 'local s = "function no()"\n--[[ function no() end ]]\nlocal M = {}\nM.run = function(a,\n  b, ...) end\nlocal f = function() end\nfunction M.sub:go(x) end\nlocal r = require "x.y"\n'
    assert names(lua, "a.lua") == [("M.run", "function", 4, 2, True), ("f", "function", 6, 0, False), ("M.sub:go", "method", 7, 1, False)] and code.parse(lua, "a.lua").imports == [("x.y", 8)]
    doc = code.parse("/**\n * Adds\n * two.\n */\nexport function add(a) {}\n", "a.ts").symbols[0]
    assert doc["docstring"] == "Adds two." and doc["exported"]


def test_names_are_capitalised_words_but_for_question_words():
    assert search.names_in("What did May and Will tell Has about it") == ["may", "has"]


def test_hunks_that_look_like_headers():
    text = "diff --git a/f b/f\n--- a/f\n+++ b/f\n@@ -1,2 +1,2 @@ x\n--- gone\n+++ new\n same\n@@ -9 +9,0 @@\n-last\ndiff --git a/g b/g\n--- a/g\n+++ /dev/null\n@@ -1 +0,0 @@\n-x\n\\ No newline at end of file\n"
    found = [(h[0], h[2], h[6], h[7]) for h in diffs.hunks(text)]
    assert found == [("f", 1, ["++ new"], ["-- gone"]), ("f", 9, [], ["last"]), ("g", 1, [], ["x"])]
    assert list(diffs.hunks(None)) == [] and list(diffs.hunks("nothing")) == []


def test_walk_and_index(spark, tmp_path):
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib/a.lua").write_text("local M = {}\nfunction M.go()\nend\nlocal b = require('lib.b')\n")
    (tmp_path / "lib/b.lua").write_text("-- b\nlocal function x() end\n")
    (tmp_path / "lib/bin.lua").write_bytes(bytes(range(32)) * 8)
    (tmp_path / "skip.txt").write_text("no")
    found = files.walk(spark, f"file://{tmp_path}", ["lua"])
    assert sorted(r["path"] for r in found.collect()) == ["lib/a.lua", "lib/b.lua"]
    assert [r["path"] for r in files.walk(spark, f"file://{tmp_path}", ["lua"], exclude=["lib/b*"]).collect()] == ["lib/a.lua"]
    rows = codeindex.rows_of(found, "p")
    assert {r["title"] for r in rows["symbols"].collect()} == {"lib.a.go", "lib.b.x"}
    assert [(r["subject"], r["object"]) for r in rows["facts"].collect()] == [("lib.a", "lib.b")]
    gone = codeindex.invalidated(rows["symbols"].union(rows["dependencies"]), spark.createDataFrame([("lib/a.lua",)], "path string"))
    assert [r["title"] for r in gone.collect()] == ["lib.b.x"]


def test_schema_differences():
    assert schema.differences(schema.DIGESTS, schema.DIGESTS) == []
    assert ("scope", None, "string") in schema.differences(schema.table("x int"), schema.DIGESTS)


def test_metrics(spark):
    ranks = spark.createDataFrame([(1, 1), (2, 4), (3, None)], "query_id int, rank int")
    m = evaluation.metrics(ranks).first()
    assert m["n"] == 3 and m["recall_1"] == pytest.approx(1 / 3) and m["recall_5"] == pytest.approx(2 / 3) and m["mrr"] == pytest.approx(1.25 / 3) and m["misses"] == 1
    assert evaluation.safe_k([(1, 0.5), (5, 0.9), (10, 1.0)]) == 5


def test_markdown_and_decisions(spark):
    rows = spark.createDataFrame([("a.md", "intro\n# One\nbody\n## Two\nmore\n# Empty\n")], "path string, text string")
    assert [(r["title"], r["section"]) for r in files.markdown_sections(rows, "path", "text").orderBy("position").collect()] == [("a.md", "intro"), ("One", "body"), ("Two", "more")]
    src = spark.createDataFrame([("a.lua", "x\n-- DECISION: use it\n")], "path string, text string")
    assert [(r["line"], r["tag"], r["text"]) for r in files.decision_comments(src).collect()] == [(2, "DECISION", "use it")]


def test_benchmark_loader(spark, tmp_path):
    import json

    from recollect.sources import benchmarks

    row = {"question_id": "q1", "question": "?", "answer": "a", "question_type": "t", "question_date": "2023/05/30 (Tue) 23:40", "haystack_session_ids": ["s1", "s2"], "haystack_sessions": [[{"role": "user", "content": "hi"}], [{"role": "user", "content": "yo"}]], "haystack_dates": ["2023/05/20 (Sat) 02:21", "2023/05/21 (Sun) 02:21"], "answer_session_ids": ["s2"]}
    (tmp_path / "l.json").write_text(json.dumps([row]))
    sessions, gold = benchmarks.longmemeval(spark, str(tmp_path / "l.json"))
    assert {(r["session_id"], r["body"], str(r["at"])) for r in sessions.collect()} == {("s1", "user: hi", "2023-05-20 02:21:00"), ("s2", "user: yo", "2023-05-21 02:21:00")}
    assert [r["session_id"] for r in gold.collect()] == ["s2"]
    (tmp_path / "c.json").write_text(json.dumps([{"sample_id": "c1", "conversation": {"speaker_a": "A", "session_1": [{"speaker": "A", "text": "hi", "dia_id": "D1:1"}], "session_1_date_time": "1:56 pm on 8 May, 2023"}, "qa": [{"question": "?", "answer": "x", "category": 1, "evidence": ["D1:1"]}]}]))
    sessions, gold = benchmarks.locomo(spark, str(tmp_path / "c.json"))
    (s,) = sessions.collect()
    assert s["session_id"] == "session_1" and s["body"] == "A: hi" and str(s["at"]) == "2023-05-08 13:56:00"
    assert [r["session_id"] for r in gold.collect()] == ["session_1"]


def test_regex_literals_and_nested_templates_hide_nothing():
    js = "\n".join(
        [
            "const clean = (s) => s.replace(/`/g, \"'\").replace(/[\"'/]/, '');",
            "function one() { return /\\/'/.test(x) ? 1 : a / b / c; }",
            "const t = `a ${list.map(x => `<${x + '}'}>`).join('`')} b`;",
            "function two(a) { return `${/* c */ a}` }",
            "if (a) /x'/.exec(b); // it's",
            "class Box { go() { return (1 + 2) / 3; } }",
            "const half = n => n / 2; const s = 'it`s';",
            "function three() {}",
            "const bad = `never closed function four() {}",
        ]
    )
    found = [(x["full_name"], x["line"]) for x in code.parse(js, "a.js").symbols]
    assert found == [("clean", 1), ("one", 2), ("two", 4), ("Box", 6), ("Box.go", 6), ("half", 7), ("three", 8)]


def test_hunks_meet_symbols_of_their_bins_once(spark):
    rng = np.random.default_rng(1)
    hunks = [(i, "hot" if i % 3 else f"p{i % 5}", int(rng.integers(0, 900)), int(rng.integers(0, 300)), ["+"] * int(rng.integers(0, 4))) for i in range(60)] + [(100, "hot", 64, 0, []), (101, "hot", 10, -9, []), (102, None, 1, 5, [])]
    symbols = [("hot" if i % 4 else f"p{i % 5}", int(rng.integers(0, 1200)), f"s{i}") for i in range(500)] + [("hot", 64, "edge")]
    h = spark.createDataFrame(hunks, "hunk_id long, file_path string, from_line int, from_count int, added array<string>")
    y = spark.createDataFrame(symbols, "path string, line int, name string")
    expected = []
    for i, path, a, n, added in hunks:
        own = sorted((line, name) for p, line, name in symbols if p == path and a <= line <= a + n + len(added))
        expected += [(i, name, line) for line, name in own[:10]]
    assert sorted(tuple(r) for r in codeindex.attributed(h, y).collect()) == sorted(expected)
    plan = codeindex.attributed(h, y)._jdf.queryExecution().executedPlan().toString()
    assert "recollect bin of span" in plan
