"""Composite jobs against plain loops."""

import sys

import numpy as np
import pytest
from oracle import SF
from pyspark import cloudpickle
from pyspark.sql import functions as F

from recollect.functions import text, vectors
from recollect.operators import learning, lifecycle, models, search, sensing, writing
from recollect.plans import jobs
from recollect.plans.fixtures import as_of
from recollect.sources import files
from recollect.streaming import jobs as streams

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import a test


class Fixed:
    """Vectors by text; some answers are wrong."""

    dim = 2

    def __init__(self, by):
        self.by = by

    def __call__(self, texts):
        if "boom" in texts:
            raise RuntimeError("no model")
        return [self.by.get(t, [1.0, 0.0]) for t in texts]


INCOMING = "position long, scope string, kind string, title string, body string, importance double, decay_rate double, tags array<string>, metadata map<string,string>"


def test_write_many_equals_a_loop(spark):
    found = {r["position"]: r for r in jobs.write_many(spark, SF).collect()}
    incoming = {r["position"]: r for r in jobs._incoming(spark, SF).collect()}
    stored = {r["scope"]: (r["id"], np.array(r["embedding"], dtype=float)) for r in jobs._stored(spark, SF).collect()}
    kept: dict = {}
    for position in sorted(incoming):
        r, got = incoming[position], found[position]
        if not r["body"].strip() or not r["title"].strip():
            assert got["error"] and got["action"] is None
            continue
        v = vectors.hash_embed(f"{r['title']}\n{r['body']}").astype("f4").astype(float)
        cos = lambda x: float(x @ v / max(1e-12, np.linalg.norm(x) * np.linalg.norm(v)))  # noqa: B023, E731
        first = next((p for p, x in kept.get(r["call"], []) if cos(x) >= 0.95), None)
        if first is not None:
            assert (got["action"], got["first_position"]) == ("merged", first)
            continue
        kept.setdefault(r["call"], []).append((position, v))
        near = r["scope"] in stored and cos(stored[r["scope"]][1]) >= 0.95
        assert (got["action"], got["match_id"]) == (("merged", stored[r["scope"]][0]) if near else ("inserted", None))
    assert {r["action"] for r in found.values()} == {"inserted", "merged", None}


@pytest.mark.parametrize("strategy", ["update", "skip", "append"])
def test_write_many_of_a_small_batch(spark, strategy):
    rows = [(1, "s", None, "a", "x", None, None, ["t"], None), (2, "s", None, "b", "y", 0.9, 0.0, ["u"], {"k": "v"}), (3, "s", None, "c", " ", None, None, None, None), (4, "s", None, "d", "z", 99.0, None, None, None), (5, "s", None, "e", "far", 0.1, None, None, None), (6, "r", None, "f", "w", 0.5, None, None, None)]
    by = {"e\nfar": [0.0, 1.0], "f\nw": [0.7, -0.7]}
    old = spark.createDataFrame([(70, "s", "old", "old body", [0.0, 1.0], ["o"], {"m": "1"}), (71, "r", "old", "other", [1.0, 1.0], None, None)], "id long, scope string, title string, body string, embedding array<float>, tags array<string>, metadata map<string,string>")
    out = writing.write_many(spark.createDataFrame(rows, INCOMING), old, Fixed(by), as_of(), 100, strategy)
    got = {r["position"]: (r["action"], r["match_id"], r["error"]) for r in out.results.collect()}
    word = {"update": "merged", "skip": "skipped", "append": "inserted"}[strategy]
    assert got[1][0] == "inserted" and got[2][0] == word and got[6][0] == "inserted"
    assert got[3] == (None, None, "body required") and got[4][2] == "importance must be in [0, 10]"
    assert got[5][:2] == ((word, 70) if strategy != "append" else ("inserted", None))
    new = {r["id"]: r for r in out.inserted.collect()}
    assert sorted(new) == ([101, 106] if strategy != "append" else [101, 102, 105, 106])
    assert new[101]["body"] == ("x\ny" if strategy == "update" else "x") and new[101]["tags"] == (["u"] if strategy == "update" else ["t"])
    assert [r["id"] for r in out.merged.collect()] == ([70] if strategy == "update" else [])
    assert [(r["memory_id"], r["note"]) for r in out.misses.collect()] == [(70, "miss:duplicate-write")]
    with pytest.raises(ValueError):
        writing.write_many(spark.createDataFrame(rows, INCOMING), old, Fixed(by), as_of(), 100, "other")


def test_update_embeds_what_changed(spark):
    old = spark.createDataFrame([(1, "s", "a", "b", [9.0, 9.0]), (2, "s", "a", "b", [9.0, 9.0])], "id long, scope string, title string, body string, embedding array<float>")
    patch = spark.createDataFrame([(1, "new", ""), (2, "a", None)], "id long, title string, body string")
    got = {r["id"]: (r["title"], r["body"], list(r["embedding"])) for r in writing.updated(old, patch, Fixed({}), as_of()).collect()}
    assert got == {1: ("new", "b", [1.0, 0.0]), 2: ("a", "b", [9.0, 9.0])}


def test_embedder_errors_stay_with_their_rows(spark):
    rows = spark.createDataFrame([(1, "long text"), (2, " "), (3, None), (4, "odd")], "id long, body string")
    got = {r["id"]: r for r in models.embedded(rows, "body", Fixed({"odd": [1.0]}), most_chars=4).collect()}
    assert list(got[1]["embedding"]) == [1.0, 0.0] and got[1]["was_truncated"] and got[1]["embed_error"] is None
    assert got[2]["embed_error"] == got[3]["embed_error"] == "text required" and got[4]["embed_error"] == "dimension mismatch: got 1, expected 2"
    assert "no model" in models.embedded(spark.createDataFrame([("boom",)], "body string"), "body", Fixed({})).first()["embed_error"]
    assert models.probe(models.HashEmbedder()) == 384
    with pytest.raises(ValueError):
        models.probe(Fixed({"probe": [1.0]}))
    assert models.reembedded(rows.withColumns({"title": F.lit("t"), "embedding": F.lit(None)}), Fixed({}), dry_run=True).first().asDict() == {"n": 4, "n_without_vector": 4}


@pytest.mark.parametrize("service", sorted(models.SERVICES))
def test_services_by_their_shapes(service):
    def send(body):
        n = next((len(x) for x in body.values() if isinstance(x, list)), 1)
        own = [[float(i), 1.0] for i in range(n)]
        return {"generic": {"embedding": own[0]}, "ollama": {"embedding": own[0]}, "tei": own, "cohere": {"embeddings": own}}.get(service, {"data": [{"index": i, "embedding": v} for i, v in reversed(list(enumerate(own)))]})

    many = models.SERVICES[service][1]
    assert models.ServiceEmbedder(service, "m", 2, send)(["a", "b"]) == [[0.0, 1.0], [1.0 if many else 0.0, 1.0]]
    with pytest.raises(ValueError):
        models.ServiceEmbedder("other", "m", 2, send)


def test_rerank_orders_the_pool_and_falls_back(spark):
    rows = spark.createDataFrame([(i, f"t{i}", "b", 1.0 - i / 10) for i in range(6)], "id long, title string, body string, score double")
    ids = lambda f, **o: [r["id"] for r in models.rerank(rows, "q", f, **o).collect()]
    assert ids(lambda q, t: [(2, 1.0), (0, 1.0), (3, 5.0)], top_n=4) == [3, 0, 2, 1, 4, 5]
    assert ids(lambda q, t: [(9, 1.0)], top_n=4) == ids(lambda q, t: 1 / 0) == [0, 1, 2, 3, 4, 5]
    assert ids(lambda q, t: [(1, 1.0)], limit=2) == [1, 0]
    with pytest.raises(ValueError):
        models.rerank(rows, "", lambda q, t: [])


def test_summaries_by_a_model():
    assert models.parsed_summary('Sure: {"title": " a ", "body": "b"} ok') == ("a", "b")
    assert models.parsed_summary("no") is models.parsed_summary('{"title": "a"}') is None
    assert models.asked_summary(lambda p: '{"title": "n", "body": "%d"}' % p.count("["))([("t", "x" * 2000), (None, None)]) == ("n", "2")


ROWS = "id long, scope string, kind string, title string, body string, importance double, decay_rate double, updated_at timestamp, created_at timestamp, embedding array<double>, metadata map<string,string>"


def aged(spark):
    from datetime import datetime

    old, new = datetime(2023, 1, 1), datetime(2024, 2, 28)
    rows = [(1, "s", "fact", "a", "x", 0.4, 0.001, old, old, [1.0, 0.0], None), (2, "s", "fact", "b", "y", 0.3, 0.5, old, new, [1.0, 0.01], None), (3, "s", "fact", "c", "z", 0.9, 0.0, new, new, [0.0, 1.0], None), (4, "t", "fact", "d", "w", 0.1, 0.0, old, old, None, None)]
    return spark.createDataFrame(rows, ROWS)


def test_summaries_replace_their_batches(spark):
    out = lifecycle.summarise_run(aged(spark), as_of(), first_id=1000)
    left = out["rows"].collect()
    assert sorted(r["id"] for r in left if r["kind"] != "summary") == [3]
    assert {(r["scope"], r["title"], r["body"]) for r in left if r["kind"] == "summary"} == {("s", "Summary: a | b", "- x\n- y"), ("t", "Summary: d", "- w")}
    assert lifecycle.summarise_run(aged(spark), as_of(), dry_run=True)["rows"].count() == 4
    failed = lifecycle.summarise_run(aged(spark), as_of(), summariser=lambda rows: None)
    assert failed["rows"].count() == 4 and {r["error"] for r in failed["summaries"].collect()} == {"no summary"}


def test_consolidate_run_expires_and_merges(spark):
    out = lifecycle.consolidate_run(aged(spark), as_of(), models.noop, first_id=1000)
    assert [r["id"] for r in out["expired"].collect()] == [2] and sorted(r["id"] for r in out["clusters"].collect()) == [1, 2]
    assert sorted(r["id"] for r in out["rows"].collect()) == [3, 4, 1001]
    plain = lifecycle.consolidate_run(aged(spark), as_of())
    assert {r["id"]: r["importance"] for r in plain["rows"].collect()} == {1: 0.4, 2: 0.0, 3: 0.9, 4: 0.1}


def test_promoted_sessions_carry_their_sources(spark):
    out = {r["id"]: r for r in lifecycle.promote_session(aged(spark), "s", "long", as_of(), new_id=50, delete_source=True).collect()}
    assert sorted(out) == [4, 50] and out[50]["title"] == "[promoted] Summary: a | b | c" and out[50]["metadata"] == {"promoted_from": "s", "source_ids": "1,2,3"}
    assert lifecycle.promote_session(aged(spark), "none", "long", as_of()).count() == 4
    with pytest.raises(ValueError):
        lifecycle.promote_session(aged(spark), "s", "s", as_of())


def test_digest_equals_a_loop(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(6, 8))
    rows, known = [], []
    for i in range(60):
        v = base[i % 6] + rng.normal(size=8) * (0.05 if i % 3 else 1.0)
        rows.append((i, ("a", "b")[i % 2], f"body {i}", float(i % 5) / 20, i // 2 % 2, v.tolist()))
    known.append((1000, "a", base[0].tolist()))
    schema = "id long, scope string, body string, importance double, tier int, embedding array<double>"
    table = spark.createDataFrame(rows, schema).withColumns({"consolidated_at": F.lit(None).cast("timestamp"), "created_at": as_of(), "updated_at": as_of()})
    obs = spark.createDataFrame(known, "id long, scope string, embedding array<float>").withColumns({"proof_count": F.lit(1), "evidence_ids": F.array(F.lit(-1).cast("long")), "evidence_quotes": F.array(F.lit("q")), "freshness_trend": F.lit("stable"), "last_reinforced": as_of()})
    events = spark.createDataFrame([(i, "mistake") for i in range(0, 60, 2) for _ in range(i % 3)], "memory_id long, event_type string")
    out = lifecycle.digested(table, obs, events, as_of(), models.HashEmbedder(8), 5000)
    cos = lambda x, y: float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y))

    def greedy(items, threshold=0.80):
        found = []
        for x in items:
            at = next((c for c in found if cos(c[0][5], x[5]) >= threshold), None)
            found.append([x]) if at is None else at.append(x)
        return found

    escalated, observed = {}, {}
    for scope in "ab":
        mine = [np.array(o[2], "f4") for o in known if o[1] == scope]
        every = greedy([x for x in rows if x[1] == scope])
        new = [max(c, key=lambda x: (x[3], -x[0])) for c in every if not any(cos(o, c[0][5]) >= 0.75 for o in mine)]
        observed |= {5000 + c[0][0]: len(c) for c in every if not any(cos(o, c[0][5]) >= 0.75 for o in mine)}
        added = [vectors.hash_embed(x[2], 8).astype("f4") for x in new]
        taken = sorted((x for x in rows if x[1] == scope and x[4] == 0), key=lambda x: (-x[3], x[0]))
        for place, c in enumerate(greedy(taken)):
            best = max(c, key=lambda x: x[3])
            n = sum(x[0] % 3 for x in c if x[0] % 2 == 0)
            if n and not any(cos(o, best[5]) > 0 for o in mine + (added if place else [])):
                escalated[best[0]] = max(best[3], 1 - 1 / (1 + 0.4 * n))
    assert {r["id"]: pytest.approx(r["new_importance"]) for r in out["escalation"].collect()} == escalated and escalated
    after = {r["id"]: r for r in out["observations"].collect()}
    assert {i: r["proof_count"] for i, r in after.items() if i >= 5000} == observed
    assert all(len(r["evidence_ids"]) == len(r["evidence_quotes"]) for r in after.values()) and after[1000]["proof_count"] == len(after[1000]["evidence_ids"]) > 1
    assert {r["freshness_trend"] for i, r in after.items() if i >= 5000} == {"new"}
    left = {r["id"]: r for r in out["rows"].collect()}
    assert len(left) == 60 and all(r["consolidated_at"] is not None for r in left.values()) and all(left[i]["importance"] == pytest.approx(x) for i, x in escalated.items())


def test_signals_are_recorded_once(spark):
    memory = spark.createDataFrame([(1, "s", [1.0, 0.0]), (2, "s", [0.0, 1.0])], "id long, scope string, embedding array<float>")
    said = spark.createDataFrame([(1, "s", "one", "mistake", 0.9), (2, "s", "one again", "mistake", 0.8), (3, "s", "two", "praise", 0.7), (4, "s", "two", "praise", 0.5), (5, "s", "none", "praise", 0.9)], "id long, scope string, text string, event_type string, confidence double")
    by = Fixed({"two": [0.1, 1.0], "none": [-1.0, -1.0]})
    notes = spark.createDataFrame([], "memory_id long, scope string, note string")
    shown = spark.createDataFrame([("s", [2])], "scope string, candidate_ids array<long>")
    got = sensing.recorded(said, memory, by, notes, shown, as_of())
    assert sorted((r["memory_id"], r["event_type"], r["delta"]) for r in got.collect()) == [(1, "miss", 0.9), (2, "praise", 0.7)]
    assert sensing.recorded(said, memory, by, got.select("memory_id", "scope", "note"), shown, as_of()).count() == 0
    answers = spark.createDataFrame([(1, 'ok [{"event_type": "mistake", "statement": "x y", "confidence": 0.9}, {"event_type": "odd", "statement": "z"}]'), (2, "none")], "id long, answer string")
    assert [(r["id"], r["statement"]) for r in sensing.parsed_extractions(answers, "answer").collect()] == [(1, "x y")]


def test_promotion_needs_examples_and_a_better_loss(spark):
    from recollect.schema import WEIGHTS

    empty = spark.createDataFrame([], WEIGHTS).drop("id")
    features = ", ".join(f"f_{k} double" for k in search.FEATURES)
    rows = [("s", f"q{q:02}", 1, 1.0, i, i == 1, 0.5, float(i == 1), 0.0, 0.0, 0.0, 0.0) for q in range(30) for i in range(3)]
    found = spark.createDataFrame(rows, f"scope string, query string, positive long, weight double, id long, is_positive boolean, {features}")
    out = learning.promotion(found, empty, "s", as_of(), epochs=5)
    audit = out["audit"].first()
    assert out["decision"] == "promote" and audit["new_score"] < audit["incumbent_score"] and (audit["n_train"], audit["n_gate"]) == (20, 10)
    assert learning.promotion(found, empty, "s", as_of(), epochs=5, dry_run=True)["decision"] == "would-promote"
    assert learning.promotion(found, out["registry"], "s", as_of(), epochs=5)["decision"] == "reject"
    assert learning.promotion(found.where("query < 'q05'"), empty, "s", as_of())["decision"] == "skip"
    assert out["registry"].where("is_current").first()["version"] == 1


def test_scopes_are_trained_as_if_alone(spark):
    from recollect.schema import WEIGHTS

    empty = spark.createDataFrame([], WEIGHTS).drop("id")
    rng = np.random.default_rng(9)
    features = ", ".join(f"f_{k} double" for k in search.FEATURES)
    rows = [(f"s{s}", f"q{q:03}", 1, 1.0 + q % 2, i, i == 0, *rng.random(6).tolist()) for s, n in (("a", 30), ("b", 61), ("c", 19), ("d", 25)) for q in range(n) for i in range(1 if q == 4 else 3)]
    found = spark.createDataFrame(rows, f"scope string, query string, positive long, weight double, id long, is_positive boolean, {features}").repartition(5)
    out = learning.promotions(found, empty, as_of(), epochs=4, most=50)
    audit = {r["scope"]: r for r in out["outcome"].collect()}
    assert {k: (r["n_train"], r["n_gate"]) for k, r in audit.items()} == {"sa": (20, 10), "sb": (34, 16), "sc": (13, 6), "sd": (17, 8)} and audit["sc"]["decision"] == "skip"
    for scope in ("sa", "sb", "sd"):
        pairs, weights, gate = [], [], []
        for n, q in enumerate(sorted({r[1] for r in rows if r[0] == scope})[:50], 1):
            own = [r for r in rows if r[0] == scope and r[1] == q]
            best = next(r for r in own if r[5])
            for r in sorted(own, key=lambda r: r[4]):
                if not r[5]:
                    pairs.append([x - y for x, y in zip(best[6:], r[6:])])
                    weights.append(r[3])
                    gate.append(n % 3 == 0)
        pairs, weights, gate = np.array(pairs), np.array(weights), np.array(gate)
        w = learning.fit(pairs[~gate], weights[~gate], epochs=4)
        assert all(abs(audit[scope]["weights"][k] - w[k]) < 1e-9 for k in w)
        assert abs(audit[scope]["new_score"] - learning.mean_loss(pairs[gate], w)) < 1e-9 and abs(audit[scope]["incumbent_score"] - learning.mean_loss(pairs[gate], search.PRIOR)) < 1e-9
        alone = learning.promotion(found, empty, scope, as_of(), epochs=4, most=50)
        assert alone["decision"] == audit[scope]["decision"] and alone["weights"] == audit[scope]["weights"]
    kept = {r["scope"] for r in out["registry"].where("is_current and version = 1").collect()}
    assert kept == {k for k, r in audit.items() if r["decision"] == "promote"}
    assert learning.promotions(found.limit(0), empty, as_of())["audit"].count() == 0


def test_examples_hold_their_positive(spark):
    triples = spark.createDataFrame([("s", "q", 1, [2], 1.0, "x"), ("s", "p", 9, [2], 1.0, "x")], "scope string, query string, positive long, negatives array<long>, weight double, signal string")
    pools = spark.createDataFrame([("s", q, i, float(i), 0.0, 0.0, 0.0, 1) for q in "qp" for i in (1, 2)], "scope string, query string, id long, score double, vec_score double, fts_score double, importance double, tier int")
    got = {(r["query"], r["id"]): (r["is_positive"], r["f_score"], r["f_reuse"]) for r in learning.examples(triples, pools).collect()}
    assert got == {("q", 1): (True, 0.0, 1.0), ("q", 2): (False, 1.0, 0.0)}


def test_time_bounds_and_repairs(spark):
    one = lambda c: spark.range(1).select(c.cast("string")).first()[0]
    assert search.time_bound(None, "since") is search.time_bound("", "since") is None
    assert one(search.time_bound(86400.9, "since")) == "1970-01-02 00:00:00" and one(search.time_bound("2024-01-05", "until")) == "2024-01-05 00:00:00"
    for bad in (-1, "yesterday", [], True):
        with pytest.raises(ValueError):
            search.time_bound(bad, "since")
    raw = spark.createDataFrame([(bytearray(b"a\xef'b \xc3\xa9 \xff"),)], "raw binary")
    assert raw.select(text.repaired(F.col("raw"))).first()[0] == "a 'b é  "


def test_scanners(spark):
    tree = spark.createDataFrame([("AGENTS.md", "# Use\n" + "be careful with the store " * 3 + "\n# Short\nx\n"), ("CLAUDE.md", "## A\nshort\n## B\nshort too\n## C\nalso short, but many of them\n"), ("docs/adr/0007-use_spark.md", "Text of a decision without a heading, and it is long enough."), ("adr/x/y.md", "#  Keep logs \n" + "because " * 9), ("adr/x/y/z.md", "too deep " * 9), ("src/a.md", "no " * 40)], "path string, text string")
    assert sorted((r["title"], r["source"]) for r in files.agent_rows(tree).collect()) == [("Agent instructions / Use", "AGENTS.md"), ("Agent instructions: CLAUDE.md", "CLAUDE.md")]
    assert sorted(r["title"] for r in files.decision_rows(tree).collect()) == ["ADR: Keep logs", "ADR: use spark"]
    logs = spark.createDataFrame([("abcdef1\t60\tFix a\tb\nnot one\n1234567\t120\tAdd\n",)], "text string")
    assert [(r["commit"], r["subject"]) for r in files.commits(logs).collect()] == [("abcdef1", "Fix a\tb"), ("1234567", "Add")]


def test_pending_scopes_and_debounced_claims_equal_loops(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("", 4)], "scope string, n long")
    rows.write.parquet(f"{tmp_path}/in")
    seen = []
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    streams.consolidating(stream, lambda scopes: seen.extend(r["scope"] for r in scopes.collect()), f"{tmp_path}/log").awaitTermination()
    assert sorted(seen) == ["a", "b"]
    from recollect.plans import learning as plans

    found = sorted((r["scope"], r["claimed_at"]) for r in plans.stream_debounced(spark, SF).collect())
    expected, last = [], {}
    for r in spark.read.parquet(f"{SF}/events.parquet").select(F.col("user_id").cast("string").alias("scope"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).orderBy("t").collect():
        if r["scope"] not in last or r["t"] - last[r["scope"]] >= 6 * 3600 * 1_000_000:
            expected.append((r["scope"], r["t"]))
            last[r["scope"]] = r["t"]
    assert found == sorted(expected)



def test_benchmark_loaders_and_ctags(spark, tmp_path):
    import json

    from recollect.sources import benchmarks

    (tmp_path / "convo.json").write_text(json.dumps([{"dialogue_id": "d", "sessions": [{"session_id": "s1", "timestamp": "2024-01-02 03:04:05", "turns": [{"speaker": "A", "text": "hi"}, {"speaker": "B", "text": "yo"}]}], "qa": [{"question": "q?", "evidence_session_ids": ["s1"]}]}]))
    sessions, gold = benchmarks.convomem(spark, str(tmp_path / "convo.json"))
    s = sessions.withColumn("at", F.unix_seconds("at")).first()
    assert (s["question_id"], s["session_id"], s["at"], s["body"]) == ("d", "s1", 1704164645, "A: hi\nB: yo") and [(r["question"], r["session_id"]) for r in gold.collect()] == [("q?", "s1")]
    (tmp_path / "bench.json").write_text(json.dumps([{"tid": "t", "message_list": [[{"sid": 0, "user_message": "u", "assistant_message": "a", "time": "2024-01-02", "place": "x"}, {"sid": 1, "user_message": "v", "assistant_message": "b", "time": None, "place": None}]], "QA": {"question": "q", "target_step_id": [[1, 0]], "choices": {}, "ground_truth": "A"}}]))
    sessions, gold = benchmarks.membench(spark, str(tmp_path / "bench.json"))
    assert sorted((r["session_id"], r["body"]) for r in sessions.collect()) == [("0:0", "u\na"), ("0:1", "v\nb")] and [r["session_id"] for r in gold.collect()] == ["0:1"]
    (tmp_path / "tags.json").write_text("\n".join(json.dumps(x) for x in [{"_type": "ptag", "name": "V"}, {"_type": "tag", "name": "run", "path": "a.go", "line": 3, "kind": "func"}, {"_type": "tag", "name": "get", "path": "a.rs", "line": 4, "kind": "method", "scope": "Box"}, {"_type": "tag", "name": "Box", "path": "a.rs", "line": 1, "kind": "struct"}]))
    assert sorted((r["full_name"], r["symbol_type"], r["line"]) for r in files.ctags(spark, str(tmp_path / "tags.json")).collect()) == [("Box", "class", 1), ("Box.get", "method", 4), ("run", "function", 3)]


def test_code_search_decisions_and_jitter(spark):
    from recollect.operators import codeindex

    rows = aged(spark).withColumn("scope", F.lit("codeindex:p")).unionByName(aged(spark)).withColumn("tier", F.lit(1))
    got = codeindex.search_code(rows, [1.0, 0.0], ["x"], as_of(), "p", ignore_decay=True).collect()
    assert {r["scope"] for r in got} == {"codeindex:p"} and got[0]["id"] == 1
    said = spark.createDataFrame([("Use Spark", None), (" ", None), ("Keep it", "Title")], "content string, title string")
    from recollect.operators import store

    assert sorted((r["title"], r["scope"], r["kind"]) for r in store.captured_decisions(said, F.lit("u")).collect()) == [("Title", "user:u", "decision"), ("Use Spark", "user:u", "decision")]
    pool = spark.createDataFrame([(i, "k", float(i), 0.0, 0.0, 0.0, 1, 0) for i in range(5)], "id long, kind string, score double, vec_score double, fts_score double, importance double, tier int, reuse_count long")
    plain, moved = ({r["id"]: r["rerank"] for r in search.rerank_learned(pool, ["kind"], {"score": 1.0}, jitter=j, seed=4).collect()} for j in (0.0, 0.1))
    assert all(0 <= moved[i] - plain[i] <= 0.1 for i in plain) and moved != plain


def test_hosted_rerankers_and_versions(spark):
    seen = []
    tei = models.ServiceReranker(lambda x: seen.append(x) or [{"index": 1, "score": 0.9}, {"index": 0, "score": None}])
    assert tei("q", ["a", "b"]) == [(1, 0.9), (0, 0.0)] and seen[0]["texts"] == seen[0]["documents"] == ["a", "b"] and "model" not in seen[0]
    assert models.ServiceReranker(lambda x: {"results": [{"index": 0, "relevance_score": 0.5}]}, "m")("q", ["a"]) == [(0, 0.5)]
    with pytest.raises(ValueError):
        models.ServiceReranker(lambda x: {"error": "busy"})("q", ["a"])
    rows = [("s", "reranker", v, {"score": float(v)}, 0.1 * v, v == 3) for v in (1, 2, 3)] + [("t", "reranker", 1, {"score": 9.0}, 0.5, True)]
    registry = spark.createDataFrame(rows, "scope string, kind string, version int, weights map<string,double>, score double, is_current boolean").withColumns({"note": F.lit(None).cast("string"), "created_at": as_of()})
    assert [r["version"] for r in learning.versions(registry, "s").collect()] == [3, 2, 1]
    moved = learning.made_current(registry, "s", 1)
    assert {(r["scope"], r["version"]) for r in learning.current_weights(moved).collect()} == {("s", 1), ("t", 1)}
    with pytest.raises(ValueError):
        learning.made_current(registry, "s", 7)
