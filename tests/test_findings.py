"""Queries on tables that are larger or odder than the fixtures."""

import numpy as np
import pytest
from oracle import SF, TABLES, connection, same
from pyspark.sql import functions as F

from recollect.operators import greedy
from recollect.plans import jobs, knowledge, learning, memory, registry, reports, retrieval, rules  # noqa: F401


def tables(spark, tmp_path, **changed):
    """A folder of the fixtures' tables, but for the changed ones, and a connection to it."""
    for t in TABLES:
        (changed[t].write.parquet(f"{tmp_path}/{t}.parquet") if t in changed else (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet"))
    c = connection()
    for t in changed:
        c.execute(f"create or replace view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    return str(tmp_path), c


def test_digest_clusters_takes_scopes_of_over_500_rows(spark, tmp_path):
    own = spark.read.parquet(f"{SF}/embeddings.parquet").withColumn("label", F.lit(0))
    many = own.crossJoin(spark.range(12).toDF("k")).select((F.col("vec_id") + F.col("k") * 6000).alias("vec_id"), "label", "embedding")
    sf, c = tables(spark, tmp_path, embeddings=many)
    assert many.where("vec_id % 10 <> 0 and vec_id % 12 < 3").count() > 500
    same(registry.QUERIES["digest_clusters"](spark, sf).toPandas(), c.execute(registry.SQL["digest_clusters"]).df())


def test_lsh_top_writes_no_pairs_and_equals_sql(spark, tmp_path, monkeypatch):
    """Large buckets cut into several cells, equal vectors, zero and null ones."""
    from recollect.operators import search

    own = spark.read.parquet(f"{SF}/embeddings.parquet")
    many = own.crossJoin(spark.range(3).toDF("k")).select((F.col("vec_id") + F.col("k") * 6000).alias("vec_id"), "embedding", "label")
    sf, c = tables(spark, tmp_path, embeddings=many)
    monkeypatch.setattr(search, "CELL_ROWS", 50, raising=False)
    found = registry.QUERIES["lsh_bucket_union"](spark, sf)
    same(found.toPandas(), c.execute(registry.SQL["lsh_bucket_union"]).df())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "query_id" not in plan.split("FlatMapGroupsInArrow", 1)[1].split("\n", 1)[1]
    rows = spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, None]), (4, None)], "id long, v array<float>").withColumn("keys", F.array(F.lit("one")))
    got = search.lsh_top(rows.where("id in (0, 2)"), rows, "id", "v", "keys", 2).collect()
    assert sorted((r["query_id"], r["id"], r["similarity"], r["rank"]) for r in got) == [(0, 1, 0.0, 1), (0, 2, 0.0, 2), (2, 0, 0.0, 1), (2, 1, 0.0, 2)]


def test_promotion_harvests_once_and_by_ids(spark, monkeypatch):
    """Candidates aren't carried through the choice of the latest retrievals, and training reads examples that are written once, of the triples it takes alone."""
    from recollect.operators import learning as own
    seen = []
    monkeypatch.setattr(own, "promotions", lambda found, *_, **options: seen.append((found, options)) or {"audit": found})
    jobs._promotions(spark, SF)
    assert all("recollect-examples" in f for f in seen[0][0].inputFiles())
    every = jobs._examples(spark, SF).withColumn("scope", F.concat(F.lit("shop"), (F.col("positive") % 20).cast("string")))
    taken = own.numbered(every).select("scope", "query", "positive")
    expected = every.join(taken, ["scope", "query", "positive"], "left_semi")
    assert sorted(map(repr, seen[0][0].select(expected.columns).collect())) == sorted(map(repr, expected.collect()))


def test_code_rows_broadcasts_no_files(spark):
    plan = registry.QUERIES["code_rows"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("few", [False, True])
def test_cells_of_large_groups_read_files(spark, monkeypatch, few):
    """A large group's vectors are written once, not to each of its cells; both are the loop's clusters."""
    monkeypatch.setattr(greedy, "CLASS_ROWS", 40)
    monkeypatch.setattr(greedy, "CLASS_BYTES", 40 * 4 * 6)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 6))
    x = base[rng.integers(0, 60, 600)] + rng.normal(size=(600, 6)) * 0.3
    rows = [(i, "hot" if i % 10 else "small", int(p), v.tolist()) for i, (p, v) in enumerate(zip(rng.permutation(600), x))]
    state = greedy.stored(spark.createDataFrame(rows, "id long, grp string, pos long, v array<double>"), "v").withColumn("leads", (F.col("pos") % 4 != 0) if few else F.lit(False))
    asking = state.where("not leads").count()
    near, folder = greedy._near(state, asking, 600, 0.8)
    asks = state.where("grp = 'hot' and not leads").count() if few else 0
    assert folder and spark.read.parquet(folder).count() == 540 + asks  # 14 classes, a copy of each row in one of them
    first = {(r["grp"], r["pos"]): r["first"] for r in near.groupBy("grp", "pos").agg(F.min("first").alias("first")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    expected = {}
    for i, grp, p, _ in rows:
        own = [q for j, g, q, _ in rows if g == grp and q < p and u[i] @ u[j] >= 0.8]
        if own and not (few and p % 4):
            expected[grp, p] = min(own)
    assert first == expected


def test_lsh_topk_misses_no_near_rows(spark, tmp_path):
    """Near copies, of which buckets miss some though ten others are very near, and equal and parallel vectors, whose ties go by id."""
    own = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 200")
    x = [(r["vec_id"], np.array(r["embedding"])) for r in own.collect()]
    rng = np.random.default_rng(3)
    moved = lambda v, s: v / np.linalg.norm(v) + rng.normal(size=len(v)) * s / 8
    rows = [(i + 6000 * k, (v if k < 2 else v * 2 if k == 2 else moved(v, k / 50)).astype("f4").tolist(), 0) for i, v in x for k in range(15)]
    sf, c = tables(spark, tmp_path, embeddings=spark.createDataFrame(rows, own.schema))
    expected = c.execute(registry.SQL["lsh_topk"]).df()
    for name in ("lsh_topk", "vector_topk_batch"):
        same(registry.QUERIES[name](spark, sf).toPandas(), expected)


def test_promotion_takes_all_examples_of_a_scope(spark, tmp_path, monkeypatch):
    """2,100 examples of one scope: over the 1,000 that were taken before; in batches and pieces that cut examples, as in one piece."""
    from recollect.operators import learning as own, search
    from recollect.plans.fixtures import as_of
    from recollect.schema import WEIGHTS

    rng = np.random.default_rng(5)
    rows = [("s" if q < 2100 else "few", f"q{q:04}", 1, 1.0 + q % 2, i, i == 1, *rng.random(6).round(2).tolist()) for q in range(2110) for i in ((1,) if q % 50 == 7 else range(3))]
    features = ", ".join(f"f_{k} double" for k in search.FEATURES)
    found = spark.createDataFrame(rows, f"scope string, query string, positive long, weight double, id long, is_positive boolean, {features}").repartition(3)
    now = {k: 0.1 * i for i, k in enumerate(search.FEATURES[:4])}
    known = spark.createDataFrame([(1, "s", "reranker", 1, now, None, None, True, None)], WEIGHTS).drop("id")
    monkeypatch.setattr(own, "PIECE_BYTES", 1000, raising=False)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = {r["scope"]: r for r in own.promotions(found, known, as_of(), epochs=2)["outcome"].collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {k: (r["n_train"], r["n_gate"], r["decision"] == "skip") for k, r in out.items()} == {"s": (1400, 700, False), "few": (7, 3, True)}
    by = {}
    for r in rows:
        by.setdefault(r[1], {})[r[4]] = r
    pairs = [(n % 3 == 0, by[q][1][3], np.subtract(by[q][1][6:], by[q][i][6:])) for n, q in enumerate(sorted(by)[:2100], 1) for i in (0, 2) if i in by[q]]
    d, weights, gate = np.array([p[2] for p in pairs]), np.array([p[1] for p in pairs]), np.array([p[0] for p in pairs])
    w = own.fit(d[~gate], weights[~gate], epochs=2)
    assert all(abs(out["s"]["weights"][k] - w[k]) < 1e-9 for k in w)
    assert abs(out["s"]["new_score"] - own.mean_loss(d[gate], w)) < 1e-9 and abs(out["s"]["incumbent_score"] - own.mean_loss(d[gate], now)) < 1e-9


def test_leading_directions_leave_out_no_near_pair(monkeypatch):
    """Few pairs are within the bound, and each that is near, or as near as doubles tell, is found; the first of a row and of a column."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 64))
    y = np.concatenate([rng.normal(size=(500, 64)), x[:400] + rng.normal(size=(400, 64)) * rng.uniform(0.2, 0.5, size=(400, 1)), x[300:340]])[rng.permutation(940)]
    x, y = (greedy.units(np.concatenate([v, np.ones((30, 64)) + rng.normal(size=(30, 64)) * 0.01])) for v in (x, y))
    near = x @ y.T >= 0.95
    first = lambda m: np.where(m.any(1), m.argmax(1), -1)
    asked = []
    exact = lambda i, j: asked.append(len(i)) or np.einsum("ij,ij->i", x[i], y[j])
    a, b = x.astype("f4"), y.astype("f4")
    p, q, rounding = greedy._turned(a, b)
    within = p @ q.T >= -0.05 - rounding
    assert p.shape[1] < 64 / 2 and (within | ~near).all() and (p @ q.T >= (x @ y.T - 1) - rounding).all() and within.mean() < 0.05
    leaves = []
    monkeypatch.setattr(greedy, "_reaching", lambda *a, f=greedy._reaching: leaves.append(f(*a)) or leaves[-1])
    for least, sparse, leaf_rows in ((1, 1.0, 1024), (1, 0.001, 1024), (1, 1.0, 60), (1, 0.001, 60), (1 << 40, 1.0, 60)):
        monkeypatch.setattr(greedy, "LEAST_PAIRS", least)
        monkeypatch.setattr(greedy, "LEAF_ROWS", leaf_rows)
        monkeypatch.setattr(greedy, "SPARSE", sparse)
        to, fro = greedy._earliest(a, b, 0.95, exact)
        assert (to == first(near)).all() and (fro == first(near.T)).all()
    assert len(leaves) == 1 + 1 + 16 + 16 and max(map(len, leaves[2:])) < len(x)


def test_rows_near_early_leaders_meet_no_others(spark, monkeypatch):
    """Large groups settle their earliest rows first; what is left is near none of their leaders, and the clusters are the loop's, by cells and by files."""
    from test_greedy import brute, found

    rng = np.random.default_rng(8)
    base = rng.normal(size=(30, 6))
    x = base[rng.integers(0, 30, 900)] + rng.normal(size=(900, 6)) * 0.3
    rows = [(i, ("hot", "warm", "small")[0 if i % 3 else 1 if i % 6 else 2], int(p), v.tolist() if i % 50 else None) for i, (p, v) in enumerate(zip(rng.permutation(900), x))]
    expected = brute(rows, 0.8)
    monkeypatch.setattr(greedy, "EARLY_ROWS", 145, raising=False)
    monkeypatch.setattr(greedy, "EARLY", 6, raising=False)
    for class_rows in (4096, 9):
        monkeypatch.setattr(greedy, "CLASS_ROWS", class_rows)
        monkeypatch.setattr(greedy, "CLASS_BYTES", class_rows * 4 * 6)
        assert found(spark, rows, 0.8) == expected
    state = greedy.stored(spark.createDataFrame(rows, "id long, grp string, pos long, v array<double>"), "v").where("data is not null").withColumn("leads", F.lit(False))
    told, rest = greedy._early(state.select("grp", "dim", "data", "id", "pos", "leads"), 0.8)
    left = {r["id"] for r in rest.where("grp = 'hot'").collect()}
    assert told and 0 < len(left) < 400 and all(expected["hot", i] in left for i in left)
