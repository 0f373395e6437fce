"""Queries over the whole of their tables, held against loops."""

import numpy as np
import pandas as pd
import pytest
from oracle import SF

from recollect.functions import vectors
from recollect.operators import greedy, search, store
from recollect.plans import knowledge, learning, reports, retrieval


def test_lsh_topk_finds_the_nearest_rows(spark):
    rows = pd.read_parquet(f"{SF}/embeddings.parquet").sort_values("vec_id")
    ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_numpy()).astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    expected = set()
    for q in np.flatnonzero(ids % 20 == 0):
        s = u @ u[q]
        s[q] = -9
        expected |= {(int(ids[q]), int(ids[i])) for i in np.argsort(-s)[:10]}
    found = {(r["query_id"], r["id"]) for r in retrieval.lsh_topk(spark, SF).collect()}
    assert len(found) == len(expected) and len(found & expected) >= 0.9 * len(expected)


def test_lsh_answers_sure_queries_from_buckets(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(40, 64))
    x = np.concatenate([base] + [base[:20] + rng.normal(size=(20, 64)) * 0.05 for _ in range(4)])
    from pyspark.sql import functions as F

    planes = vectors.hyperplanes(64, 8, 12, 3)
    sure = search.sure_cosine(8, 12)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").withColumn("keys", vectors.lsh_keys(F.col("v"), planes))
    near = search.lsh_top(rows.where("id < 40"), rows, "id", "v", "keys", 3)
    assert near.where((F.col("rank") == 3) & (F.col("similarity") >= sure)).count() >= 19
    found = {(r["query_id"], r["rank"]): r["id"] for r in search.lsh_top_whole(rows.where("id < 40"), rows, "id", "v", "keys", 3, sure).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    right = sum(found.get((q, k + 1)) == int(np.argsort(-s[q])[k]) for q in range(40) for k in range(3))
    assert len(found) == 120 and right >= 0.95 * 120


def test_graph_components_of_all_lines_equal_union_find(spark):
    orders, lines = (pd.read_parquet(f"{SF}/{t}.parquet") for t in ("orders", "lineitem"))
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    of = dict(zip(orders["o_orderkey"], orders["o_custkey"]))
    for order, supplier in zip(lines["l_orderkey"], lines["l_suppkey"]):
        if order in of:
            a, b = find(int(of[order]) * 2), find(int(supplier) * 2 + 1)
            root[max(a, b)] = min(a, b)
    found = {r["id"]: r["component"] for r in retrieval.graph_components_whole(spark, SF).collect()}
    assert found == {x: find(x) for x in root}


@pytest.mark.parametrize("rows_of_class", [16, 2048])
def test_near_duplicates_equal_a_loop(spark, monkeypatch, rows_of_class):
    monkeypatch.setattr(greedy, "CLASS_ROWS", rows_of_class)
    monkeypatch.setattr(greedy, "CLASS_BYTES", rows_of_class * 4 * 384)
    rows = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    texts = dict(zip(rows["doc_id"].tolist(), rows["text"])) | {10**6: "...", 10**6 + 1: "...", 10**6 + 2: rows["text"].iloc[0] + " x"}
    kept: dict = {}
    expected = {}
    for i, said in texts.items():
        v = vectors.hash_embed(said)
        expected[i] = next((j for j, u in kept.items() if u @ v >= 0.95), i)
        if expected[i] == i:
            kept[i] = v
    df = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(3)
    found = store.first_of_near(df, "id", "text").collect()
    assert {r["id"]: r["kept_id"] for r in found} == expected and len(found) == len(expected)
    assert all(r["is_first"] == (r["id"] == r["kept_id"]) for r in found)
    assert sum(texts[i] != texts[j] for i, j in expected.items()) > 0


def test_hunks_get_symbols_of_all_lines(spark):
    orders, lines = (pd.read_parquet(f"{SF}/{t}.parquet") for t in ("orders", "lineitem"))
    of: dict = {}
    for path, number, part in zip(lines["l_suppkey"], lines["l_linenumber"], lines["l_partkey"]):
        of.setdefault(path, []).append((int(number) * 7 % 50, str(part)))
    expected = []
    for hunk, path in zip(orders["o_orderkey"], orders["o_custkey"]):
        own = sorted(x for x in of.get(path, []) if hunk % 40 <= x[0] <= hunk % 40 + 5 + hunk % 3 + 2)
        expected += [(hunk, name, line) for line, name in own[:10]]
    found = [tuple(r) for r in knowledge.hunk_attribution_whole(spark, SF).collect()]
    assert sorted(found) == sorted(expected)


def test_tier_promotions_see_evidence_of_all_lines(spark):
    lines = pd.read_parquet(f"{SF}/lineitem.parquet")
    suppliers = set(pd.read_parquet(f"{SF}/supplier.parquet")["s_suppkey"])
    parts = pd.read_parquet(f"{SF}/part.parquet")["p_partkey"]
    proven = {int(p) for s, p in zip(lines["l_suppkey"], lines["l_partkey"]) if s in suppliers and s % 6 >= 3 and s % 4 != 0}
    expected = {int(p) for p in parts if 3 <= p % 12 < 6 and p in proven}
    assert {r["id"] for r in learning.tier_promotion_whole(spark, SF).where("old_tier = 1").collect()} == expected


def test_context_cuts_orders_by_weight(spark):
    orders = pd.read_parquet(f"{SF}/orders.parquet")
    found = {r["scope"]: r["n"] for r in reports.context_whole(spark, SF).collect()}
    held = orders.groupby("o_custkey").size()
    assert set(found) == {str(k) for k in held.index}
    assert all(n > 1 for n in found.values()) and any(n - 1 < held[int(k)] for k, n in found.items())


def test_companions_of_all_turns(spark):
    events = pd.read_parquet(f"{SF}/events.parquet")["event_type"].value_counts()
    assert reports.preference_companions_whole(spark, SF).count() == 3 * events["click"] + events["view"]
