"""Indexes with bounds: they give what a full scan gives, from a part of the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect import staging
from recollect.functions import fts
from recollect.operators import blockmax, codes, search


@pytest.mark.parametrize("kind, few", [("float", 2048), ("double", 10)])
def test_codes_give_the_rows_of_a_full_scan(spark, monkeypatch, kind, few):
    monkeypatch.setattr(search, "FEW", few)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 24)) * rng.lognormal(size=(900, 1))
    x[50:60] = x[50]  # ties
    x[60] = 0
    rows = [(i, f"g{i % 2}", v.tolist()) for i, v in enumerate(x)] + [(901, "g0", None), (902, "g1", [1.0, 2.0]), (903, "g1", [2.0, 4.1]), (904, "g0", [1e-3] * 24)]
    df = spark.createDataFrame(rows, f"id long, scope string, v array<{kind}>").repartition(4)
    q = df.where("id % 20 = 0 or id > 900")
    for group in (None, F.col("scope")):
        index = staging.staged(codes.index(df, "id", "v", group), "test")
        key = lambda r: (r["query_id"], r["rank"], r["id"], round(r["similarity"], 9))
        expected = sorted(key(r) for r in search.batch_top(q, df, "id", "v", 7, group).collect())
        by: dict = {}
        for a in (r for r in rows if r[2] and (r[0] % 20 == 0 or r[0] > 900)):
            for b in (r for r in rows if r[2] and r[0] != a[0] and len(r[2]) == len(a[2]) and (group is None or r[1] == a[1])):
                u, v = (np.array(z[2], dtype="f4" if kind == "float" else "f8").astype(float) for z in (a, b))
                size = np.linalg.norm(u) * np.linalg.norm(v)
                by.setdefault(a[0], []).append((-(u @ v / size if size else 0.0), b[0]))
        assert {i: sorted(-s for s, _ in sorted(own)[:7]) for i, own in by.items()} == {i: pytest.approx(sorted(e[3] for e in expected if e[0] == i), abs=1e-8) for i in by}
        assert sorted(key(r) for r in codes.top(q, df, index, "id", "v", 7, group).collect()) == expected
        share = codes.bounded(q, index, "id", "v", 7, group).count() / (q.count() * df.count())
        assert share < 0.05


def test_bounds_hold_for_every_row():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(300, 33)), np.eye(33), np.zeros((1, 33)), np.full((1, 33), 1e-160), rng.normal(size=(50, 33)) ** 9])
    code, step, error = codes.encode(x)
    with np.errstate(all="ignore"):
        size = np.linalg.norm(x, axis=1)[:, None]
        unit = np.where(size > 0, x / size, 0.0)
    q = rng.normal(size=(40, 33))
    q /= np.linalg.norm(q, axis=1)[:, None]
    assert (np.abs(q @ unit.T - q @ (code * step[:, None].astype(float)).T) <= error + 1e-12).all() and code.dtype == np.int8


def texts(n=700):
    rng = np.random.default_rng(5)
    words = np.array(["alpha", "beta", "gamma", "common", *[f"w{i}" for i in range(200)]])
    p = np.array([0.02, 0.01, 0.005, 0.2] + [0.765 / 200] * 200)
    return [(i, " ".join(rng.choice(words, int(rng.pareto(1.0) * 20) + 1, p=p))) for i in range(n)] + [(9000, None), (9001, ""), (9002, "the of and")]


@pytest.mark.parametrize("query", ["common", "common alpha", "alpha beta gamma", "common common", "gamma missing", "the of", ""])
def test_blocks_give_the_rows_of_all_postings(spark, query):
    df = spark.createDataFrame(texts(), "id long, body string").repartition(4)
    index = blockmax.build(df, "id", F.col("body"), block_rows=16)
    whole = fts.ranked(fts.postings(df, "id", F.col("body")), "id", query).orderBy(F.col("fts_score").desc(), "id")
    for k in (1, 5, 2000):
        assert [tuple(r) for r in blockmax.top(index, "id", query, k, first=3).collect()] == [tuple(r) for r in whole.limit(k).collect()]


def test_most_blocks_of_a_frequent_term_are_skipped(spark):
    df = spark.createDataFrame(texts(), "id long, body string").repartition(4)
    index = blockmax.build(df, "id", F.col("body"), block_rows=16)
    found = blockmax.bounds(index, "common alpha").count()
    read = [x.count() for x in blockmax.read_blocks(index, "id", "common alpha", 5, first=3)]
    assert read[0] == 3 and sum(read) < found / 2
    score = fts.ranked(index.postings, "id", "common alpha").join(index.postings.select("id", "block").distinct(), "id").groupBy("block").agg(F.max("fts_score").alias("score"))
    assert score.join(blockmax.bounds(index, "common alpha"), "block").where("score > bound").count() == 0


def test_an_empty_index(spark):
    df = spark.createDataFrame([], "id long, body string")
    assert blockmax.top(blockmax.build(df, "id", F.col("body")), "id", "alpha", 3).count() == 0
