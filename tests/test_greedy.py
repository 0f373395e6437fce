"""Greedy clusters in rounds against the loop that defines them, and the embedder that counts bytes against one that counts tokens."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.functions import vectors
from recollect.operators import greedy, lifecycle


def brute(rows, threshold):
    leaders, out = {}, {}
    for id_, grp, pos, v in sorted(rows, key=lambda r: (r[1] or "", r[2])):
        out[grp, id_] = id_
        if v is None or None in v or not np.isfinite(v).all() or not np.any(v):
            continue
        u = np.array(v) / np.abs(v).max()
        u /= np.linalg.norm(u)
        own = leaders.setdefault((grp, len(v)), [])
        hit = next((k for k, w in own if w @ u >= threshold), None)
        if hit is None:
            own.append((id_, u))
        else:
            out[grp, id_] = hit
    return out


def found(spark, rows, threshold):
    df = spark.createDataFrame(rows, "id long, scope string, n long, embedding array<double>").repartition(3)
    got = lifecycle.leader_clusters(df, threshold, "n").collect()
    assert len(got) == len(rows) and all(r["is_pivot"] == (r["id"] == r["cluster_id"]) for r in got)
    return {(r["scope"], r["id"]): r["cluster_id"] for r in got}


@pytest.mark.parametrize("rows_of_class", [7, 4096])
def test_rounds_equal_the_loop(spark, monkeypatch, rows_of_class):
    monkeypatch.setattr(greedy, "CLASS_ROWS", rows_of_class)
    monkeypatch.setattr(greedy, "CLASS_BYTES", rows_of_class * 4 * 6)
    monkeypatch.setattr(greedy, "STRIPE", 5)
    rng = np.random.default_rng(2)
    rows, n = [], 0
    place = rng.permutation(1000).tolist()

    def add(grp, v):
        nonlocal n
        rows.append((n, grp, place[n], None if v is None else [None if x is None else float(x) for x in v]))
        n += 1

    for i in range(120):
        add("hot", rng.normal(size=6))
    ball = rng.normal(size=6)
    for i in range(150):  # a dense group and copies of one vector
        add("hot", ball + rng.normal(size=6) * 0.05)
        if i % 3 == 0:
            add("hot", ball)
    for a in np.linspace(0, 3, 60):  # a chain
        add("chain", [np.cos(a), np.sin(a)])
    for i in range(40):
        add(f"s{i % 5}" if i % 7 else None, rng.integers(-3, 4, size=4))
    for v in ([0.0] * 6, None, [], [None] * 6, [float("nan")] * 6, [float("inf")] * 6, [1e-200] * 6, [1e200] * 6, [1.0] * 6, [1.0] * 5):
        add("hot", v)
    for threshold in (0.95, 0.6):
        assert found(spark, rows, threshold) == brute(rows, threshold)
    assert found(spark, rows[:0] or [], 0.9) == {}


def test_pairs_at_the_threshold_are_decided_in_double(spark):
    low, high = ((0.95 + d) for d in (-1e-9, 1e-9))
    rows = [(0, "a", 0, [1.0, 0.0]), (1, "a", 1, [low, float(np.sqrt(1 - low**2))]), (2, "b", 0, [1.0, 0.0]), (3, "b", 1, [high, float(np.sqrt(1 - high**2))])]
    assert found(spark, rows, 0.95) == {("a", 0): 0, ("a", 1): 1, ("b", 2): 2, ("b", 3): 2}


def test_a_hot_scope_is_many_tasks(spark):
    rows = spark.range(20000).select("id", F.lit("one").alias("grp"), F.col("id").alias("pos"), F.array(F.rand(1) - 0.5, F.rand(2) - 0.5, F.rand(3) - 0.5).alias("v"))
    state = greedy.stored(rows, "v").where("data is not null").withColumns({"leads": F.lit(False), "leader": F.lit(None).cast("long")})
    cells = greedy._cells(state, 20000, 20000).groupBy("i", "j").count().collect()
    assert len(cells) >= 4 and max(r["count"] for r in cells) < 2.2 * 20000 / np.sqrt(8)


def test_vectors_are_stored_without_loss():
    x = np.array([[1.0, -127.0], [128.0, 0.0], [0.5, 0.25], [1 / 3, 1e300], [0.0, 0.0], [np.inf, 1.0]])
    data = greedy.packed(x)
    assert [d and d[0] for d in data] == [1, 2, 4, 8, None, None] and (greedy.unpacked(data[:4]) == x[:4]).all()


def djb2(value, start=5381):
    for b in value.encode():
        start = (start * 33 + b) % 2147483647
    return start


def test_counted_bytes_equal_counted_tokens(monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a", "B", "7", "zq", " ", "é", "-", "word", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, "", "x" * 300, "ab"]
    expected = np.zeros((len(texts), 13))
    for row, value in enumerate(texts):
        for w, n in Counter(re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), value or ""))).items():
            for token in [f"g:{f' {w} '[i : i + 3]}" for i in range(len(w))] + ([f"w:{w}"] if len(w) > 1 else []):
                h = djb2(token)
                expected[row, h % 13] += n if djb2("#sign", h) % 2 == 0 else -n
    for most in (8 << 20, 40):
        monkeypatch.setattr(vectors, "AT_ONCE", most)
        assert (vectors.token_sums_of(texts, 13) == expected).all()
