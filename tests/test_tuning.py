"""The curve of hits over all blends against blends tried one by one."""

import numpy as np
from pyspark.sql import functions as F

from recollect import staging
from recollect.operators import tuning


def pools(seed=2, queries=40):
    rng = np.random.default_rng(seed)
    rows, gold = [], []
    for q in range(queries):
        n = int(rng.integers(0, 13))
        ids = rng.permutation(100)[:n].tolist()
        v, f = rng.random(n), rng.integers(0, 5, n) / 4
        if q % 5 == 0:
            v = np.round(v, 1)  # ties
        rows += [(q, i, float(a), float(b)) for i, a, b in zip(ids, v, f)]
        gold += [(q, int(i)) for i in rng.permutation(100)[:3]] + [(q, ids[0])] * (n > 0 and q % 3 == 0)
    return rows, gold


def rank_at(rows, gold, q, b):
    own = sorted((r for r in rows if r[0] == q), key=lambda r: (-((1 - b) * r[2] + b * r[3]), r[1]))
    return next((k for k, r in enumerate(own, 1) if (q, r[1]) in gold), None)


def test_curve_equals_blends_tried_one_by_one(spark):
    rows, gold = pools()
    asked = sorted({q for q, _ in gold})
    scored = spark.createDataFrame(rows, "query_id long, id long, vec_n double, fts_n double")
    pieces = staging.staged(tuning.rank_pieces(scored, spark.createDataFrame(gold, "query_id long, id long")), "test")
    by = {}
    for r in pieces.collect():
        by.setdefault(r["query_id"], []).append(r)
    assert sorted(by) == asked
    for q, own in by.items():
        own.sort(key=lambda r: (r["lo"], r["hi"]))
        assert own[0]["hi"] == 0 and own[-1]["lo"] == 1 and own[1]["lo"] == 0 and own[-2]["hi"] == 1
        assert all(a["hi"] == b["lo"] for a, b in zip(own[1:-2], own[2:-1]))
        for r in own:
            assert r["rank"] == rank_at(rows, set(gold), q, (r["lo"] + r["hi"]) / 2), (q, r)
    for k in (1, 3):
        found = sorted((tuple(r) for r in tuning.curve(pieces, k).collect()))
        inner = [x for x in found if x[0] < x[1]]
        assert inner[0][0] == 0 and inner[-1][1] == 1 and all(a[1] == b[0] and a[2] != b[2] for a, b in zip(inner, inner[1:]))
        hits = lambda b: sum((rank_at(rows, set(gold), q, b) or 99) <= k for q in asked)  # noqa: B023, E731
        for lo, hi, n in found:
            assert n == hits((lo + hi) / 2)
        lo, hi, n = tuning.best(tuning.curve(pieces, k)).first()
        assert n == max(x[2] for x in found) and n >= max(hits(b) for b in np.linspace(0.001, 0.999, 60))
        left = {r["query_id"]: r for r in tuning.leave_one_out(pieces, tuning.curve(pieces, k), k).collect()}
        assert sorted(left) == asked
        for q in asked:
            own = lambda b: (rank_at(rows, set(gold), q, b) or 99) <= k  # noqa: B023, E731
            cuts = sorted({x[0] for x in inner} | {r["lo"] for r in by[q] if r["lo"] < 1})
            rest = [(hits((a + b) / 2) - own((a + b) / 2), -a) for a, b in zip(cuts, [*cuts[1:], 1.0])]
            most, at = max(rest)
            assert abs(left[q]["blend"] + at) < 1e-12
            nxt = min((c for c in [*cuts, 1.0] if c > -at))
            assert left[q]["hit"] == own((-at + nxt) / 2)
    empty = pieces.where("query_id < 0")
    assert tuning.curve(empty, 1).count() == 0


def test_a_query_without_a_pool_has_no_rank(spark):
    scored = spark.createDataFrame([], "query_id long, id long, vec_n double, fts_n double")
    got = tuning.rank_pieces(scored, spark.createDataFrame([(4, 1)], "query_id long, id long"))
    assert sorted(map(tuple, got.collect())) == [(4, 0.0, 0.0, None), (4, 0.0, 1.0, None), (4, 1.0, 1.0, None)]
    assert tuning.curve(got, 1).agg(F.sum("hits")).first()[0] == 0
