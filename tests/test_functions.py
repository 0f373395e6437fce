from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.functions import fts, scores, text, timewindow, vectors

NOW = datetime(2024, 3, 15, 12)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("query", "since", "until"),
    [
        ("what did I do today", "2024-03-15 00:00:00", "2024-03-15 23:59:59"),
        ("yesterday's call", "2024-03-14 00:00:00", "2024-03-14 23:59:59"),
        ("recently", "2024-02-14 12:00:00", "2024-03-15 12:00:00"),
        ("in the last 3 days", "2024-03-12 12:00:00", "2024-03-15 12:00:00"),
        ("last 2 weeks", "2024-03-01 12:00:00", "2024-03-15 12:00:00"),
        ("last week", "2024-03-01 12:00:00", "2024-03-08 12:00:00"),
        ("last month", "2024-02-01 00:00:00", "2024-02-29 23:59:58"),
        ("this year", "2024-01-01 00:00:00", "2024-12-31 23:59:58"),
        ("last winter", "2023-12-01 00:00:00", "2024-02-29 23:59:58"),
        ("in january", "2024-01-01 00:00:00", "2024-01-31 23:59:58"),
        ("in march", "2023-03-01 00:00:00", "2023-03-31 23:59:58"),
        ("back in 2022", "2022-01-01 00:00:00", "2022-12-31 23:59:58"),
        ("2021", "2021-01-01 00:00:00", "2021-12-31 23:59:58"),
    ],
)
def test_windows_of_time(query, since, until):
    w = timewindow.parse(query, NOW)
    stamp = lambda t: datetime.fromisoformat(t + "+00:00").timestamp()
    assert w.since == stamp(since) and abs(w.until - stamp(until)) <= 1
    assert w.half > 0 and abs(w.centre - (w.since + w.until) / 2) <= 1


@pytest.mark.parametrize("query", ["", None, "gin martini", "contain 2024x in 3024", "what is new"])
def test_no_window(query):
    assert timewindow.parse(query, NOW) is None


def test_tiers_and_scores(spark):
    for importance, tier in ((0.2, 0), (0.5, 1), (0.7, 2), (1.5, 3)):
        assert one(spark, scores.tier_of(F.lit(importance))) == tier
    assert one(spark, scores.escalated(F.lit(0.1), F.lit(8))) == pytest.approx(1 - 1 / 4.2)
    assert one(spark, scores.escalated(F.lit(0.9), F.lit(1))) == 0.9
    assert one(spark, scores.diminished(F.lit(5.0), F.lit(1.0))) == 1.0
    assert one(spark, scores.bumped(F.lit(0.4), F.lit(0.5))) == pytest.approx(0.55)
    assert one(spark, scores.bumped(F.lit(3.0), F.lit(0.5))) == 3.0
    assert one(spark, scores.importance_error(F.lit(99.0), F.lit(0.0))) is not None


def test_cosine(spark):
    a, b = [1.0, 2.0, 3.0], [2.0, 0.5, -1.0]
    expected = np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    assert one(spark, vectors.cosine(vectors.vector(a), vectors.vector(b))) == pytest.approx(expected)
    assert one(spark, vectors.cosine(vectors.vector([0.0, 0.0]), vectors.vector(b))) == 0
    assert one(spark, vectors.cosine(F.lit(None).cast("array<double>"), vectors.vector(b))) == 0


def test_hash_embedder_agrees_with_its_sparse_form(spark):
    said = "The Running runner ran, é 42 times"
    rows = spark.createDataFrame([(1, said)], "id long, body string")
    dense = np.zeros(vectors.DIM)
    for r in vectors.sparse_embedding(rows, "id", "body").collect():
        dense[r["bucket"]] = r["value"]
    assert np.allclose(dense / np.linalg.norm(dense), vectors.hash_embed(said))
    assert not vectors.hash_embed("").any()
    assert one(spark, text.djb2(F.lit("w:the"), vectors.EMBED_MODULUS)) == 277491129


def test_checksum_ignores_line_ends(spark):
    assert one(spark, text.source_checksum(F.lit("a\r\nb\rc"))) == one(spark, text.source_checksum(F.lit("a\nb\nc")))


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("running", "run"), ("relational", "relat"), ("hopping", "hop"), ("happy", "happi"), ("adjustable", "adjust"), ("electricity", "electr"), ("agreed", "agre"), ("sky", "sky")])
def test_stems(word, stem):
    assert fts.stem(word) == stem


def test_cover_density():
    assert fts.density("quick brown fox", fts.terms("brown quick")) == 1.0
    assert fts.density("quick red brown fox", fts.terms("quick brown")) == 0.5
    assert fts.density("quick fox", fts.terms("quick brown")) == 0.0
    assert fts.density("anything", []) == 0.0


def test_lsh_recall(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(50, 64))
    near = base + rng.normal(size=base.shape) * 0.15
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(np.concatenate([base, near]))], "id long, v array<float>")
    from recollect.operators import search

    keyed = rows.withColumn("keys", vectors.lsh_keys(F.col("v"), vectors.hyperplanes(64, 8, 12, 3)))
    found = {(r["query_id"], r["id"]) for r in search.lsh_top(keyed.where("id < 50"), keyed, "id", "v", "keys", 3).collect()}
    assert sum((i, i + 50) in found for i in range(50)) >= 45


def test_ranks_of_an_index_equal_those_of_texts(spark):
    import random

    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["running", "Cats", "the", "jumps", "x", "cat", "ran", "jump"]) for _ in range(rng.randint(0, 40)))) for i in range(200)] + [(900, None)]
    index = fts.postings(spark.createDataFrame(rows, "id long, body string"), "id", F.col("body"))
    for said in ("cat jumping", "cats", "run jump cat", "the", ""):
        wanted = fts.terms(said)
        found = {r["id"]: r["fts_score"] for r in fts.ranked(index, "id", said).collect()}
        expected = {i: fts.density(t or "", wanted) for i, t in rows}
        assert found == {i: pytest.approx(x) for i, x in expected.items() if x}


def test_paraphrases(spark):
    from recollect.functions import paraphrase

    rows = [("I Bought a car in Oslo, with Bob.",), ("Nothing here",), ("the The of",), (None,), ("",), ("In it",), ("a b on c In d",), ("who said, \"good\" at home?",), ("é like\nthat!",)]
    df = spark.createDataFrame(rows, "said string").select("said", *[f(F.col("said")).alias(f.__name__) for f in paraphrase.RULES])
    got = {r["said"]: tuple(r)[1:4] for r in df.collect()}
    assert got["I Bought a car in Oslo, with Bob."] == ("I Purchased a vehicle in Oslo, with Bob.", "With Bob, i Bought a car in Oslo,.", "Bought car in Oslo, with Bob.")
    assert got["Nothing here"] == ("Specifically, Nothing here", "Regarding the topic, Nothing here", "Note: Nothing here")
    assert got["the The of"][2] == "" and got[""] == ("Specifically, ", "Regarding the topic, ", "Note: ") and got[None] == (None, None, None)
    assert got["In it"][1] == "Regarding the topic, In it" and got["a b on c In d"][1] == "In d, a b on c"
    assert got["who said, \"good\" at home?"][:2] == ("who stated, great\" at home?", "At home, who said, \"good\"?")
    assert got["é like\nthat!"] == ("enjoy\nthat!", "Regarding the topic, é like\nthat!", "like !")
    chain = paraphrase.varied(df.select("said"), "said", 4).where("said = 'Nothing here'").first()
    assert list(chain)[1:] == ["Specifically, Nothing here", "Regarding the topic, Specifically, Nothing here", "Regarding topic, Specifically, Nothing here", "Specifically, Regarding topic, Specifically, Nothing here"]
