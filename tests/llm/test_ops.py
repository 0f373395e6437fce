"""Each operator against a brute-force version, an exact round trip or held-out labels, and on odd rows."""

import hashlib
import io
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from oracle import SF, connection, same
from pyspark.sql import functions as F

from recollect.llm import chatfmt, common, decontam, embdedup, langid, ngramjoin, packing, quality, queries, tokenfile, tokens, toxicity, urlfilter
from recollect.operators import graph

PATH = tokens.tokenizer_path()
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "word " * 9000), (5, "same text here again and again"), (5, "same text here again and again"), (6, "same text here again and again"), (7, "É<|endoftext|>x it's\x1cok 42 ΣΑΣ"), (None, "no id"), (8, "....!!??")]


def table(spark, rows=ODD, **extra):
    """documents with columns whose names the operators also use."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *[F.lit(v).alias(k) for k, v in ({"n": 1, "cid": 2, "score": 0.5, "rep": "x", "found": None, "lang": "en"} | extra).items()])


def whole(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_words_encode_as_whole_texts():
    texts = [t for _, t in ODD] + ["Don't, STOP. ä.ö, ß! İx é́ a\tb\x0bc 数.数, naïve.x, ﬁne ...,."]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.Encoder(PATH).encode(texts)] == [whole(t)[:-1] for t in texts]
    assert tokens.Encoder(PATH, drops_space=False).encode(texts[:3]) == tokens.Encoder(PATH).encode(texts[:3])


def test_best_fit_equals_a_loop():
    rng = random.Random(1)
    lengths = np.array([rng.randint(1, 40) for _ in range(300)])
    of, offset = packing.best_fit_decreasing(lengths, 40)
    rooms, expected = [], {}
    for i in sorted(range(300), key=lambda i: -lengths[i]):
        fits = [r for r in rooms if r >= lengths[i]]
        expected[i] = min(fits) if fits else 40
        if fits:
            rooms.remove(min(fits))
        rooms.append(expected[i] - lengths[i])
    assert all(40 - offset[i] == expected[i] for i in range(300)) and of.max() + 1 == len(rooms)


def test_packing_lays_every_id_once(spark):
    rows = packing.pack(table(spark), PATH, group_pieces=4).toPandas()
    assert (rows.groupby("sequence_id").length.sum() <= 2048).all()
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert (own.length.cumsum() - own.length).tolist() == own.offset.tolist()
    for doc_id, text in {(d, t) for d, t in ODD if d is not None}:
        ids, own = whole(text), rows[rows.doc_id == doc_id].sort_values("start")
        copies = sum(d == doc_id for d, _ in ODD)
        assert len(own) == copies * -(-len(ids) // 2048) and set(own.doc_tokens) == {len(ids)}
        assert all(r.ids_crc32 == crc(ids[r.start : r.start + r.length]) for r in own.itertuples())
    assert packing.pack(table(spark).where("doc_id > 99"), PATH).count() == 0


def test_packing_spreads_equal_rows_over_groups(spark):
    rows = table(spark, [(1, "same text")]).select("doc_id", "text").crossJoin(spark.range(0, 20000, 1, 4)).select("doc_id", "text")
    rows = packing.pack(rows, PATH, group_pieces=4000).withColumn("part", F.shiftright("sequence_id", 32)).groupBy("part").count().collect()
    assert len(rows) == 5 and max(r["count"] for r in rows) < 6000


def test_packing_pads_little(spark):
    rows = queries.QUERIES["op1_packing"](spark, "/root/testdata/sf0.01").toPandas()
    assert rows.length.sum() / (2048 * rows.sequence_id.nunique()) > 0.97


def test_token_file_round_trip(spark):
    folder = common.new_folder(spark, "test")
    files = tokenfile.write(table(spark), PATH, folder, shards=3)
    rows = sorted(tokenfile.read(spark, folder, files).collect(), key=lambda r: r["start"])
    expected = sorted(ODD, key=lambda r: -1 if r[0] is None else r[0])
    assert [r["doc_id"] for r in rows] == [d for d, _ in expected]
    at = 0
    for row, (_, text) in zip(rows, expected):
        ids = whole(text)
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)
    name = next(f["path"] for f in files if tokenfile.read_document(folder, f["path"], 7) is not None)
    assert tokenfile.read_document(folder, name, 7).tolist() == whole(ODD[7][1])
    empty = common.new_folder(spark, "test")
    assert tokenfile.read(spark, empty, tokenfile.write(table(spark).where("doc_id > 99"), PATH, empty, shards=2)).count() == 0


def test_token_file_frames_are_independent_and_checked(monkeypatch):
    import zstandard

    monkeypatch.setattr(tokenfile, "FRAME_IDS", 3)
    out = io.BytesIO()
    w = tokenfile.Writer(out)
    docs = [np.arange(n, dtype="<u4").tobytes() for n in (2, 7, 1)]
    for i, raw in enumerate(docs):
        w.add(i, raw)
    w.close()
    data = out.getvalue()
    reader = tokenfile.Reader(io.BytesIO(data), len(data))
    assert [reader.raw(i) for i in (2, 0, 1)] == [docs[2], docs[0], docs[1]] and len(reader.frames) == 5
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read() == b"".join(docs)
    broken = bytearray(data)
    broken[-9 - 12 * 5 + 8] ^= 1
    with pytest.raises(ValueError):
        tokenfile.Reader(io.BytesIO(bytes(broken)), len(broken)).raw(0)


def brute_contaminated(text, items):
    words = [m for m in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    hit, ids = set(), set()
    for item, other in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), other or ""))
        for at in range(max(1, len(own) - 9) if own else 0):
            w = own[at : at + 10]
            for i in range(len(words) - len(w) + 1):
                if words[i : i + len(w)] == w:
                    hit |= set(range(i, i + len(w)))
                    ids.add(item)
    return len(words), len(hit), sorted(ids)


def test_several_automata_meet_texts_held_together(monkeypatch):
    monkeypatch.setattr(decontam, "HELD_BYTES", 3000)
    items = object.__new__(decontam.Items)
    batches = [pa.RecordBatch.from_pydict({"doc_id": [i, i], "text": ["x" * 500] * 2}) for i in range(7)]
    for items.n_parts, sizes in ((1, [1] * 7), (2, [3, 3, 1])):
        assert [len(x) for x in items.held_together(iter(batches))] == sizes


@pytest.mark.parametrize("size", [1 << 20, 60, 1])
def test_decontamination_equals_brute_force(spark, size):
    rng = random.Random(2)
    long = " ".join(rng.choice("abcdé") for _ in range(30))
    items = [(1, long), (2, "Short Answer"), (3, ""), (4, None), (5, "a b, a b; a b a b a b a b a b"), (10, "short answer")]
    docs = [(1, None), (2, ""), (3, f"x {long.replace(chr(97), chr(65))} y"), (4, "a SHORT-answer; short answer"), (5, "a b " * 20), (6, " ".join(long.split()[:9])), (7, "clean"), (7, "a short answer")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.decontaminate(table(spark, docs), bench, automaton_bytes=size).collect()
    found = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows)
    expected = []
    for d, t in docs:
        n, hit, ids = brute_contaminated(t, [(str(i), x) for i, x in items])
        expected.append((d, n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0))
    assert found == sorted(expected)
    text = docs[3][1]
    assert [text[s["start"] : s["end"]] for r in rows if r["doc_id"] == 4 for s in r["spans"]] == ["SHORT-answer; short answer"]
    assert sorted(r["doc_id"] for r in decontam.keep(table(spark, docs), bench, automaton_bytes=size).collect()) == [1, 2, 6, 7]
    assert decontam.decontaminate(table(spark, docs), bench.where("item_id > 99")).where("contaminated").count() == 0


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    group = rng.normal(size=16) + rng.normal(size=(80, 16)) * 0.06
    chain = [base[0] * np.cos(a) + base[1] / np.linalg.norm(base[1]) * np.linalg.norm(base[0]) * np.sin(a) for a in np.linspace(0, 1, 6)]
    vectors = [*base, *group, *chain, base[5], base[5], group[0]]
    rows = [(i, x.astype("f4").tolist()) for i, x in enumerate(vectors)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, [1.0, 2.0]), (905, []), (906, [float("inf")] * 16), (906, vectors[3].astype("f4").tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cid", F.lit("x")).withColumn("cap", F.lit(1))
    u = np.array([x.astype("f4") for x in [*vectors, vectors[3]]], dtype=np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    ids = [*range(len(vectors)), 906]
    links = {(i, k): int(near[k].sum()) - 1 for k, i in enumerate(ids)}
    label = np.array(ids)
    while True:
        new = np.array([label[near[k]].min() for k in range(len(ids))])
        if (new == label).all():
            break
        label = new
    found = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embdedup.near_duplicates(df).collect())
    expected = [(i, links[i, k], int(label[k]), i == label[k]) for k, i in enumerate(ids)] + [(i, 0, i, True) for i in range(900, 907)]
    assert found == sorted(expected)
    assert embdedup.near_duplicates(df.where("vec_id < 0")).count() == 0


def test_double_vectors_are_compared_as_doubles(spark):
    a, b = [1.0, 0.0], [0.95, float(np.sqrt(1 - 0.95**2))]
    low = [0.95 - 1e-9, float(np.sqrt(1 - (0.95 - 1e-9) ** 2))]
    links = lambda *v: [r["n_links"] for r in embdedup.near_duplicates(spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")).orderBy("vec_id").collect()]
    tiny, huge = [1e-170, 1e-170, 2e-170], [1e200, 1e200, 2e200]
    assert links(tiny, tiny, huge, [5e-324, 0.0, 0.0], [0.0, 0.0, 0.0], [1e308, 1e308, 1.7e308]) == [3, 3, 3, 0, 0, 3]
    assert links(a, low) == [0, 0] and links(a, [b[0] + 1e-9, b[1]]) == [1, 1]


@pytest.mark.parametrize("n", [57_000, 1_000_000, 1_000_000_000])
def test_filters_recall_pairs_at_the_threshold(n):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    words, kept = int(np.ceil((embdedup.DIRECTIONS * n) ** (1 / embdedup.BLOCKS))), embdedup.kept_of(n)
    codes = [embdedup.Code(64, words, embdedup.SEED + i) for i in range(embdedup.CODES)]
    shared = np.zeros(len(x), bool)
    for c in codes:
        for at in range(0, len(x), 100):
            a, b = c.decode(x[at : at + 100], kept), c.decode(y[at : at + 100], kept)
            shared[at : at + 100] |= (a[:, :, None] == b[:, None, :]).any((1, 2))
    assert shared.mean() > 0.99


def test_quality_separates_junk(spark):
    got = queries.QUERIES["op4_quality"](spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    assert both[both.quality == 1].kept.mean() > 0.98 and (~both[both.quality == 0].kept).mean() > 0.85
    odd = quality.score(table(spark)).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    assert quality.keep(table(spark)).columns == table(spark).columns
    assert quality.score(table(spark).where("doc_id > 99")).count() == 0


def test_weak_labels_find_the_bad_labeller():
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.8
    votes = np.zeros((4000, len(quality.LABELLERS)), int)
    for j in range(5):
        right = rng.random(4000) < (0.55 if j == 4 else 0.9)
        votes[:, j] = np.where(truth == right, quality.GOOD, quality.BAD)
    patterns, counts = np.unique(votes @ 3 ** np.arange(len(quality.LABELLERS)), return_counts=True)
    weak = quality.WeakLabels(patterns, counts)
    found = list(weak.accuracies().values())
    assert abs(found[0] - 0.9) < 0.04 and found[4] < 0.65
    assert ((weak.posterior(votes @ 3 ** np.arange(len(quality.LABELLERS))) > 0.5) == truth).mean() > 0.95


def test_url_rules_equal_brute_force(spark):
    urls = [None, "", "example.com/en/", "http://com", "http://com/", "https://A.Example.COM/en/x?q#f", "http://www.example.com/en/", "http://m.www.example.com/en/y", "http://xexample.com/en/", "ftp://a.net/es/1", "http://net/fr/", "http://net/fr", "http://b.net/de/#/es/", "http://c.org?x=/", "a://b://c.net/es/", "http:///es/", "http://x.com/a\nb"]
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("net", "/fr/", "block"), ("org", "", "block"), (None, "/", "block")]

    def brute(url):
        url = url or ""
        rest = url.split("://", 1)[1] if "://" in url else None
        host = re.match(r"[^/?#]*", rest)[0] if rest is not None else ""
        path = re.match(r"[^?#]*", rest[len(host) :])[0] if rest is not None else ""
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h + p), len(h), h + p, a) for h, p, a in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        return host, path, best[2], best[3]

    rules += [("com", "x", "block"), ("a.net", "", "allow")]
    urls += ["http://" + "a." * 200_000 + "example.com/en/", "http://" + ".".join(["com"] * 200_000), "http://" + "." * 200_000, "http://comx/", "http://b.com/x", "http://comx", "http://a.netx/es/", "http://com/x?y"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("key", F.lit("x")).withColumn("host", F.lit("y"))
    r = spark.createDataFrame(rules, "host string, path string, action string")
    for most in (urlfilter.MOST_BITS, 1):
        found = {x["page_id"]: tuple(x)[1:] for x in urlfilter.judge(df, r, most_bits=most).collect()}
        assert found == {i: brute(u) for i, u in enumerate(urls)}
    assert urlfilter.judge(df.where("page_id < 0"), r).count() == 0
    assert {x["verdict"] for x in urlfilter.judge(df, r.where("host = '-'")).collect()} == {"allow"}


def test_long_lists_stay_in_the_cascade(spark, monkeypatch):
    for name, value in (("BITS_PER_KEY", 4), ("LEAST_BITS", 64), ("BUCKET_KEYS", 50), ("COPIES", 3)):
        monkeypatch.setattr(urlfilter, name, value)
    made = []
    monkeypatch.setattr(urlfilter.Buckets, "filters", lambda self, own=urlfilter.Buckets.filters: made.append(self) or own(self))
    rules = spark.range(800).select(F.format_string("h%d.com", F.col("id")).alias("host"), F.lit("/").alias("path"), F.when(F.col("id") % 4 == 0, "allow").otherwise("block").alias("action"))
    rules = rules.union(spark.createDataFrame([("com", "/", "allow"), ("h1.com", "/x", "allow"), ("a.h1.com", "/", "block")], "host string, path string, action string"))
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.format_string("http://%s.h%d.com/%s", F.when(F.col("id") % 2 == 0, "a").otherwise("b"), F.col("id") % 3000, F.when(F.col("id") % 7 == 0, "x").otherwise("y")).alias("url"))
    long, short = (sorted(map(tuple, urlfilter.judge(pages, rules, most_bits=most).collect())) for most in (1, 1 << 30))
    assert long == short and len(long) == 6000 and {x[4] for x in long} == {"allow", "block"}
    assert made[0].n == 16 and all(len(x) > 2 for x in made[0].levels.values())
    for i, host, path, rule, verdict in long:
        n = i % 3000
        own = "h1.com/x" if n == 1 and path == "/x" else f"h{n}.com/" if n < 800 else "com/"
        own = "a.h1.com/" if host == "a.h1.com" else own
        assert (rule, verdict) == (own, "allow" if own in ("com/", "h1.com/x") or (own != "a.h1.com/" and n < 800 and n % 4 == 0) else "block")


def test_cascade_is_exact_for_its_universe(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "BITS_PER_KEY", 2)
    monkeypatch.setattr(urlfilter, "LEAST_BITS", 64)
    universe = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = universe.where("cast(substring(key, 2, 9) as int) % 7 = 0")
    cascade = urlfilter.Cascade(listed, listed.count()).add_levels(universe)
    assert len(cascade.levels) > 2
    wrong = universe.select(cascade.has(F.col("key")).alias("has"), (F.expr("cast(substring(key, 2, 9) as int) % 7 = 0")).alias("is")).where("has != is")
    assert wrong.count() == 0
    assert urlfilter.Cascade(listed, listed.count()).add_levels(universe, most_bits=64) is None


def brute_components(texts):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    label = {i: i for i in sets}
    while True:
        before = dict(label)
        for a in sets:
            for b in sets:
                n = len(sets[a] & sets[b])
                if n and 100 * n >= 75 * len(sets[a] | sets[b]):
                    label[a] = min(label[a], label[b])
        if before == label:
            return {i: (len(sets[i]), label[i]) for i in sets}


def test_ngram_components_equal_brute_force(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    base = [word() for _ in range(60)]
    texts, passage = [], " ".join(word() for _ in range(55))
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(60)] = word()
        texts.append((i, " ".join(w)))
    texts += [(100 + i, f"{' '.join(word() for _ in range(40))} {passage} {word()}") for i in range(25)]
    texts += [(200, None), (201, ""), (202, "\u00a0 Two words"), (203, "\u00a0 two WORDS"), (204, "a b c d e"), (205, "A\tb c\nd e"), (206, texts[3][1])]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.jaccard_components(table(spark, texts)).collect()}
    assert found == brute_components(texts)
    kept = {r["doc_id"] for r in ngramjoin.keep(table(spark, texts)).collect()}
    assert kept == {i for i, (_, c) in found.items() if i == c}
    odd = ngramjoin.jaccard_components(table(spark)).collect()
    assert len(odd) == len(ODD) and {r["component_id"] for r in odd if r["doc_id"] in (5, 6)} == {5}
    assert ngramjoin.jaccard_components(table(spark).where("doc_id > 99")).count() == 0


def test_count_trees_find_every_pair_within_bounds():
    rng = np.random.default_rng(9)
    points = rng.poisson(2, size=(150, 6))
    points[75:] = points[:75] + (rng.random((75, 6)) < 0.05)
    n, comp, key = points.sum(1), np.arange(150) % 5, rng.integers(0, 4, 150)
    key[:2], key[75:] = 9, key[:75]
    order = np.concatenate([np.flatnonzero(key == k)[ngramjoin.tiled(points[key == k], comp[key == k])] for k in np.unique(key)])
    points, n, comp, key = points[order], n[order], comp[order], key[order]
    found = {(int(a), int(b)) for x, y in ngramjoin.CountTrees(key, points, n, comp).pairs() for a, b in zip(x, y)}
    expected = set()
    for a in range(150):
        for b in range(a + 1, 150):
            m = np.minimum(points[a], points[b]).sum()
            if key[a] == key[b] and comp[a] != comp[b] and 100 * min(n[a], n[b]) >= 75 * max(n[a], n[b]) and ngramjoin.links(m, n[a], n[b]):
                expected.add((a, b))
    assert found == expected and expected


def near_copies(rng, n=2000, words=60):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, texts = [word() for _ in range(words)], []
    for i in range(n):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3])):
            w[rng.randrange(words)] = word()
        texts.append((i, " ".join(w)))
    return texts


def test_large_group_of_near_copies_equals_brute_force(spark):
    texts = near_copies(random.Random(11)) + [(5000 + i, t) for i, t in near_copies(random.Random(12), 300, 20)]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.jaccard_components(table(spark, texts)).collect()}
    assert found == brute_components_fast(dict(texts))


def test_lists_over_a_block_and_hot_shingles_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "HOT", 40)
    monkeypatch.setattr(ngramjoin, "LEADER_LEAST", 10**6)
    rng = random.Random(13)
    texts = near_copies(rng, 150) + [(5000 + i, t) for i, t in near_copies(rng, 60, 20)]
    expected = brute_components_fast(dict(texts))
    for block in (7, 64):
        monkeypatch.setattr(ngramjoin, "BLOCK", block)
        found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.jaccard_components(table(spark, texts)).collect()}
        assert found == expected


def test_hubs_over_a_share_and_many_tasks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "HUB", 3)
    monkeypatch.setattr(ngramjoin, "FAN_IN", 2)
    texts = near_copies(random.Random(14), 400)
    docs = table(spark, texts).repartition(11, "doc_id")
    facts = docs.select(*ngramjoin._columns()).mapInArrow(ngramjoin._facts, ngramjoin.FACTS).persist()
    expected = np.zeros(1 << ngramjoin.CELL_BITS, np.int64)
    np.add.at(expected, np.concatenate([ngramjoin.shingles(t) for _, t in texts]) >> np.uint64(64 - ngramjoin.CELL_BITS), 1)
    assert facts.where("chunk is not null").select("mark").distinct().count() > 4
    assert (ngramjoin._cells(facts) == expected).all()
    facts.unpersist()
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.jaccard_components(docs).collect()}
    assert found == brute_components_fast(dict(texts))


def test_blocks_of_a_component_meet_all_others(spark):
    lists = spark.createDataFrame([(1, c) for c in range(90)] + [(2, c) for c in range(5)], "list long, cid long")
    points = spark.createDataFrame([(c, 10, b"", 500 if c < 60 else c) for c in range(90)], "cid long, n long, points binary, comp long").withColumn("firsts", F.array())
    by = {}
    for r in ngramjoin._blocks(lists, points, 8)[0].collect():
        by.setdefault(r["key"], []).append(r)
    met = {tuple(sorted((x["cid"], y["cid"]))) for own in by.values() for i, x in enumerate(own) for y in own[:i] if x["part"] < 0 or x["part"] != y["part"]}
    assert max(map(len, by.values())) < 40
    assert {(a, b) for a in range(90) for b in range(a + 1, 90) if b >= 60} <= met and (0, 1) in met


@pytest.mark.parametrize("turned", [False, True])
def test_keep_judges_a_repeated_doc_id_by_each_text(spark, turned):
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(3, a), (5, b), (5, a + " z"), (7, b), (7, b), (8, ""), (8, ""), (9, None), (None, b), (4, a.upper()), (3, a)]
    kept = ngramjoin.keep(table(spark, rows[::-1] if turned else rows)).select("doc_id", "text").collect()
    assert sorted(kept, key=str) == sorted([(3, a), (5, b), (8, ""), (8, ""), (9, None), (None, b)], key=str)
    assert ngramjoin.keep(table(spark).where("doc_id > 99")).count() == 0


def test_bound_holds_for_counts_over_a_byte():
    h = np.zeros(70000, np.uint64)
    points = ngramjoin.packed(h, ngramjoin.GROUPS)
    x = ngramjoin.unpacked([points, points], np.array([70000, 60000]))
    assert np.minimum(x[0], x[1]).sum() == 60000 == ngramjoin.wide_bound(points, ngramjoin.packed(h, 1024), 70000, 60000)


def test_language_of_held_out_texts(spark):
    got = queries.QUERIES["op7_language_id"](spark, "/root/testdata/sf0.01").toPandas()
    lang = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(lang, on="doc_id")
    assert (both[both.held_out].lang_pred == both[both.held_out].lang).mean() > 0.98
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    model = langid.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    odd = {r["doc_id"]: r for r in langid.identify(table(spark), model).collect()}
    assert [odd[i]["lang_pred"] for i in (1, 2, 3, 8)] == ["und"] * 4 and odd[1]["score"] == 0
    assert {r["lang_pred"] for r in langid.identify(table(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(table(spark).where("doc_id > 99")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 4, 6, 20])
def test_codewords_differ(n):
    code = langid.codewords(n)
    assert len({tuple(c) for c in code}) == n and (n < 3 or all((a != b).sum() >= 2 for i, a in enumerate(code) for b in code[i + 1 :]))


def test_hundreds_of_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_ALL", 64)
    docs = spark.createDataFrame([(i, f"word{i % 90} in tongue {i % 90}", f"l{i % 90:02}") for i in range(400)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert len(model.languages) == 90 and {r["lang_pred"] for r in langid.identify(docs, model).collect()} <= set(model.languages)


def test_a_full_filter_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "FILTER_BITS", 7)
    texts = near_copies(random.Random(17), 60)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.jaccard_components(table(spark, texts)).collect()}
    assert found == brute_components_fast(dict(texts))


def test_conversations_beyond_what_is_held(spark):
    turns = [(1, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(chatfmt.HOLD + 900)]
    windows = chatfmt.format_windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), PATH, budget=200, history=50)
    r = chatfmt.digest(windows).first()
    targets = "".join(t[3] for t in turns if t[2] == "assistant")
    assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(turns), len(targets), hashlib.sha256(targets.encode()).hexdigest())
    assert r["turns_sha256"] == hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns).encode()).hexdigest()


def test_chat_windows_round_trip(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    rng = random.Random(5)
    turns = [(1, 0, "system", "be brief"), *[(1, i, ("user", "assistant")[i % 2], " ".join(["word"] * rng.randint(1, 90)) + said) for i in range(1, 40)], (2, 0, "user", None), (2, 1, "assistant", "<\\|x <\\\\|y|> <|"), (2, 1, "assistant", "tie"), (3, 5, "we\nird%", "x"), (None, 0, "assistant", "z"), (4, 0, "assistant", "long " * 3000), (4, None, "system", "first")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1))
    windows = chatfmt.format_windows(df, PATH, budget=300, history=80).cache()
    found = {r["conv_id"]: r for r in chatfmt.digest(windows).collect()}
    key = lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")
    for c in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == c), key=key)
        targets = "".join(t[3] or "" for t in own if t[2] == "assistant")
        r = found[c]
        assert r["n_turns"] == len(own) and r["loss_chars"] == len(targets)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{t[2]}\n{t[3] or ''}\n" for t in own).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(targets.encode()).hexdigest()
        assert r["formatted_chars"] == sum(len(w["text"]) for w in windows.where(F.col("conv_id").eqNullSafe(F.lit(c))).collect())
    many = windows.where("conv_id = 1").orderBy("window").collect()
    assert len(many) > 5 and all(w["text"].startswith("<|im_start|>system\nbe brief<|im_end|>") for w in many)
    assert all(w["n_tokens"] <= 300 for w in many) and any(w["n_repeated"] > 1 for w in many[1:])
    assert chatfmt.digest(chatfmt.format_windows(df.where("conv_id > 99"), PATH)).count() == 0


@pytest.mark.parametrize("budget", [60, 300, 2048])
def test_windows_keep_their_budget_of_real_tokens(spark, budget):
    rng = random.Random(6)
    said = "<|im_end|><|im_start|>assistant ok"
    texts = ["ok", "", None, "<|", "<\\\\|!?", "3.14, naïve", said, "don't\n'", " . ", "word " * 30]
    made = [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    made += [(-2 - c, i, rng.choice(["user", "assistant", "tool<|", "a\n%", None]) if i else "system", rng.choice(texts)) for c in range(6) for i in range(400)]
    turns = common.documents(spark, "/root/testdata/sf0.01", "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(made, "conv_id long, turn long, role string, text string"))
    windows = chatfmt.format_windows(turns, PATH, budget=budget, history=budget // 8).collect()
    assert len(windows) > 100
    from tokenizers import Tokenizer

    counts = [len(x.ids) for x in Tokenizer.from_file(PATH).encode_batch([w["text"] for w in windows], add_special_tokens=False)]
    for w, n in zip(windows, counts):
        assert w["n_tokens"] == n
        own = chatfmt.parse(w["text"])
        assert n <= budget or len(own) - w["n_repeated"] == 1 and w["n_repeated"] <= 1


def test_toxicity_of_held_out_texts(spark):
    d = "/root/testdata/sf0.1"
    network = toxicity.fit(common.documents(spark, d), common.documents(spark, d, "labels"))
    got = toxicity.score(common.documents(spark, d), network=network).toPandas()
    both = got.merge(common.documents(spark, d, "labels").toPandas(), on="doc_id")
    held = both[both.held_out]
    assert ((held.predicted == 1) == (held.toxic == 1)).mean() > 0.95
    assert (got.predicted == (got.score >= 0.3)).all()
    odd = toxicity.score(table(spark), network=network).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd) and {r["predicted"] for r in odd if r["doc_id"] in (1, 2, 3)} == {0}
    toxic = [(1, "the and of " * 400 + "you stupid idiot " + "of the and " * 400), (2, "the and of " * 800)]
    assert [r["doc_id"] for r in toxicity.keep(table(spark, toxic), network).collect()] == [2]
    assert toxicity.score(table(spark).where("doc_id > 99"), network=network).count() == 0


def test_scores_of_the_network_equal_a_loop():
    network = toxicity.Network(5)
    p, h, sig = network.p, toxicity.HIDDEN, lambda x: 1 / (1 + np.exp(-x))

    def state(s, xs):
        out, now = [], np.zeros(h)
        for x in xs:
            g, x = now @ p[f"u{s}"], x @ p[f"w{s}"] + p[f"b{s}"]
            r, z = sig(x[:h] + g[:h]), sig(x[h : 2 * h] + g[h : 2 * h])
            now = (1 - z) * np.tanh(x[2 * h :] + r * g[2 * h :]) + z * now
            out.append(now)
        return out

    texts = ["one", "a few words, that's all", " ".join(f"w{i % 7}x" for i in range(131))]
    for text, found in zip(texts, toxicity.Scorer(network).score(texts)[0]):
        words = [toxicity.core(w) for w in text.split()]
        logits = []
        for at in toxicity.window_starts(len(words)):
            xs = network.embed(toxicity.Lexicon(words[at : at + toxicity.WINDOW]).take(np.arange(min(toxicity.WINDOW, len(words) - at))))
            both = np.concatenate([state("f", xs), state("b", xs[::-1])[::-1]], axis=1)
            weight = np.exp(both @ p["att"])
            logits.append(float((weight / weight.sum()) @ both @ p["out"] + p["bias"][0]))
        assert found == pytest.approx(sig(max(logits)), abs=1e-5)


def test_decoded_languages_equal_a_loop(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in langid.identify(docs, model).collect()[:60]:
        raw, counts = b" " + langid.lowered(rows[r["doc_id"]]) + b" ", {}
        for i in range(len(raw) - 2):
            g = int(langid.ngrams.trigrams(raw[i + 1 : i + 2])[0]) if len(raw) == 3 else None
            h = (raw[i] * 0x9E3779B1 + raw[i + 1] * 0x85EBCA77 + raw[i + 2] * 0xC2B2AE3D) % 2**32
            h = ((h ^ (h >> 15)) * 0x27D4EB2F) % 2**32 >> 20
            assert g is None or g == h
            counts[h] = counts.get(h, 0) + 1
        margin = [sum((n / (len(raw) - 2)) ** 0.5 * float(model.w[g, j]) for g, n in counts.items()) + float(model.b[j]) for j in range(len(model.b))]
        losses = [sum(w * np.log1p(np.exp(-m * c)) for w, m, c in zip(model.weight, margin, word)) for word in model.code]
        if r["lang_pred"] != "und":
            assert model.languages.index(r["lang_pred"]) == int(np.argmin(losses))


def test_quality_scores_equal_a_loop(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality.score(docs, model).collect()[:60]:
        votes = quality.votes_of(quality.Text(texts[r["doc_id"]]))
        good, bad = model.weak.prior, 1 - model.weak.prior
        for j, v in enumerate(votes):
            if v != quality.ABSTAIN:
                good *= model.weak.bad[j, 1] if v == quality.BAD else 1 - model.weak.bad[j, 1]
                bad *= model.weak.bad[j, 0] if v == quality.BAD else 1 - model.weak.bad[j, 0]
        assert r["posterior"] == pytest.approx(good / (good + bad), abs=1e-6)
        raw, total = texts[r["doc_id"]].encode(), float(model.b[0])
        counts = np.bincount(quality.ngrams.trigrams(raw), minlength=quality.ngrams.BUCKETS)
        total += sum((n / max(1, len(raw))) ** 0.5 * float(model.w[g, 0]) for g, n in enumerate(counts) if n)
        for k, v in enumerate(votes):
            total += 0.2 * float(model.w[quality.ngrams.BUCKETS + (v + 3 * k) * 0x9E3779B1 % 2**32 % quality.VOTE_BUCKETS, 0])
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-4) and r["kept"] == (r["score"] >= quality.THRESHOLD)


def test_fits_of_uneven_hashes_and_repeated_ids_are_settled(spark):
    rows = [(1, f"the text of number {i} is here and it is not long at all", "en") for i in range(40)] + [(2, f"le texte du numéro {i} est ici et il ne dit pas plus", "fr") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for turned in (docs, docs.orderBy(F.col("text").desc()).repartition(3)):
        assert quality.fit(turned, sample=5).w.tolist() == quality.fit(docs, sample=5).w.tolist()
        assert langid.fit(turned, sample=5).w.tolist() == langid.fit(docs, sample=5).w.tolist()
        labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0)], "doc_id long, toxic int")
        assert toxicity.fit(turned, labels).p["out"].tolist() == toxicity.fit(docs, labels).p["out"].tolist()


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for name in ("labels", "benchmark"):
        common.documents(spark, SF, name).write.parquet(f"{tmp_path}/{name}.parquet")
    good = " ".join(r["text"] for r in common.documents(spark, SF).where("length(text) between 300 and 900").orderBy("doc_id").limit(3).collect())
    rows = [*ODD, (20, good), (21, good), (22, re.sub("[a-z]", lambda m: m[0].upper(), good)), (20, good), (None, good), (23, None)]
    docs = table(spark, rows)
    for own in (docs, docs.where("doc_id > 99")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = common.staged(stage(spark, own, str(tmp_path)), name)
            assert out.columns == docs.columns and out.count() <= own.count()
            own = out
        pieces = corpus_pipeline.STAGES[-1][1](spark, own, str(tmp_path))
        left = own.select("doc_id").collect()
        assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == {r["doc_id"] for r in left}
        assert sum(r["doc_id"] in (20, 21, 22) for r in left) <= 1


def test_windows_cover_every_word():
    for n in (0, 1, toxicity.WINDOW, toxicity.WINDOW + 1, 500):
        of, first, place = toxicity.windows_of([3, n])
        own = place[of == 1]
        assert sorted(set(own[own >= 0].tolist())) == list(range(3, 3 + n)) and len(own) >= 1
        starts = first[of == 1]
        assert all(b - a <= toxicity.STRIDE for a, b in zip(starts, starts[1:]))


def test_gradients_of_the_network():
    network = toxicity.Network(1)
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    known = toxicity.Lexicon(["one", "two", "threesome", "", "four"]).take(np.arange(5))
    at = np.array([[0, 1, 2, 4], [4, 2, 3, 3]])
    mask, y = np.array([[True] * 4, [True, True, False, False]]), np.array([1.0, 0.0])
    grad, loss = network.gradients(known, at, mask, y)
    for name, index in (("uf", (0, 1)), ("wb", (3, 5)), ("bf", (20,)), ("att", (2,)), ("out", (9,)), ("bias", (0,)), ("words", (int(known[0][1]), 2)), ("chars3", (int(known[1][3][0][0]), 1))):
        step = 1e-2
        keep = network.p[name][index]
        network.p[name][index] = keep + step
        up = network.gradients(known, at, mask, y)[1]
        network.p[name][index] = keep - step
        down = network.gradients(known, at, mask, y)[1]
        network.p[name][index] = keep
        assert grad[name][index] == pytest.approx((up - down) / 2 / step, abs=2e-4), name


def test_components_of_stars_and_chains(spark):
    edges = spark.createDataFrame([(i, 0) for i in range(1, 50)] + [(i, i + 1) for i in range(100, 140)], "a long, b long")
    found = {r["id"]: r["component"] for r in graph.components(edges).collect()}
    assert all(found[i] == 0 for i in range(50)) and all(found[i] == 100 for i in range(100, 141))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    same(queries.QUERIES[name](spark, SF).toPandas(), connection().execute(queries.SQL[name]).df())


def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = common.documents(spark, "/root/testdata/sf0.01")
    labels = {r["doc_id"]: r for r in common.documents(spark, "/root/testdata/sf0.01", "labels").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.staged(stage(spark, docs, "/root/testdata/sf0.01"), name)
        assert out.columns == docs.columns
        before, after = ({r["doc_id"]: r["text"] for r in x.collect()} for x in (docs, out))
        gone = before.keys() - after.keys()
        assert after.keys() <= before.keys() and 0 < len(gone) < len(before) / 2 and out.count() == len(after)
        if name == "quality_classifier":
            assert sum(labels[i]["quality"] == 1 for i in gone if i in labels) <= 3
        if name == "ngram_join":
            expected = {i: c for i, (_, c) in brute_components_fast(before).items()}
            assert gone == {i for i, c in expected.items() if i != c}
        if name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in common.documents(spark, "/root/testdata/sf0.01", "benchmark").collect()]
            windows = {tuple(w[k : k + 10]) for _, t in items if (w := decontam.words_of(t)) for k in range(max(1, len(w) - 9))}
            assert gone == {i for i, t in before.items() if any(tuple(w[k : k + 10]) in windows for w in [decontam.words_of(t)] for k in range(len(w)))}
        docs = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.01")
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.collect()}


def brute_components_fast(texts):
    by, sets, label = {}, {}, {i: i for i in texts}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    edges = []
    for i, s in sets.items():
        n = {}
        for g in s:
            for j in by.get(g, ()):
                n[j] = n.get(j, 0) + 1
            by.setdefault(g, []).append(i)
        edges += [(i, j) for j, k in n.items() if 100 * k >= 75 * (len(s) + len(sets[j]) - k)]
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return {i: (len(sets[i]), label[i]) for i in texts}
