"""Archives, the audit of filters and fill-in-the-middle against loops, and on odd and empty tables."""

import gzip
import hashlib
import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from recollect.llm import common, filteraudit, fim, warc

LONG = "<p>" + "x\r\n\r\nWARC/1.1\r\n" * 40000
PAGES = [
    (3, "http://a.b/1", "é" * 60), (1, "http://a.b/2", "é" * 60), (1, "http://a.b/2", "é" * 60), (2, None, "é" * 60), (None, "http://a.b/3", "é" * 60), (4, "http://a.b/\r\nWARC-Type: x y%20", None), (5, "", ""), (6, "u", "short"), (7, "u", "short"),
    (8, "v", LONG), (9, "v", LONG), (10, "v", "y" * 99), (11, "v", "y" * 99), (12, "v", "y" * 100), (13, "v", "y" * 100), (None, "w", "z" * 200), (None, "w", "z" * 200),
]


def pages(spark, rows=PAGES):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.select("*", *[F.lit(1).alias(c) for c in ("payload", "digest", "key", "first", "path", "offset")])


def expected_pages(rows):
    out = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        ids = [p for p, _, h in rows if (h or "").encode() == raw and p is not None]
        first = min(ids) if ids and len(raw) >= 100 else None
        again = first is not None and page_id != first
        out.append((page_id, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("file_bytes", [1 << 30, 1])
def test_archives_equal_a_loop(spark, file_bytes):
    folder = common.new_folder(spark, "test")
    index = warc.write(pages(spark), folder, file_bytes=file_bytes)
    assert sorted(map(tuple, warc.resolved(warc.read(index, folder, task_bytes=64)).collect()), key=str) == expected_pages(PAGES)
    assert index.count() == len(PAGES) and {r["url"] for r in index.collect()} == {u for _, u, _ in PAGES}
    if file_bytes == 1:
        assert index.select("path").distinct().count() == len(PAGES)
    empty = common.new_folder(spark, "test")
    assert warc.resolved(warc.read(warc.write(pages(spark).where("page_id > 99"), empty), empty)).count() == 0


def test_archives_are_plain_warc(spark):
    folder = common.new_folder(spark, "test")
    index = warc.write(pages(spark).coalesce(1), folder).toPandas()
    seen = 0
    for path, own in index.groupby("path"):
        data = open(path, "rb").read()
        own = own.sort_values("offset")
        for r in own.itertuples():
            headers, block = warc.parse(gzip.decompress(data[r.offset : r.offset + r.length]))
            assert headers["warc-type"] == r.record_type and headers["warc-record-id"] == f"<{r.record_id}>" and headers["warc-payload-digest"] == f"sha256:{r.digest}"
            assert "\n" not in headers.get("warc-target-uri", "") and block.startswith(b"HTTP/1.1 200 OK\r\n")
        assert (own.offset + own.length).iloc[-1] == len(data)
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        seen += len(own)
    assert seen == len(PAGES)


def test_selected_records_alone_are_read(spark):
    folder = common.new_folder(spark, "test")
    index = warc.write(pages(spark), folder)
    got = warc.read(index.where("page_id in (6, 8, 9)"), folder).collect()
    assert sorted((r["page_id"], r["record_type"], r["payload"] and bytes(r["payload"]).decode()) for r in got) == [(6, "response", "short"), (8, "response", LONG), (9, "revisit", None)]
    assert got[0]["digest"] and {r["refers_to_id"] for r in got} == {None, next(r["record_id"] for r in got if r["page_id"] == 8)}
    alone = warc.resolved(warc.read(index.where("page_id = 9"), folder)).collect()
    assert [tuple(r) for r in alone] == [(9, None, None, "revisit", None)]


def test_damage_is_an_error():
    raw = warc.record(1, "u", "response", "urn:x", None, hashlib.sha256(b"abc").hexdigest(), b"abc")
    assert warc.parse(raw)[1].endswith(b"\r\n\r\nabc") and warc._records([warc.parse(raw)]).num_rows == 1
    for broken in (raw[:-1], raw + b"x", b"HTTP" + raw):
        with pytest.raises(ValueError):
            warc.parse(broken)
    with pytest.raises(ValueError):
        warc._records([warc.parse(raw.replace(b"abc", b"abd"))])


def test_requests_cover_ranges_and_keep_their_bounds():
    rng = random.Random(3)
    for _ in range(200):
        gap, most = rng.randint(0, 20), rng.randint(1, 60)
        ranges = sorted((rng.randint(0, 300), rng.randint(1, 30)) for _ in range(rng.randint(0, 25)))
        found = list(warc.requests(ranges, gap, most))
        assert [r for _, _, own in found for r in own] == ranges
        for start, end, own in found:
            assert start == own[0][0] and end == max(a + n for a, n in own) and (end - start <= most or len(own) == 1)
            ends = [max(a + n for a, n in own[:i]) for i in range(1, len(own))]
            assert all(b[0] - e <= gap for b, e in zip(own[1:], ends))
        for (_, end, a), (start, last, b) in zip(found, found[1:]):
            assert start - end > gap or b[0][0] + b[0][1] - a[0][0] > most or end - a[0][0] > most
    assert [(a, b) for a, b, _ in warc.requests([(0, 5), (5, 5), (30, 5)], 0, 100)] == [(0, 10), (30, 35)]


TEXTS = [
    (1, "a b c", "en"), (2, "a b c", None), (2, "a b c", "en"), (3, None, ""), (None, "a b c", "en"), (4, "", "de"), (5, " \n\t", "de"), (6, " ".join(f"w{i}" for i in range(100)), "en"), (7, " ".join(f"w{i}" for i in range(80)) + " w0" * 20, "en"),
    (8, " ".join(f"w{i}" for i in range(79)) + " w0" * 21, "en"), (9, "A" + "b" * 9, "en"), (10, "AA" + "é" * 17, "en"), (11, "word " * 60000, "en"), (12, "50 % off & more", None), (13, "W w " + " ".join(f"w{i}" for i in range(200)), "en"), (None, "x", None),
]
LABELS = [(1, 1, 0), (1, 0, 1), (6, 1, None), (8, None, 1), (11, 1, 1), (None, 1, 1), (99, 1, 1)]


def brute_audit(docs, labels):
    rows = []
    for doc_id, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t))}
        fails["E"] = doc_id is not None and any(d is not None and d < doc_id and (u or "") == t for d, u, _ in docs)
        own = [x for x in labels if doc_id is not None and x[0] == doc_id]
        rows.append((lang or "", {k for k, v in fails.items() if v}, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = []
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        found = []
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                fails = sum(f in r[1] for r in mine)
                found.append([part, "".join(order), step, len(left), len(gone), fails - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)])
        share = {f: sum(r[4] for r in found if r[1][r[2] - 1] == f) for f in "ABCDE"}
        out += [(*r, share[r[1][r[2] - 1]]) for r in found]
    return sorted(out)


def test_audit_equals_a_loop(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string").select("*", *[F.lit(1).alias(c) for c in ("part", "A", "E", "digest", "first", "n", "good", "quality", "passed")])
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    got = filteraudit.audit(docs, labels)
    assert sorted(map(tuple, got.collect())) == brute_audit(TEXTS, LABELS)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert filteraudit.audit(docs.where("doc_id > 99"), labels).count() == 0
    assert sorted(map(tuple, filteraudit.audit(docs, labels.where("doc_id < 0")).collect())) == brute_audit(TEXTS, [])


def brute_fim(doc_id, text, seed=7, fim_percent=100, spm_percent=50):
    t = text or ""
    u = re.findall(r"[^\n]*\n|[^\n]+", t)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or re.search("<[PSM]>", t) or h[2] % 100 >= fim_percent:
        return doc_id, len(u), "plain", None, None, None, t
    if h[3] % 100 < spm_percent:
        return doc_id, len(u), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(u), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


def test_fim_equals_a_loop(spark):
    rng = random.Random(4)
    pieces = ["\n", "\x01", "\x02", "\x02e", "\x02m", "\x01\n", "a", "é€𝄞", "$1", "\\", "\r\n", "<P", "P>", "<", "word ", "\x00", "m", "e"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 30)))) for i in range(400)]
    rows += [(None, "a\nb\nc"), (None, "a\nb\nc"), (5, "a\nb"), (5, "a\nb"), (1000, None), (1001, "x<M>y\nz"), (1002, "line\n" * 30000), (1003, "no end " * 30000), (1004, "\n" * 1000), (1005, "<P><S>")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("n", "form", "units", "h1", "a", "b", "prefix", "output")])
    for options in ({}, {"seed": 11, "fim_percent": 60, "spm_percent": 10}):
        got = fim.transform(docs, **options)
        assert sorted(map(tuple, got.collect()), key=str) == sorted((brute_fim(*r, **options) for r in rows), key=str)
        back = got.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("text"))
        assert sorted(map(tuple, back.collect()), key=str) == sorted(((d, t or "") for d, t in rows), key=str)
    assert {r["form"] for r in fim.transform(docs).collect()} == {"plain", "psm", "spm"}
    assert fim.digest(fim.transform(docs.where("doc_id < 0"))).count() == 0


def test_fim_of_other_units(spark):
    docs = spark.createDataFrame([(i, "one two  three four five ") for i in range(50)], "doc_id long, text string")
    got = fim.transform(docs, unit=r"[^ \x01\x02]*(?:\x02[em])* *").where("n > 0")
    assert got.count() == 50
    assert all(r["prefix"] + r["middle"] + r["suffix"] == "one two  three four five " for r in got.collect())


def test_digests_of_fim(spark):
    docs = spark.createDataFrame([(1, "a\nbé\n"), (2, "<P>")], "doc_id long, text string")
    for r, t in zip(fim.digest(fim.transform(docs)).orderBy("doc_id").collect(), ("a\nbé\n", "<P>")):
        e = brute_fim(r["doc_id"], t)
        assert tuple(r) == (e[0], e[1], e[2], None if e[3] is None else len(e[3]), None if e[4] is None else len(e[4]), hashlib.sha256(e[6].encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
