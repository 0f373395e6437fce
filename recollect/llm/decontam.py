"""Benchmark decontamination: one Aho-Corasick automaton over the words of test items, one scan of each text.

Texts are normalised to words (A-Z lower-cased, runs of ASCII digits, letters and any non-ASCII character). Every
WINDOW consecutive words of an item are a pattern; an item of fewer words is one pattern. The automaton reads word
numbers, so the end of a match is a word's position, which maps back to character offsets of the original text.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from . import common

WINDOW = 10
#: Bytes of item texts in one automaton (about 10 trie nodes a word); larger benchmarks are dealt to several.
AUTOMATON_BYTES = 1 << 20
#: Bytes of texts that a task holds while it applies several automata, one after another.
HELD_BYTES = 64 << 20
#: ASCII bytes that aren't of words become spaces, capitals small letters.
WORD_BYTES = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<string>, spans array<struct<start:long,end:long>>"
AUTOMATA: dict[tuple[str, int], tuple] = {}


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


def offsets(text: str) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end character of each word in the original text."""
    raw = text.encode()
    word = np.frombuffer(raw.translate(WORD_BYTES), np.uint8) != 32
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    char = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])  # characters before each byte
    return char[np.flatnonzero(edge == 1)], char[np.flatnonzero(edge == -1)]


def build(items: list[tuple[str | None, str | None]], window: int) -> tuple:
    """Word numbers, the automaton, and for each pattern its length and item ids."""
    import ahocorasick

    numbers: dict[bytes, int] = {}
    patterns: dict[tuple, set] = {}
    for item_id, text in items:
        words = tuple(numbers.setdefault(w, len(numbers) + 1) for w in words_of(text))
        for at in range(max(1, len(words) - window + 1) if words else 0):
            patterns.setdefault(words[at : at + window], set()).add(item_id)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for words, ids in patterns.items():
        automaton.add_word(words, (len(words), ids))
    if patterns:
        automaton.make_automaton()
    return numbers, automaton if patterns else None


def matches(words: list[bytes], numbers: dict[bytes, int], automaton) -> Iterator[tuple[int, int, set]]:
    """First word, last word and item ids of every occurrence."""
    get = numbers.get
    for end, (length, ids) in automaton.iter(tuple([get(w, 0) for w in words])):
        yield end - length + 1, end, ids


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """RESULT for each row of docs: counts, the items with an occurrence, and the hit spans as character offsets.

    Null and empty texts have no words; texts of any length are scanned as a whole; items without words never occur. Repeated item_ids count once; the words that an
    item with a null item_id covers are hit, but it isn't listed. Repeated rows of docs each get a row. Other columns
    are ignored. A benchmark of more than automaton_bytes is dealt to several automata (an item is never cut); a task
    builds one at a time and applies it to HELD_BYTES of texts, in one pass over docs.
    """
    items = Items(benchmark, window, automaton_bytes)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scan(items), RESULT)


def keep(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, in which no pattern of the benchmark occurs.

    Null, empty and wordless texts stay, and so does every row if no item has a word; repeated rows are judged alike,
    texts of any length as a whole. An empty table gives no rows.
    """
    return docs.mapInArrow(_clean(Items(benchmark, window, automaton_bytes), docs.columns.index("text")), docs.schema)


class Items:
    """The benchmark as workers read it: broadcast if it fits one automaton, else in parts in the shared folder."""

    def __init__(self, benchmark: DataFrame, window: int, automaton_bytes: int):
        spark = benchmark.sparkSession
        bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
        size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.name, self.window, self.n_parts = uuid.uuid4().hex, window, max(1, -(-size // automaton_bytes))
        if self.n_parts == 1:
            self.held = spark.sparkContext.broadcast([tuple(x) for x in bench.where("text is not null").collect()])
        else:
            self.folder = common.new_folder(spark, "items")
            own = bench.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(self.n_parts)))
            own.repartition("part").write.partitionBy("part").parquet(self.folder)

    def part(self, which: int) -> list[tuple[str | None, str | None]]:
        if self.n_parts == 1:
            return self.held.value
        store, base = fs.FileSystem.from_uri(f"{self.folder}/part={which}")
        if store.get_file_info(base).type == fs.FileType.NotFound:
            return []
        found = pq.read_table(base, columns=["item_id", "text"], filesystem=store, partitioning=None)
        return list(zip(found["item_id"].to_pylist(), found["text"].to_pylist()))

    def automata(self) -> Iterator[tuple]:
        """Every part's automaton; a worker holds one, and builds the only one of a small benchmark once."""
        for which in range(self.n_parts):
            if (self.name, which) not in AUTOMATA:
                AUTOMATA.clear()
                AUTOMATA[self.name, which] = build(self.part(which), self.window)
            yield AUTOMATA[self.name, which]

    def held_together(self, batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        """Batches that meet all automata together, so that an automaton is built seldom where there are several."""
        held, size = [], 0
        for batch in common.slices(batches):
            held.append(batch)
            size += batch.column("text").nbytes
            if self.n_parts == 1 or size >= HELD_BYTES:
                yield held
                held, size = [], 0
        if held:
            yield held


def _clean(items: Items, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in items.held_together(batches):
            clean = [np.ones(batch.num_rows, bool) for batch in held]
            for numbers, automaton in items.automata():
                for batch, own in zip(held, clean):
                    for i in np.flatnonzero(own) if automaton else ():
                        own[i] = next(matches(words_of(batch.column(at)[int(i)].as_py()), numbers, automaton), None) is None
            for batch, own in zip(held, clean):
                yield batch.filter(pa.array(own))

    return run


def _scan(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in items.held_together(batches):
            found = [[[0, [], set()] for _ in range(batch.num_rows)] for batch in held]
            for numbers, automaton in items.automata():
                for batch, own in zip(held, found):
                    for text, x in zip(batch.column(1), own):
                        words = words_of(text.as_py())
                        x[0] = len(words)
                        for first, end, ids in matches(words, numbers, automaton) if automaton else ():
                            x[1] += (first, end)
                            x[2] |= ids
            for batch, own in zip(held, found):
                out = [_digest(doc_id, text, *x) for doc_id, text, x in zip(batch.column(0).to_pylist(), batch.column(1), own)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), TYPES)], NAMES)

    return run


TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
NAMES = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids", "spans"]


def _digest(doc_id: int | None, text: pa.StringScalar, n_words: int, found: list[int], items: set) -> tuple:
    ids = sorted(x for x in items if x is not None)
    hit, spans = 0, []
    if found:
        edge = np.zeros(n_words + 1, np.int64)
        np.add.at(edge, np.array(found[::2]), 1)
        np.add.at(edge, np.array(found[1::2]) + 1, -1)
        covered = np.cumsum(edge)[:-1] > 0
        hit = int(covered.sum())
        change = np.diff(covered.astype(np.int8), prepend=0, append=0)
        starts, ends = offsets(text.as_py())
        spans = [{"start": int(starts[a]), "end": int(ends[b - 1])} for a, b in zip(np.flatnonzero(change == 1), np.flatnonzero(change == -1))]
    return doc_id, n_words, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0, ids, spans
