"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on every document. Expectation-maximisation over the counts
of all documents' vote patterns estimates the labellers' accuracies and the share of good documents; the posterior of
its pattern labels a document softly. A hashed linear scorer learns these labels from a bounded sample, by byte
trigrams and hashed vote tokens, and scores every whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common, ngrams

ABSTAIN, BAD, GOOD = 0, 1, 2
#: Documents that the scorer is fitted on, at most.
SAMPLE = 2500
THRESHOLD = 0.5
RESULT = "doc_id long, posterior double, score double, kept boolean"
SIGNS = b"#$%&*@^~<>{}[]\\=+_"
#: Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = frozenset(
    "the of and to a in is was for that it with as on be by this are from or an at not i you he she they we his her but have had has which their were been if will would can all one there so what when who them my me no do "
    "le la les de des du un une et à il elle en que qui dans pour pas sur au aux avec par ce se son sa ses est sont plus ne ou mais nous vous je tu leur "
    "der die das und den dem des von zu im mit auf für ist nicht ein eine einer einem als auch es an sich aus bei nach wie aber wird werden war ich du er sie wir "
    "el los las y del al por con para una su lo como más o pero sus este esta entre cuando muy sin sobre también hasta donde".split()
)


class Text:
    """What the labellers look at; made once for each document."""

    def __init__(self, text: str | None):
        self.raw = (text or "").encode()
        self.counts = np.bincount(np.frombuffer(self.raw, np.uint8), minlength=256)
        self.words = (text or "").split()
        self.n = len(self.words)

    def share(self, of: bytes) -> float:
        return sum(int(self.counts[b]) for b in of) / (len(self.raw) or 1)


def _vote(value: float, good: float, bad: float) -> int:
    """Good on the far side of good, bad on the far side of bad, abstention between."""
    if good <= bad:
        return GOOD if value <= good else BAD if value >= bad else ABSTAIN
    return GOOD if value >= good else BAD if value <= bad else ABSTAIN


def signs(t: Text) -> int:
    return _vote(t.share(SIGNS), 0.006, 0.03)


def capitals(t: Text) -> int:
    upper, lower = int(t.counts[65:91].sum()), int(t.counts[97:123].sum())
    return ABSTAIN if upper + lower < 20 else _vote(upper / (upper + lower), 0.15, 0.4)


def shouting(t: Text) -> int:
    return _vote(t.share(b"!"), 0.01, 0.03)


def bars(t: Text) -> int:
    return _vote(int(t.counts[124]) / (t.n or 1), 0.02, 0.1)


def plain_words(t: Text) -> int:
    if t.n < 8:
        return ABSTAIN
    return _vote(sum(w.strip(".,;:!?\"'()").isalpha() for w in t.words) / t.n, 0.8, 0.5)


def function_words(t: Text) -> int:
    if t.n < 20:
        return ABSTAIN
    return _vote(sum(map(FUNCTION_WORDS.__contains__, t.words)) / t.n, 0.08, 0.01)


def echoes(t: Text) -> int:
    if t.n < 8:
        return ABSTAIN
    return _vote(sum(a == b for a, b in zip(t.words, t.words[1:])) / t.n, 0.06, 0.25)


def vocabulary(t: Text) -> int:
    """Distinct words against what a text of so many words would have at the least."""
    if t.n < 30:
        return ABSTAIN
    return _vote(len(set(t.words)) / t.n**0.75, 0.6, 0.3)


def repeated_lines(t: Text) -> int:
    lines = [x for x in t.raw.split(b"\n") if x.strip()]
    return ABSTAIN if len(lines) < 4 else _vote(1 - len(set(lines)) / len(lines), 0.35, 0.6)


def length(t: Text) -> int:
    return BAD if t.n < 1 else GOOD if t.n >= 20 else ABSTAIN


LABELLERS: tuple[Callable[[Text], int], ...] = (signs, capitals, shouting, bars, plain_words, function_words, echoes, vocabulary, repeated_lines, length)
PATTERNS = 3 ** len(LABELLERS)


def votes_of(t: Text) -> list[int]:
    return [f(t) for f in LABELLERS]


def pattern_of(votes: list[int]) -> int:
    return sum(v * 3**i for i, v in enumerate(votes))


def pattern_votes(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


class WeakLabels:
    """prior: share of good documents; bad[j, y]: probability that labeller j, where it votes, votes bad though the truth is y.

    An abstention says nothing. The first guess takes a document for good by how many votes call it bad; labellers are
    taken to be better than chance, so a vote for a class never counts against it.
    """

    #: The first guess by the number of bad votes, and pseudo-counts of a labeller's right and wrong votes.
    FIRST, RIGHT, WRONG = (0.97, 0.4, 0.1, 0.02), 2.0, 0.1

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 40):
        votes, counts = pattern_votes(patterns), counts.astype(float)
        p = np.array(self.FIRST)[np.minimum((votes == BAD).sum(1), len(self.FIRST) - 1)]
        self.bad = np.zeros((votes.shape[1], 2))
        for _ in range(rounds):
            self.prior = float((p * counts).sum() + 1) / float(counts.sum() + 2)
            for y, q in ((1, p * counts), (0, (1 - p) * counts)):
                wrong = ((votes == (GOOD, BAD)[y]) * q[:, None]).sum(0) + self.WRONG
                right = ((votes == (BAD, GOOD)[y]) * q[:, None]).sum(0) + self.RIGHT
                self.bad[:, y] = (wrong if y else right) / (wrong + right)
            self.bad[:, 0] = np.maximum(self.bad[:, 0], self.bad[:, 1])
            p = self.posterior(patterns)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        votes = pattern_votes(np.asarray(patterns))
        against = np.log(self.bad[:, 1]) - np.log(self.bad[:, 0])
        toward = np.log(1 - self.bad[:, 1]) - np.log(1 - self.bad[:, 0])
        logit = np.log(self.prior / (1 - self.prior)) + (votes == BAD) @ against + (votes == GOOD) @ toward
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))

    def accuracies(self) -> dict[str, float]:
        """Of the votes that aren't abstentions."""
        return dict(zip((f.__name__ for f in LABELLERS), (self.prior * (1 - self.bad[:, 1]) + (1 - self.prior) * self.bad[:, 0]).tolist()))


def _x(texts: list[Text]) -> tuple[np.ndarray, np.ndarray]:
    """Features of the scorer, and the patterns: byte trigrams, then a hashed token for each vote."""
    votes = np.array([votes_of(t) for t in texts]).reshape(-1, len(LABELLERS))
    own = np.zeros((len(texts), VOTE_BUCKETS), np.float32)
    for k in range(len(LABELLERS)):
        own[np.arange(len(texts)), (votes[:, k] + 3 * k) * 0x9E3779B1 % (1 << 32) % VOTE_BUCKETS] += 0.2
    return np.concatenate([ngrams.features([t.raw for t in texts]), own], axis=1), votes @ 3 ** np.arange(len(LABELLERS))


VOTE_BUCKETS = 67


class Model:
    def __init__(self, weak: WeakLabels, w: np.ndarray, b: np.ndarray):
        self.weak, self.w, self.b = weak, w, b


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """EM over all documents' patterns; the scorer over at most sample documents, chosen by a hash of their doc_ids (twice as many, those of the least hashes, where that is uneven).

    Null, empty and blank texts vote as what they are, and repeated rows each count. Texts may be of any length. An empty
    table gives a model whose scorer has no weights.
    """
    spark = docs.sparkSession

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(PATTERNS, np.int64)
        for batch in common.slices(batches, limit=1 << 20):
            for x in batch.column(0).to_pylist():
                counts[pattern_of(votes_of(Text(x)))] += 1
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["pattern", "n"])

    texts = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    rows = texts.select("text").mapInArrow(patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()  # at most 3 ** 10
    seen, counts = np.array([x["pattern"] for x in rows], int), np.array([x["n"] for x in rows], int)
    if not len(seen):
        return Model(WeakLabels(np.zeros(1, int), np.zeros(1, int)), np.zeros((ngrams.BUCKETS + VOTE_BUCKETS, 1), np.float32), np.zeros(1, np.float32))
    weak = WeakLabels(seen, counts)
    part = max(1, int(counts.sum()) // sample)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, limit=1 << 20):
            x, own = _x([Text(t) for t in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(own, pa.int64()), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], ["place", "pattern", "x"])

    chosen = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(part)) == 0) if part > 1 else texts
    placed = chosen.select("text", F.xxhash64("doc_id", "text").alias("place"))
    read = lambda rows, most: rows.mapInArrow(rows_of, "place long, pattern long, x binary").orderBy("place", "pattern", "x").limit(most).collect()
    # where few doc_ids repeat so often that none of them is chosen, each distinct row is read once
    got = read(placed, 2 * sample) or read(texts.groupBy(F.xxhash64("doc_id", "text").alias("place")).agg(F.min("text").alias("text")).select("text", "place"), sample)
    x = np.frombuffer(b"".join(r["x"] for r in got), np.float16).reshape(len(got), -1)
    y = weak.posterior(np.array([r["pattern"] for r in got]))
    w, b = ngrams.fit_logistic(x, y[:, None])
    return Model(weak, w, b)


def _scored(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    x, patterns = _x([Text(t) for t in texts])
    return model.weak.posterior(patterns), ngrams.sigmoid(x @ model.w + model.b)[:, 0].astype(float)


def score(docs: DataFrame, model: Model | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """RESULT for each row: the weak posterior, the scorer's score, and whether it reaches the threshold.

    Null texts are empty ones; texts of any length are scored as a whole. Every row has a result, repeated ones too; other columns are ignored; an empty table
    gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model or fit(docs))  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, limit=1 << 20):
            p, s = _scored(held.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(s), pa.array(s >= threshold)], ["doc_id", "posterior", "score", "kept"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, RESULT)


def keep(docs: DataFrame, model: Model | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold.

    Null texts are judged as empty ones, repeated rows alike, texts of any length as a whole; doc_ids aren't looked at.
    An empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, limit=1 << 20):
            yield batch.filter(pa.array(_scored(held.value, batch.column(at).to_pylist())[1] >= threshold))

    return docs.mapInArrow(run, docs.schema)
