"""Language identification by error-correcting output codes over byte n-grams.

Each language has a codeword; a binary logistic classifier on hashed byte trigrams predicts each bit. Loss-weighted
decoding adds up the logistic losses of a codeword's bits, weighted by each bit's accuracy in training; the codeword of
the least loss wins, and a small lead over the second is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common, ngrams

#: Documents of each language and of all that are fitted on, and bits of a long code, at most.
SAMPLE, SAMPLE_ALL, BITS = 1200, 8192, 63
#: Share of the score by which the first language leads the second, under which the row is ambiguous.
LEAD = 0.2
RESULT = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"


def codewords(n: int, bits: int = BITS, seed: int = 5) -> np.ndarray:
    """A row of -1 and 1 for each of n languages: the exhaustive code for up to 6, else the best of random codes."""
    if n <= 1:
        return np.ones((n, 1), int)
    if n <= 6:
        columns = [(1, *rest) for rest in product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(columns).T
    rng, best, most = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice([-1, 1], size=(n, bits))
        code[:, np.abs(code.sum(0)) == n] = rng.choice([-1, 1], size=(n, int((np.abs(code.sum(0)) == n).sum())))
        apart = min(int((code[i] != code[i + 1 :]).sum(1).min()) for i in range(n - 1))
        if apart > most:
            best, most = code, apart
    return best


class Model:
    def __init__(self, languages: list[str], x: np.ndarray | None = None, of: np.ndarray | None = None):
        self.languages, self.code = languages, codewords(len(languages))
        if len(languages) < 2:
            return
        share = np.bincount(of, minlength=len(languages))
        y = (self.code[of] > 0).astype(np.float32)
        self.w, self.b = ngrams.fit_logistic(x, y, weight=1 / share[of])
        right = ((x.astype(np.float32) @ self.w + self.b > 0) == (y > 0)).mean(0)
        self.weight = np.log(np.clip(right, 0.51, 0.999) / (1 - np.clip(right, 0.51, 0.999)))

    def predict(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best language's number, its score and its lead over the second."""
        n = len(raws)
        if len(self.languages) < 2:
            return np.zeros(n, int), np.full(n, float(len(self.languages))), np.ones(n)
        margin = ngrams.features(raws) @ self.w + self.b
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None]) @ (self.weight / self.weight.sum())
        share = np.exp(-len(self.code[0]) * (loss - loss.min(1, keepdims=True)) / 2)
        share /= share.sum(1, keepdims=True)
        order = np.sort(share, axis=1)
        return share.argmax(1), order[:, -1], order[:, -1] - order[:, -2]


def fold() -> Column:
    """crc32 of the doc_id as text, modulo 4."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """From text and language of the rows of all folds but the third; at most sample documents of a language.

    Where that would be over SAMPLE_ALL of all languages, each has its share of these, and one at the least.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null and doc_id is not null").where(fold() != 2)
    counts = {x["lang"]: x["n"] for x in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    sample = max(1, min(sample, SAMPLE_ALL // max(1, len(languages))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 1 << 20):
            x = ngrams.features([lowered(t) for t in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], ["lang", "place", "x"])

    # a share of each language's rows by hash, twice the sample at most, so that no sort sees a language's rows
    share = F.lit(0)
    for name, n in counts.items():
        share = F.when(F.col("lang") == name, max(1, n // sample)).otherwise(share)
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), share) == 0)
    place = F.xxhash64("doc_id", "text").alias("place")
    read = lambda rows, most: rows.select("text", "lang", "place").mapInArrow(run, "lang string, place long, x binary").orderBy("place", "lang", "x").limit(most).collect()
    got = read(chosen.select("text", "lang", place), 2 * sample * max(1, len(counts)))
    for name in counts.keys() - {x["lang"] for x in got}:  # few doc_ids that repeat so often that none of them is chosen
        got += read(known.where(F.col("lang") == name).groupBy("lang", place).agg(F.min("text").alias("text")), sample)
    at = {x: i for i, x in enumerate(languages)}
    if len(languages) < 2 or not got:
        return Model(languages[:1])
    x = np.frombuffer(b"".join(r["x"] for r in got), np.float16).reshape(len(got), -1)
    return Model(languages, x, np.array([at[r["lang"]] for r in got]))


def lowered(text: str | None) -> bytes:
    return (text or "").lower().encode()


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """RESULT for each row. lang_pred is und, with score 0, where the text is null or has no letter, or no language was learned.

    Texts of any length are read as a whole. Repeated rows each have a result; other columns are ignored; an empty table gives no rows; a null doc_id counts as
    not held out.
    """
    held = docs.sparkSession.sparkContext.broadcast(model or fit(docs))  # of a fixed size for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = held.value
        for batch in common.slices(batches, limit=1 << 20):
            texts = batch.column(2).to_pylist()
            best, score, lead = found.predict([lowered(t) for t in texts])
            known = [bool(found.languages) and t is not None and any(map(str.isalpha, t)) for t in texts]
            names = [found.languages[i] if k else "und" for i, k in zip(best.tolist(), known)]
            score = np.where(known, score, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names), pa.array(score.astype(float)), pa.array(np.where(known, lead, 0) < LEAD)], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "text").mapInArrow(run, RESULT)
