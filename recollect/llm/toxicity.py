"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's input is its hashed word vector beside the mean of its hashed character n-gram vectors, for each n. Windows of WINDOW
words overlap by WINDOW - STRIDE; each window's states are pooled by attention to a logit, and a text's score is that
of its highest window. In training the highest window of a text carries the text's label.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common
from .langid import fold

WINDOW, STRIDE = 48, 32
WORD_BUCKETS, CHAR_BUCKETS, WORD_DIM, CHAR_DIM, HIDDEN = 1 << 15, 1 << 15, 8, 8, 8
#: Characters of the n-grams.
GRAMS = (3, 5)
#: Labelled documents that the network is fitted on, and the words of one such document, at most.
SAMPLE, SAMPLE_WORDS = 5000, 6000
EPOCHS, BATCH, RATE, DECAY = 5, 48, 0.01, 1e-4
#: Distinct words whose inputs a worker keeps.
CACHE_WORDS = 200_000
THRESHOLD = 0.3
RESULT = "doc_id long, held_out boolean, score double, predicted int, n_windows long, worst_word long"


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def gram_hashes(words: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words' character n-grams, with marks at both ends, and each word's number of them (at least one)."""
    marked = [f"<{w}>".ljust(GRAMS[-1], "_") for w in words]
    raw = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), "<u4").astype(np.uint32)
    lengths = np.array([len(w) for w in marked])
    h = np.zeros(len(raw) - size + 1, np.uint32)
    for i in range(size):
        h = (h ^ raw[i : len(raw) - size + 1 + i]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    inside = np.ones(len(raw), bool)
    for i in range(1, size):
        inside[np.cumsum(lengths) - i] = False
    return h[inside[: len(h)]].astype(np.int64) % CHAR_BUCKETS, lengths - size + 1


def word_hashes(words: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(w.encode()) % WORD_BUCKETS for w in words], np.int64)


class Lexicon:
    """The hashes of words, computed once; take() gives those of some of them."""

    def __init__(self, words: list[str], part: int = 20_000):
        cut = [words[at : at + part] for at in range(0, len(words), part)]
        self.hashes = np.concatenate([word_hashes(w) for w in cut])
        self.grams = {}
        for k in GRAMS:
            found = [gram_hashes(w, k) for w in cut]
            grams, sizes = np.concatenate([f[0].astype(np.int32) for f in found]), np.concatenate([f[1] for f in found])
            self.grams[k] = grams, sizes, np.cumsum(sizes) - sizes

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, dict]:
        out = {}
        for k, (grams, sizes, starts) in self.grams.items():
            own = sizes[rows]
            at = np.repeat(starts[rows] - (np.cumsum(own) - own), own) + np.arange(own.sum())
            out[k] = grams[at], own
        return self.hashes[rows], out


class Network:
    """Parameters by name; inputs() gives the gate inputs of words, logits() those of windows."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        n, d, h = rng.normal, WORD_DIM + CHAR_DIM * len(GRAMS), HIDDEN
        self.p = {"words": n(size=(WORD_BUCKETS, WORD_DIM)) * 0.1, "att": n(size=2 * h) * 0.3, "out": n(size=2 * h) * 0.3, "bias": np.array([-2.0])}
        self.p |= {f"chars{k}": n(size=(CHAR_BUCKETS, CHAR_DIM)) * 0.3 for k in GRAMS}
        for s in "fb":
            self.p |= {f"w{s}": n(size=(d, 3 * h)) / d**0.5, f"b{s}": np.zeros(3 * h), f"u{s}": n(size=(h, 3 * h)) / h**0.5}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def embed(self, known: tuple[np.ndarray, dict]) -> np.ndarray:
        """Inputs of words, by their hashes."""
        hashes, found = known
        parts = [self.p["words"][hashes]]
        for k, (grams, sizes) in found.items():
            parts.append(np.add.reduceat(self.p[f"chars{k}"][grams], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None])
        return np.concatenate(parts, axis=1).astype(np.float32)

    def inputs(self, lexicon: Lexicon, rows: np.ndarray, part: int = 20_000) -> np.ndarray:
        """Both directions' gate inputs of words, side by side; so many words at a time, as their n-grams take memory."""
        out = np.empty((len(rows), 6 * HIDDEN), np.float32)
        for at in range(0, len(rows), part):
            e = self.embed(lexicon.take(rows[at : at + part]))
            out[at : at + part, : 3 * HIDDEN] = e @ self.p["wf"] + self.p["bf"]
            out[at : at + part, 3 * HIDDEN :] = e @ self.p["wb"] + self.p["bb"]
        return out

    def _run(self, s: str, gates: np.ndarray, at: np.ndarray, mask: np.ndarray | None, kept: list | None = None) -> np.ndarray:
        """States of one direction, [time, window, hidden]; gates: inputs of words, at: [window, time] rows of it."""
        n, t = at.shape
        h, u, out = np.zeros((n, HIDDEN), np.float32), self.p[f"u{s}"], np.empty((t, n, HIDDEN), np.float32)
        for i in range(t) if s == "f" else range(t - 1, -1, -1):
            x, g = gates.take(at[:, i], axis=0), h @ u
            rz = sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
            r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
            new = np.tanh(x[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
            if kept is not None:
                kept.append((i, h, r, z, new, g[:, 2 * HIDDEN :]))
            then = new + z * (h - new)
            h = then if mask is None else np.where(mask[:, i, None], then, h)
            out[i] = h
        return out

    def _pool(self, states: np.ndarray, mask: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        score = states @ self.p["att"]
        if mask is not None:
            score = np.where(mask.T, score, -1e9)
        share = np.exp(score - score.max(0))
        share /= share.sum(0)
        context = np.einsum("tn,tnh->nh", share, states)
        return context @ self.p["out"] + self.p["bias"][0], share, context

    def logits(self, gates: np.ndarray, at: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        f, b = np.ascontiguousarray(gates[:, : 3 * HIDDEN]), np.ascontiguousarray(gates[:, 3 * HIDDEN :])
        states = np.concatenate([self._run("f", f, at, mask), self._run("b", b, at, mask)], axis=2)
        return self._pool(states, mask)[0]

    def gradients(self, known: tuple[np.ndarray, dict], at: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict, float]:
        """Of the mean cross-entropy of windows `at` (rows of the known words) with labels y."""
        p, h3 = self.p, 3 * HIDDEN
        (hashes, found), e = known, self.embed(known)
        kept: dict[str, list] = {"f": [], "b": []}
        gates = {s: e @ p[f"w{s}"] + p[f"b{s}"] for s in "fb"}
        runs = {s: self._run(s, gates[s], at, mask, kept[s]) for s in "fb"}
        states = np.concatenate([runs["f"], runs["b"]], axis=2)
        logit, share, context = self._pool(states, mask)
        q = sigmoid(logit)
        loss = float(-(y * np.log(q + 1e-7) + (1 - y) * np.log(1 - q + 1e-7)).mean())
        d = ((q - y) / len(y)).astype(np.float32)
        grad = {"bias": np.array([d.sum()]), "out": context.T @ d}
        dc = d[:, None] * p["out"]
        along = np.einsum("nh,tnh->tn", dc, states)
        ds = share * (along - (share * along).sum(0))
        dstates = share[:, :, None] * dc + ds[:, :, None] * p["att"]
        grad["att"] = np.einsum("tn,tnh->h", ds, states)
        de = np.zeros_like(e)
        for k, s in enumerate("fb"):
            u, dh = p[f"u{s}"], np.zeros((len(at), HIDDEN), np.float32)
            du, dx = np.zeros_like(u), np.zeros((at.shape[1], len(at), h3), np.float32)
            for i, h, r, z, new, gn in reversed(kept[s]):
                dh = dh + dstates[i, :, k * HIDDEN : (k + 1) * HIDDEN]
                m = mask[:, i, None]
                live = np.where(m, dh, 0)
                dn = live * (1 - z) * (1 - new * new)
                dz = live * (h - new) * z * (1 - z)
                dr = dn * gn * r * (1 - r)
                dg = np.concatenate([dr, dz, dn * r], axis=1)
                dx[i] = np.concatenate([dr, dz, dn], axis=1)
                du += h.T @ dg
                dh = np.where(m, 0, dh) + live * z + dg @ u.T
            total = np.zeros((len(hashes), h3), np.float32)
            np.add.at(total, at.T.ravel(), dx.reshape(-1, h3))
            grad |= {f"u{s}": du, f"w{s}": e.T @ total, f"b{s}": total.sum(0)}
            de += total @ p[f"w{s}"].T
        grad["words"] = np.zeros_like(p["words"])
        np.add.at(grad["words"], hashes, de[:, :WORD_DIM])
        for i, (k, (grams, sizes)) in enumerate(found.items()):
            own = de[:, WORD_DIM + i * CHAR_DIM : WORD_DIM + (i + 1) * CHAR_DIM]
            grad[f"chars{k}"] = np.zeros_like(p[f"chars{k}"])
            np.add.at(grad[f"chars{k}"], grams, np.repeat(own / sizes[:, None], sizes, axis=0))
        return grad, loss


def window_starts(n: int) -> list[int]:
    """Every word is in a window, and neighbours overlap; the last one ends with the text. No words: one empty window."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def windows_of(sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of so many words, one after the other: each window's text, its first word in the text, and its words' places (-1: none)."""
    of, first = starts_of(sizes)
    return of, first, places(np.array(sizes, np.int64), of, first)


def starts_of(sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Each window's text and first word."""
    own = [window_starts(n) for n in sizes]
    return np.repeat(np.arange(len(own)), [len(x) for x in own]), np.array([s for x in own for s in x], np.int64)


def places(sizes: np.ndarray, of: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The places of some windows' words among those of all texts (-1: none)."""
    place, base = first[:, None] + np.arange(WINDOW), np.cumsum(sizes) - sizes
    return np.where(place < sizes[of][:, None], place + base[of][:, None], -1)


class Scorer:
    """Scores texts; keeps the gate inputs of words it has seen."""

    def __init__(self, network: Network):
        self.network = network
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.gates = np.zeros((1, 6 * HIDDEN), np.float32)  # row 0: no word

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's score, number of windows, and first word of its highest window."""
        if len(self.rows) > CACHE_WORDS:
            self._clear()
        rows = self.rows
        cut = [words_of(t) for t in texts]
        new = list(set().union(*cut) - rows.keys())
        if new:
            rows.update(zip(new, range(len(self.gates), len(self.gates) + len(new))))
            self.gates = np.concatenate([self.gates, self.network.inputs(Lexicon([core(w) for w in new]), np.arange(len(new)))])
        get = rows.__getitem__
        flat = np.array([i for words in cut for i in map(get, words)] + [0], np.int32)
        sizes = np.array([len(w) for w in cut], np.int64)
        of, first = starts_of(sizes.tolist())
        logit = np.empty(len(of), np.float32)
        full = sizes[of] >= WINDOW
        for part, masked in ((np.flatnonzero(full), False), (np.flatnonzero(~full), True)):
            for at in range(0, len(part), 4096):
                own = places(sizes, of[part[at : at + 4096]], first[part[at : at + 4096]])
                logit[part[at : at + 4096]] = self.network.logits(self.gates, flat[own], own >= 0 if masked else None)
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        best = np.maximum.reduceat(logit, starts)
        worst = first[np.lexsort((first, -logit, of))[starts]]
        return sigmoid(best.astype(np.float64)), np.diff(np.append(starts, len(of))), worst


def core(word: str) -> str:
    """A word without the signs around it."""
    return word.strip(".,;:!?\"'()|*#$%&-") or word


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> Network:
    network, rng = Network(seed), np.random.default_rng(seed)
    if not len(texts):
        return network
    names: dict[str, int] = {}
    cut = [np.array([names.setdefault(core(w), len(names)) for w in words_of(t)], np.int32) for t in texts]
    lexicon = Lexicon([*names, ""])
    first = {k: np.zeros_like(v) for k, v in network.p.items()}
    second, step = {k: np.zeros_like(v) for k, v in network.p.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(cut))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            of, _, place = windows_of([len(cut[i]) for i in own])
            flat = np.concatenate([*(cut[i] for i in own), [len(names)]])
            here, ids = np.unique(flat[place], return_inverse=True)
            ids = ids.reshape(place.shape)
            logit = network.logits(network.inputs(lexicon, here), ids, place >= 0)
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            top = np.lexsort((-logit, of))[starts]
            used, local = np.unique(ids[top], return_inverse=True)
            grad, _ = network.gradients(lexicon.take(here[used]), local.reshape(len(top), -1), place[top] >= 0, labels[own].astype(np.float32))
            step += 1
            rate = RATE * (1 - 0.8 * step / (epochs * -(-len(order) // BATCH)))
            for k, g in grad.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
                network.p[k] = (network.p[k] * (1 - (DECAY if k.startswith(("words", "chars")) else 0)) - rate * move).astype(np.float32)
    return network


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """From the texts of at most sample labelled rows of all folds but the third, chosen by a hash of the doc_id.

    Labels are 0 or 1, the highest of repeated rows; of a doc_id that several texts have the least text is read; rows with nulls are left out. Without labels the network stays as
    it was drawn, and scores are low.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(fold() != 2)
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    texts = texts.where(F.length("text") - F.length(F.translate("text", " \n\t", "")) < SAMPLE_WORDS)
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()  # sample rows at most
    rows.sort(key=lambda x: x["doc_id"])
    marks = np.array([float(x["toxic"] > 0) for x in rows])
    said = [x["text"] for x in rows]
    del rows
    return train(said, marks)


SCORERS: dict[int, Scorer] = {}


def _scorer(held) -> Scorer:
    common.claim("toxicity", SCORERS.clear)
    network = held.value
    if id(network) not in SCORERS:
        SCORERS.clear()
        SCORERS[id(network)] = Scorer(network)
    return SCORERS[id(network)]


def score(docs: DataFrame, labels: DataFrame | None = None, network: Network | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """RESULT for each row of docs. Null texts are empty ones, which have one empty window; long texts are scored in all of their windows, some thousands at a time.

    Repeated rows each have a result; a null doc_id counts as not held out; other columns are ignored; an empty table
    gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(network or fit(docs, labels))  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(held)
        for batch in common.slices(batches, limit=4 << 20):
            s, n, worst = scorer.score(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(worst)], ["doc_id", "held_out", "score", "predicted", "n_windows", "worst_word"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "text").mapInArrow(run, RESULT)


def keep(docs: DataFrame, network: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold.

    Null texts are judged as empty ones, repeated rows alike, all windows of texts of any length; doc_ids aren't looked
    at. An empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(network)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(held)
        for batch in common.slices(batches, limit=4 << 20):
            yield batch.filter(pa.array(scorer.score(batch.column(at).to_pylist())[0] < threshold))

    return docs.mapInArrow(run, docs.schema)
