"""Models that a caller brings: embedders, rerankers and summarisers, as callables, and how rows go through them.

An embedder has `dim` and maps a list of texts to that many vectors; a reranker maps a query and texts to (index, score)
pairs; a summariser maps a list of (title, body) to a title and a body. Each runs on executors, in batches, so it must
be picklable. What one of them gets wrong becomes a column of errors or the order before it, never a failed job.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import vectors

POOL, MOST_POOL, CLIP = 20, 100, 1500


class Embedder(Protocol):
    dim: int

    def __call__(self, texts: list[str]) -> list: ...


class HashEmbedder:
    """The embedder that needs no model."""

    def __init__(self, dim: int = vectors.DIM):
        self.dim = dim

    def __call__(self, texts: list[str]) -> list:
        return list(vectors.hash_embeds(texts, self.dim))


#: Services by the shape of their requests and answers: the fields of a request, whether it takes many texts, and the way to the vectors.
SERVICES: dict[str, tuple[Callable, bool, Callable]] = {
    "generic": (lambda model, texts: {"text": texts[0]}, False, lambda x: [x["embedding"]]),
    "ollama": (lambda model, texts: {"model": model, "prompt": texts[0]}, False, lambda x: [x["embedding"]]),
    "openai": (lambda model, texts: {"model": model, "input": texts}, True, lambda x: [y["embedding"] for y in sorted(x["data"], key=lambda y: y.get("index", 0))]),
    "tei": (lambda model, texts: {"inputs": texts}, True, lambda x: x),
    "voyage": (lambda model, texts: {"model": model, "input": texts}, True, lambda x: [y["embedding"] for y in sorted(x["data"], key=lambda y: y.get("index", 0))]),
    "cohere": (lambda model, texts: {"model": model, "texts": texts, "input_type": "search_document"}, True, lambda x: x["embeddings"]),
}


class ServiceEmbedder:
    """A hosted model; `send` posts a JSON object and returns the answer's, and is the caller's."""

    def __init__(self, service: str, model: str, dim: int, send: Callable[[dict], object]):
        if service not in SERVICES:
            raise ValueError(f"embedding service {service!r}; known are {', '.join(sorted(SERVICES))}")
        self.service, self.model, self.dim, self.send = service, model, dim, send

    def __call__(self, texts: list[str]) -> list:
        request, many, vectors_of = SERVICES[self.service]
        parts = [texts] if many else [[t] for t in texts]
        return [v for part in parts for v in vectors_of(self.send(request(self.model, part)))]


def probe(embedder: Embedder) -> int:
    """The length of a vector; another than the embedder states is an error, found before any row is written."""
    found = len(embedder(["probe"])[0])
    if found != embedder.dim:
        raise ValueError(f"the embedder gives {found} dimensions, {embedder.dim} are expected")
    return found


def embedded(rows: DataFrame, text: str, embedder: Embedder, most_chars: int | None = None, batch: int = 64) -> DataFrame:
    """rows with embedding, was_truncated and embed_error (null where there is a vector).

    Texts are cut at most_chars; a blank text, a vector of another length and an answer that fails are errors of their rows.
    """
    columns = [c for c in rows.columns if c not in ("embedding", "was_truncated", "embed_error")]
    rows = rows.select(*columns)
    at = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for all_rows in batches:
            for first in range(0, all_rows.num_rows, batch):
                part = all_rows.slice(first, batch)
                texts = [x or "" for x in part.column(at).to_pylist()]
                long = [bool(most_chars) and len(t) > most_chars for t in texts]
                found, errors = _vectors(embedder, [t[:most_chars] if cut else t for t, cut in zip(texts, long)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(pa.float32())), pa.array(long), pa.array(errors, pa.string())], [*columns, "embedding", "was_truncated", "embed_error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, embedding array<float>, was_truncated boolean, embed_error string")


def _vectors(embedder: Embedder, texts: list[str]) -> tuple[list, list]:
    found: list = [None] * len(texts)
    errors: list = [None if t.strip() else "text required" for t in texts]
    asked = [i for i, e in enumerate(errors) if e is None]
    try:
        for i, v in zip(asked, embedder([texts[i] for i in asked]) if asked else []):
            if len(v) == embedder.dim:
                found[i] = np.asarray(v, dtype="f4")
            else:
                errors[i] = f"dimension mismatch: got {len(v)}, expected {embedder.dim}"
    except Exception as e:  # whatever a caller's model raises is told, row by row
        errors = [x or f"embedder failed: {e}" for x in errors]
        found = [None] * len(texts)
    return found, [e or (None if v is not None else "no vector") for v, e in zip(found, errors)]


def reembedded(rows: DataFrame, embedder: Embedder, most_chars: int | None = None, dry_run: bool = False) -> DataFrame:
    """rows with new vectors of title and body; updated_at stays. A dry run only counts: n, n_without_vector."""
    if dry_run:
        return rows.agg(F.count("*").alias("n"), F.count_if(F.col("embedding").isNull()).alias("n_without_vector"))
    return embedded(rows.withColumn("_text", F.concat_ws("\n", "title", "body")), "_text", embedder, most_chars).drop("_text")


def rerank(rows: DataFrame, query: str, reranker: Callable[[str, list[str]], list], top_n: int = POOL, limit: int | None = None) -> DataFrame:
    """rows with rerank_score and place: the pool's rows by the reranker's score, those it left out, then rows beyond the pool.

    Equal scores go by the order before. A reranker that fails, or that names a row that isn't in the pool, leaves that
    order, with null scores. The pool holds at most MOST_POOL rows, and is what one task sees.
    """
    if not query:
        raise ValueError("a query is required")
    size = max(1, min(MOST_POOL, top_n))
    pool = rows.orderBy(F.col("score").desc(), "id").limit(size)

    def run(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values(["score", "id"], ascending=[False, True])
        try:
            best: dict[int, float] = {}
            for index, value in reranker(query, [f"{t or ''}\n{b or ''}" for t, b in zip(pool["title"], pool["body"])]):
                if not 0 <= int(index) < len(pool):
                    raise ValueError(index)
                best[int(index)] = max(float(value or 0), best.get(int(index), -np.inf))
        except Exception:
            best = {}
        order = sorted(best, key=lambda i: (-best[i], i)) + [i for i in range(len(pool)) if i not in best]
        return pd.DataFrame({"id": pool["id"].to_numpy()[order], "rerank_score": [best.get(i) for i in order], "place": np.arange(1, len(order) + 1)})

    scored = pool.select("id", "title", "body", "score").groupBy().applyInPandas(run, "id long, rerank_score double, place long")
    out = rows.join(F.broadcast(scored), "id", "left")  # MOST_POOL rows at most
    ordered = out.orderBy(F.col("place").asc_nulls_last(), F.col("score").desc(), "id")
    return ordered.limit(limit) if limit else ordered


#: Hosted rerankers by the shape of their answers: a list of index and score, or results of index and relevance.
RERANKERS: dict[str, Callable[[object], list[tuple[int, float]]]] = {
    "tei": lambda x: [(int(y["index"]), float(y.get("score") or 0)) for y in x],
    "cohere": lambda x: [(int(y["index"]), float(y.get("relevance_score") or y.get("score") or 0)) for y in x["results"]],
}


class ServiceReranker:
    """A hosted cross-encoder, to be given to rerank(); `send` posts a JSON object and returns the answer's, and is the caller's.

    A request has the texts under the names that both kinds of services know. An answer of another shape is an error,
    which rerank() meets by keeping the order.
    """

    def __init__(self, send: Callable[[dict], object], model: str | None = None):
        self.send, self.model = send, model

    def __call__(self, query: str, texts: list[str]) -> list[tuple[int, float]]:
        request = {"query": query, "texts": texts, "documents": texts, "raw_scores": False} | ({"model": self.model} if self.model else {})
        answer = self.send(request)
        if isinstance(answer, list):
            return RERANKERS["tei"](answer)
        if isinstance(answer, dict) and isinstance(answer.get("results"), list):
            return RERANKERS["cohere"](answer)
        raise ValueError("a reranker's answer of another shape")


def summary_prompt(rows: list[tuple[str | None, str | None]], clip: int = CLIP) -> str:
    """Numbered memories, and what is asked of the model."""
    told = "\n\n".join(f"[{i}] {title or ''}\n{(body or '')[:clip]}" for i, (title, body) in enumerate(rows, 1))
    return f'Summarise these memories as one. Answer with a JSON object that has "title" and "body".\n\n{told}'


def parsed_summary(answer: str) -> tuple[str, str] | None:
    """Title and body of the JSON object in an answer, or None."""
    first, last = answer.find("{"), answer.rfind("}")
    try:
        found = json.loads(answer[first : last + 1])
        title, body = str(found["title"]).strip(), str(found["body"]).strip()
    except (ValueError, KeyError, TypeError):
        return None
    return (title, body) if title and body else None


def asked_summary(ask: Callable[[str], str]) -> Callable[[list], tuple[str, str] | None]:
    """A summariser by a text model: `ask` maps a prompt to an answer."""
    return lambda rows: parsed_summary(ask(summary_prompt(rows)))


def noop(rows: list[tuple[str | None, str | None]]) -> tuple[str, str]:
    """Joined titles cut at 200, bodies as a list."""
    titles = " | ".join(t for t, _ in rows if t)[:200]
    return f"Summary: {titles}" if titles else f"Summary of {len(rows)} memories", "\n".join(f"- {b}" for _, b in rows if b)


def summarised(rows: DataFrame, by: list[str], order: list[str], summariser: Callable = noop) -> DataFrame:
    """by, title, body, source_ids, error: one row for each group of rows (id, title, body), which are batches of bounded size."""
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group, title, body, error = group.sort_values(order), None, None, None
        try:
            found = summariser(list(zip(group["title"], group["body"])))
            title, body = found or (None, None)
            error = None if found else "no summary"
        except Exception as e:
            error = f"summariser failed: {e}"
        return pd.DataFrame([[*key, title, body, group["id"].tolist(), error]], columns=[*by, "title", "body", "source_ids", "error"])

    return rows.select(*dict.fromkeys([*by, *order, "id", "title", "body"])).groupBy(*by).applyInPandas(run, f"{kinds}, title string, body string, source_ids array<long>, error string")
