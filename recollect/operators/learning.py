"""Learning from use: retrieval log, reinforcements, training triples, the pairwise reranker, gates and the version registry."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import staging
from .search import FEATURES, PRIOR, pool_features

#: Weights of a triple by its signal; others weigh 1.
SIGNAL_WEIGHTS = {"mistake": 3.0, "reversal": 3.0, "direct_command": 3.0, "miss": 3.0, "praise": 2.0}
EVENTS_EACH, MIN_SAMPLES, GATE_SHARE = 5, 20, 0.3
RATE, L2, EPOCHS = 0.1, 0.01, 200


def signal_weight(event_type: Column) -> Column:
    out = F.lit(1.0)
    for name, w in SIGNAL_WEIGHTS.items():
        out = F.when(event_type == name, w).otherwise(out)
    return out


def harvest(reinforcements: DataFrame, retrievals: DataFrame, events_each: int = EVENTS_EACH, limit: int | None = None) -> DataFrame:
    """scope, query, positive, negatives, weight, signal: each reinforced memory with the latest retrievals that showed it.

    Candidates are exploded and joined by equality rather than tested by containment; per memory and scope only the
    latest retrievals are kept, by their ids, before they meet their candidates, and the heaviest signal of a (query, positive) wins.
    """
    reinforcements = reinforcements.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit) if limit else reinforcements
    signals = reinforcements.groupBy("scope", F.col("memory_id").alias("positive")).agg(F.max(F.struct(signal_weight(F.col("event_type")).alias("weight"), F.col("event_type").alias("signal"))).alias("best"))
    shown = retrievals.select("scope", "id", "created_at", F.explode(F.array_distinct("candidate_ids")).alias("positive"))
    shown = shown.join(signals.select("scope", "positive"), ["scope", "positive"], "left_semi")
    w = Window.partitionBy("scope", "positive").orderBy(F.col("created_at").desc(), F.col("id").desc())
    latest = shown.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= events_each).join(signals, ["scope", "positive"])
    of = retrievals.select("scope", "id", "query", F.col("created_at").alias("_at"), "candidate_ids")  # looked up for the latest ones alone
    latest = latest.join(of, ["scope", "id"]).where(F.col("created_at").eqNullSafe(F.col("_at")) & F.array_contains("candidate_ids", F.col("positive")))
    found = latest.select("scope", "query", "positive", F.filter("candidate_ids", lambda c: c != F.col("positive")).alias("negatives"), "best", "created_at", "id")
    best = F.max_by(F.struct("negatives", "best"), F.struct("best.weight", "created_at", "id"))
    return found.where(F.size("negatives") > 0).groupBy("scope", "query", "positive").agg(best.alias("b")).select("scope", "query", "positive", "b.negatives", F.col("b.best.weight").alias("weight"), F.col("b.best.signal").alias("signal"))


def reuse_counts(triples: DataFrame) -> DataFrame:
    return triples.groupBy(F.col("positive").alias("id")).agg(F.count("*").alias("reuse_count"))


def misses(reinforcements: DataFrame, retrievals: DataFrame) -> DataFrame:
    """Adds `final_type`: a mistake about a memory that the scope's retrievals never showed is a miss, if there were any."""
    logged = retrievals.select("scope").distinct().withColumn("_logged", F.lit(True))
    shown = retrievals.select("scope", F.explode("candidate_ids").alias("memory_id")).distinct().withColumn("_shown", F.lit(True))
    out = reinforcements.join(logged, "scope", "left").join(shown, ["scope", "memory_id"], "left")
    missed = (F.col("event_type") == "mistake") & F.col("_logged").isNotNull() & F.col("_shown").isNull()
    return out.withColumn("final_type", F.when(missed, "miss").otherwise(F.col("event_type"))).drop("_logged", "_shown")


def split(examples: DataFrame, order: list[str], share: float = GATE_SHARE, by: list[str] | None = None) -> DataFrame:
    """Adds `is_gate`: every n-th example is held out, in a fixed order."""
    every = max(2, math.floor(1 / share))
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)
    return examples.withColumn("is_gate", F.row_number().over(w) % every == 0)


def folds(rows: DataFrame, order: list[str], k: int, by: list[str]) -> DataFrame:
    return rows.withColumn("fold", (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) % k)


#: Margins beyond this are cut, so that no exponential overflows.
MOST_MARGIN = 30.0


def descent(pieces: Callable[[], Iterable[np.ndarray]], rate: float = RATE, l2: float = L2, epochs: int = EPOCHS) -> dict[str, float]:
    """Weights by pairwise logistic descent: a row of the pieces has its weight, and how a positive differs from another row, in order of FEATURES.

    A step a row, in order, along the row by how unlikely its order still is, and towards the prior. The bias is the
    prior's: it is no part of a difference. Pieces are asked for once an epoch.
    """
    prior = [float(PRIOR[k]) for k in FEATURES]
    w, exp = list(prior), math.exp
    for _ in range(epochs):
        for piece in pieces():
            for weight, *d in piece.tolist():
                m = sum([x * y for x, y in zip(d, w)])
                unlikely = weight / (1 + exp(MOST_MARGIN if m > MOST_MARGIN else -MOST_MARGIN if m < -MOST_MARGIN else m))
                w = [x + rate * (unlikely * y - l2 * (x - p)) for x, y, p in zip(w, d, prior)]
    return {"bias": PRIOR["bias"]} | dict(zip(FEATURES, w))


def fit(pairs: np.ndarray, weights: np.ndarray, rate: float = RATE, l2: float = L2, epochs: int = EPOCHS) -> dict[str, float]:
    """descent() of pairs that are in memory."""
    return descent(lambda: [np.column_stack([weights, pairs])], rate, l2, epochs)


def total_loss(pairs: np.ndarray, weights: dict[str, float]) -> float:
    """Sum of the pairwise logistic losses."""
    margins = np.clip(pairs @ np.array([weights.get(k, 0.0) for k in FEATURES]), -MOST_MARGIN, MOST_MARGIN)
    return float(np.log1p(np.exp(-margins)).sum())


def mean_loss(pairs: np.ndarray, weights: dict[str, float]) -> float:
    """Mean pairwise logistic loss; 0 without pairs."""
    return total_loss(pairs, weights) / len(pairs) if len(pairs) else 0.0


def gate_loss(pairs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """loss, n: mean pairwise logistic loss over rows with p_<feature> of a positive and n_<feature> of a negative."""
    margin = F.lit(0.0)
    for k in FEATURES:
        margin = margin + weights.get(k, 0.0) * (F.col(f"p_{k}") - F.col(f"n_{k}"))
    margin = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), margin))
    return pairs.agg(F.avg(F.log1p(F.exp(-margin))).alias("loss"), F.count("*").alias("n"))


def decide(n_examples: int, new_loss: float | None, old_loss: float | None, margin: float = 0.0, min_samples: int = MIN_SAMPLES) -> str:
    """skip without enough examples; promote only what is strictly better by more than the margin."""
    if n_examples < min_samples or new_loss is None or old_loss is None:
        return "skip"
    return "promote" if new_loss < old_loss - margin else "reject"


#: Deltas of events that come without one.
DELTAS = {"direct_command": 1.0, "mistake": 0.5, "reversal": 0.5, "praise": 0.5, "miss": 0.5}


def retrieval_rows(found: DataFrame, as_of: Column) -> DataFrame:
    """Rows for the retrieval log of results (scope, query, id, rank); a query without text or results has none."""
    own = found.where("scope != '' and query != '' and id is not null")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"])
    return own.groupBy("scope", "query").agg(ids.alias("candidate_ids")).withColumn("created_at", as_of)


def reinforcement_rows(events: DataFrame, as_of: Column) -> DataFrame:
    """Rows for the log of reinforcements (memory_id, scope, event_type, delta, note), with `error` for those that can't be logged."""
    default = F.lit(None).cast("double")
    for kind, delta in DELTAS.items():
        default = F.when(F.col("event_type") == kind, delta).otherwise(default)
    error = F.when(F.col("memory_id").isNull(), "memory_id required").when(default.isNull(), F.concat(F.lit("unknown event_type "), F.coalesce("event_type", F.lit("null"))))
    return events.withColumns({"delta": F.coalesce(F.col("delta").cast("double"), default), "created_at": as_of, "error": error})


def logged(rows: DataFrame, path: str) -> None:
    """Appends to a log, whose files are dealt by scope."""
    rows.write.mode("append").partitionBy("scope").parquet(path)


def examples(triples: DataFrame, pools: DataFrame) -> DataFrame:
    """scope, query, positive, weight, id, is_positive and f_<feature> of every row of the pools (scope, query, id and what pool_features reads) that hold their triple's positive.

    Reuse is how many triples have a row as their positive.
    """
    reuse = triples.groupBy("scope", F.col("positive").alias("id")).agg(F.count("*").alias("reuse_count"))
    scaled = pool_features(pools.join(reuse, ["scope", "id"], "left"), ["scope", "query"])
    own = scaled.join(triples.select("scope", "query", "positive", "weight"), ["scope", "query"])
    w = Window.partitionBy("scope", "query", "positive")
    own = own.withColumn("is_positive", F.col("id") == F.col("positive")).withColumn("_has", F.max("is_positive").over(w)).where("_has")
    return own.select("scope", "query", "positive", "weight", "id", "is_positive", *[f"f_{k}" for k in FEATURES])


#: Bytes of a scope's pairs that are held at once; more lie in a file of the task.
PIECE_BYTES = 8 << 20
TRAINED = "scope string, n_examples long, weights map<string,double>, new_score double, incumbent_score double"


def numbered(found: DataFrame, most: int | None = None) -> DataFrame:
    """scope, query, positive, n (from 1): the examples that a scope's training takes, all where a caller gives no bound."""
    w = Window.partitionBy("scope").orderBy("query", "positive")
    out = found.select("scope", "query", "positive").distinct().withColumn("n", F.row_number().over(w))
    return out.where(F.col("n") <= most) if most else out


class _Scope:
    """The examples of a scope as they come, in order: pairs (weight, difference) to train on and pairs held out, in files that are read in pieces."""

    def __init__(self, scope: str | None, every: int):
        self.scope, self.every, self.n, self.last, self.best, self.now = scope, every, 0, None, None, None
        self.files = [tempfile.SpooledTemporaryFile(PIECE_BYTES) for _ in range(2)]

    def add(self, rows: pa.RecordBatch) -> None:
        """rows are of this scope, each example's positive before its others; a row of a null example has the current weights."""
        keys = list(zip(rows.column("query").to_pylist(), rows.column("positive").to_pylist()))
        values = rows.column("values").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
        if rows.column("part")[0].as_py() == 0:
            self.now, keys, values, rows = values[0], keys[1:], values[1:], rows.slice(1)
        if not keys:
            return
        new = np.array([x != y for x, y in zip(keys, [self.last, *keys])])
        n = self.n + np.cumsum(new)
        is_best = rows.column("is_positive").to_numpy(zero_copy_only=False)
        of = np.maximum.accumulate(np.where(is_best | new, np.arange(1, len(keys) + 1), 0))  # where a row's positive is; 0 is the last batch's
        has = np.concatenate([[self.best is not None], is_best])[of]
        best = np.concatenate([[values[0] if self.best is None else self.best], values])[of]
        pairs = np.column_stack([rows.column("weight").to_numpy(zero_copy_only=False), best - values])
        real, gate = has & ~is_best, n % self.every == 0
        for file, own in zip(self.files, (pairs[real & ~gate], pairs[real & gate])):
            file.write(own.tobytes())
        self.n, self.last, self.best = int(n[-1]), keys[-1], best[-1] if has[-1] else None

    def pieces(self, gate: bool) -> Iterator[np.ndarray]:
        file, row = self.files[gate], 8 * (len(FEATURES) + 1)
        file.seek(0)
        while data := file.read(PIECE_BYTES // row * row):
            yield np.frombuffer(data).reshape(-1, len(FEATURES) + 1)

    def loss(self, weights: dict[str, float]) -> float:
        found = [(total_loss(piece[:, 1:], weights), len(piece)) for piece in self.pieces(True)]
        return sum(x for x, _ in found) / sum(n for _, n in found) if found else 0.0

    def trained(self, least: int, training: dict) -> Iterator[pa.RecordBatch]:
        """TRAINED of the scope, without weights where it has fewer examples than least."""
        weights = descent(lambda: self.pieces(False), **training) if self.n >= least else None
        scores = [None, None]
        if weights:
            now = PRIOR if self.now is None else dict(zip(FEATURES, self.now.tolist()))
            scores = [self.loss(weights), self.loss(now)]
        for file in self.files:
            file.close()
        if self.n:
            row = [self.scope, self.n, weights and list(weights.items()), *scores]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.int64(), pa.map_(pa.string(), pa.float64()), pa.float64(), pa.float64()))], ["scope", "n_examples", "weights", "new_score", "incumbent_score"])


def trained(found: DataFrame, incumbent: DataFrame, every: int, least: int, **training) -> DataFrame:
    """TRAINED for each scope of found, on all of its examples in order of query and positive; without weights for scopes of fewer than least.

    Every n-th example is held out; both losses are those of the held-out ones. incumbent has scope and weights. Scopes
    are trained beside each other. A training is a step after another, so a scope is one task: its rows come to it
    sorted, and it holds a piece of them at a time.
    """
    own = found.where("is_positive is not null").select("scope", F.lit(1).alias("part"), "query", "positive", (~F.col("is_positive")).alias("other"), "id", "is_positive", "weight", F.array(*[F.col(f"f_{k}") for k in FEATURES]).alias("values"))
    now = F.array(*[F.coalesce(F.element_at("weights", k), F.lit(0.0)) for k in FEATURES])
    none = [F.lit(None).cast(own.schema[c].dataType).alias(c) for c in ("query", "positive", "other", "id", "is_positive", "weight")]
    rows = own.unionByName(incumbent.where("weights is not null").select("scope", F.lit(0).alias("part"), *none, now.alias("values")))
    order = ["scope", "part", "query", "positive", "other", "id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scope = None
        for batch in batches:
            names = batch.column("scope").to_pylist()
            starts = [i for i, name in enumerate(names) if not i or name != names[i - 1]]
            for start, end in zip(starts, [*starts[1:], len(names)]):
                if scope is None or scope.scope != names[start]:
                    if scope:
                        yield from scope.trained(least, training)
                    scope = _Scope(names[start], every)
                scope.add(batch.slice(start, end - start))
        if scope:
            yield from scope.trained(least, training)

    return rows.repartition("scope").sortWithinPartitions(*order).drop("other", "id").mapInArrow(run, TRAINED)


def promotions(found: DataFrame, registry: DataFrame, as_of: Column, margin: float = 0.0, min_samples: int = MIN_SAMPLES, share: float = GATE_SHARE, dry_run: bool = False, most: int | None = None, **training) -> dict[str, DataFrame]:
    """Trains every scope's reranker on its examples (as examples() gives them), in one job, and promotes weights that beat the current ones on those held out.

    outcome: scope, decision, weights, new_score, incumbent_score, n_train, n_gate; registry: with new versions; audit: a
    row for each scope. A scope of fewer than min_samples examples is skipped; with `most`, a scope's first ones count alone.
    """
    every = max(2, math.floor(1 / share))
    own = found.join(numbered(found, most).drop("n"), ["scope", "query", "positive"], "left_semi") if most else found
    incumbent = current_weights(registry.where("kind = 'reranker'")).select("scope", "weights")
    out = trained(own, incumbent, every, max(min_samples, every), **training)
    decision = F.when(F.col("new_score").isNull(), "skip").when(F.col("new_score") < F.col("incumbent_score") - margin, "promote").otherwise("reject")
    n_gate = F.floor(F.col("n_examples") / every).cast("int")
    out = staging.staged(out.withColumns({"decision": decision, "n_gate": n_gate, "n_train": F.col("n_examples").cast("int") - n_gate}), "promotions")
    if not dry_run:
        registry = registered(registry, out.where("decision = 'promote'").select("scope", F.lit("reranker").alias("kind"), "weights", F.col("new_score").alias("score"), as_of.alias("created_at")))
    told = F.when(F.lit(dry_run) & (F.col("decision") != "skip"), F.concat(F.lit("would-"), "decision")).otherwise(F.col("decision"))
    out = out.withColumn("decision", told)
    note = F.when(F.col("decision") == "skip", F.concat(F.col("n_examples").cast("string"), F.lit(f" examples, {min_samples} needed")))
    audit = out.select("scope", F.lit("reranker").alias("kind"), "decision", "new_score", "incumbent_score", "n_train", "n_gate", note.alias("note"), as_of.alias("created_at"))
    return {"outcome": out.drop("n_examples"), "registry": registry, "audit": audit}


def promotion(found: DataFrame, registry: DataFrame, scope: str, as_of: Column, **options) -> dict:
    """promotions() of one scope: its decision and weights, the registry and the audit; a scope without examples is skipped without a row."""
    out = promotions(found.where(F.col("scope") == scope), registry, as_of, **options)
    own = out["outcome"].first()
    return {"decision": own["decision"] if own else "skip", "weights": own["weights"] if own else None, "registry": out["registry"], "audit": out["audit"]}


def registered(registry: DataFrame, new: DataFrame) -> DataFrame:
    """The registry with new weights (scope, kind, weights, score, note, created_at) as each scope's next version, current."""
    last = registry.groupBy("scope", "kind").agg(F.max("version").alias("last"))
    entries = new.join(last, ["scope", "kind"], "left").withColumns({"version": (F.coalesce("last", F.lit(0)) + 1).cast("int"), "is_current": F.lit(True)}).drop("last")
    touched = entries.select("scope", "kind").distinct().withColumn("_new", F.lit(True))
    old = registry.join(touched, ["scope", "kind"], "left").withColumn("is_current", F.col("is_current") & F.col("_new").isNull()).drop("_new")
    return old.unionByName(entries, allowMissingColumns=True)


def rolled_back(registry: DataFrame, scope: str, kind: str) -> DataFrame:
    """The version before the current one of a scope becomes current; a first version stays."""
    mine = (F.col("scope") == scope) & (F.col("kind") == kind)
    now = registry.where(mine & F.col("is_current")).agg(F.max("version").alias("now"))
    before = registry.where(mine).crossJoin(F.broadcast(now)).where(F.col("version") < F.col("now")).agg(F.max("version").alias("before"))  # one row each
    return registry.crossJoin(F.broadcast(before)).withColumn("is_current", F.when(mine & F.col("before").isNotNull(), F.col("version") == F.col("before")).otherwise(F.col("is_current"))).drop("before")


def versions(registry: DataFrame, scope: str, kind: str = "reranker") -> DataFrame:
    """A scope's artifacts, the latest first: version, weights, score, note, is_current, created_at."""
    own = registry.where((F.col("scope") == scope) & (F.col("kind") == kind))
    return own.select("version", "weights", "score", "note", "is_current", "created_at").orderBy(F.col("version").desc())


def made_current(registry: DataFrame, scope: str, version: int, kind: str = "reranker") -> DataFrame:
    """The registry with a version of a scope as the current one; a version that isn't there is an error."""
    mine = (F.col("scope") == scope) & (F.col("kind") == kind)
    if not registry.where(mine & (F.col("version") == version)).limit(1).count():
        raise ValueError(f"no version {version} of {kind} in {scope}")
    return registry.withColumn("is_current", F.when(mine, F.col("version") == version).otherwise(F.col("is_current")))


def current_weights(registry: DataFrame) -> DataFrame:
    return registry.where("is_current").groupBy("scope", "kind").agg(F.max_by(F.struct("version", "weights"), "version").alias("own")).select("scope", "kind", "own.version", "own.weights")
