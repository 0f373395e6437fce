"""Signals and preferences in text, as chains of JVM regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text
from . import learning, models, search

#: Patterns of signals on lower-cased text, what they signal, and how sure they are.
SIGNALS = (
    (r"^\s*no[,.\s]", "correction", 0.85),
    (r"that'?s?\s+wrong", "correction", 0.9),
    (r"that'?s?\s+not\s+right", "correction", 0.9),
    (r"that'?s?\s+incorrect", "correction", 0.9),
    (r"(?<![a-z])incorrect(?![a-z])", "correction", 0.8),
    (r"(?<![a-z])actually(?![a-z])", "correction", 0.6),
    (r"we\s+don'?t", "correction", 0.75),
    (r"we\s+do\s+not", "correction", 0.75),
    (r"not\s+how\s+we", "correction", 0.85),
    (r"instead\s+of", "correction", 0.6),
    (r"should\s+have", "correction", 0.7),
    (r"shouldn'?t\s+have", "correction", 0.75),
    (r"(?<![a-z])always(?![a-z])", "command", 0.8),
    (r"(?<![a-z])never(?![a-z])", "command", 0.8),
    (r"make\s+sure\s+to", "command", 0.75),
    (r"remember\s+to", "command", 0.75),
    (r"from\s+now\s+on", "command", 0.8),
    (r"going\s+forward", "command", 0.7),
    (r"you\s+must", "command", 0.75),
    (r"(?<![a-z])exactly(?![a-z])", "praise", 0.8),
    (r"that'?s?\s+right", "praise", 0.85),
    (r"that'?s?\s+correct", "praise", 0.85),
    (r"(?<![a-z])perfect(?![a-z])", "praise", 0.7),
    (r"well\s+done", "praise", 0.7),
    (r"(?<![a-z])yes(?![a-z]).*?thank", "praise", 0.7),
)
EVENT_OF = {"correction": "mistake", "command": "direct_command", "praise": "praise"}
MIN_CONFIDENCE, MIN_SIMILARITY = 0.6, 0.15

#: Patterns of preferences on lower-cased sentences, in the order in which they are tried, and what they say.
PREFERENCES = (
    (r"i\s+switched\s+from\s+(.*?)\s+to\s+(.+)", "switched from {1} to {2}"),
    (r"i\s+prefer\s+(.*?)\s+over\s+(.+)", "prefers {1} over {2}"),
    (r"i\s+usually\s+prefer\s+(.+)", "preference for {1}"),
    (r"i\s+prefer\s+(.+)", "preference for {1}"),
    (r"my\s+preference\s+is\s+(.+)", "preference for {1}"),
    (r"i\s+always\s+(.+)", "always {1}"),
    (r"i\s+never\s+(.+)", "never {1}"),
    (r"i\s+tend\s+to\s+(.+)", "tends to {1}"),
    (r"i\s+really\s+love\s+(.+)", "likes {1}"),
    (r"i\s+love\s+(.+)", "likes {1}"),
    (r"i\s+really\s+like\s+(.+)", "likes {1}"),
    (r"i\s+like\s+(.+)", "likes {1}"),
    (r"i\s+really\s+hate\s+(.+)", "dislikes {1}"),
    (r"i\s+hate\s+(.+)", "dislikes {1}"),
    (r"i\s+don.t\s+like\s+(.+)", "dislikes {1}"),
    (r"i\s+dislike\s+(.+)", "dislikes {1}"),
    (r"i\s+avoid\s+(.+)", "avoids {1}"),
    (r"i\s+find\s+(.*?)\s+([a-z]+)$", "finds {1} {2}"),
    (r"i.m\s+comfortable\s+with\s+(.+)", "comfortable with {1}"),
    (r"i\s+still\s+remember\s+(.+)", "nostalgic about {1}"),
    (r"i\s+used\s+to\s+(.+)", "used to {1}"),
)
PREFIX, MOST_BYTES = "User has mentioned: ", 5000


def confidence(lowered: Column, kind: str) -> Column:
    """The surest pattern of a kind that occurs, or null."""
    found = [F.when(lowered.rlike(f"(?s){p}"), c) for p, k, c in SIGNALS if k == kind]
    return F.greatest(*found)


def signals(turns: DataFrame, text_col: str = "text", role_col: str | None = "role") -> DataFrame:
    """A row for each turn of the user and kind of signal in it: all columns, kind, event_type, confidence."""
    own = turns.where(F.col(role_col).isNull() | F.col(role_col).isin("user", "human")) if role_col else turns
    own = own.where(F.col(text_col) != "")
    lowered = text.ascii_lower(F.col(text_col))
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(e).alias("event_type"), confidence(lowered, k).alias("confidence")) for k, e in EVENT_OF.items()])
    return own.withColumn("_s", F.explode(F.filter(found, lambda s: s["confidence"].isNotNull()))).select(*turns.columns, "_s.*")


def _capture(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s*[.!?]?\s*$", "")


def preference(sentence: Column) -> Column:
    """What the first pattern that occurs in a lower-cased sentence says, or null."""
    tried = []
    for pattern, says in PREFERENCES:
        full, parts, rest = f"(?s){pattern}", [F.lit(PREFIX)], says
        for piece in _pieces(rest):
            parts.append(_capture(F.regexp_extract(sentence, full, int(piece[1]))) if piece[0] == "{" else F.lit(piece))
        tried.append(F.when(sentence.rlike(full), F.concat(*parts)))
    return F.when(sentence.rlike(r"(?s)i[\s']|my\s"), F.coalesce(*tried))


def _pieces(says: str) -> list[str]:
    import re

    return [x for x in re.split(r"(\{\d\})", says) if x]


def preferences(rows: DataFrame, key: str, body: str) -> DataFrame:
    """key, preference: the distinct preferences that a body of at most MOST_BYTES mentions."""
    own = rows.where(F.octet_length(body) <= MOST_BYTES).select(key, F.explode(text.sentences(F.col(body))).alias("_s"))
    return own.select(key, preference(F.col("_s")).alias("preference")).where("preference is not null").distinct()


def companions(rows: DataFrame) -> DataFrame:
    """Rows of kind fact that carry the preferences of rows that aren't such companions themselves."""
    own = rows.where(~F.coalesce(F.col("metadata")["is_synthetic"] == "true", F.lit(False)))
    found = preferences(own, "id", "body").join(own.select("id", "scope"), "id")
    return found.select("scope", F.lit("fact").alias("kind"), F.col("preference").alias("title"), F.col("preference").alias("body"), F.lit(0.4).alias("importance"), F.create_map(F.lit("is_synthetic"), F.lit("true"), F.lit("source_id"), F.col("id").cast("string")).alias("metadata"))


def marker(body: Column) -> Column:
    """Notes with it as their prefix make a second sensing of the same text do nothing."""
    return F.concat(F.lit("sensing:"), text.djb2_hex(body))


def unseen(found: DataFrame, reinforcements: DataFrame) -> DataFrame:
    """Signals (scope, kind, text) whose marker isn't in the scope's notes yet."""
    known = reinforcements.where(F.col("note").startswith("sensing:")).select("scope", F.substring("note", 1, 16).alias("_marker")).distinct()
    own = found.withColumn("_marker", marker(F.concat_ws("|", "kind", "text"))).dropDuplicates(["scope", "_marker"])
    return own.join(known, ["scope", "_marker"], "left_anti").withColumnRenamed("_marker", "note")


def attributed(found: DataFrame, memories: DataFrame, embedder: models.Embedder, least: float = MIN_SIMILARITY) -> DataFrame:
    """Signals (id, scope, text and others) with memory_id and similarity: the nearest memory (id, scope, embedding) of the scope, if near enough."""
    told = models.embedded(found.select("id", "scope", "text").dropDuplicates(["id"]), "text", embedder)
    best = search.batch_top(told.select("id", "scope", F.col("embedding")), memories.select((-F.col("id") - 1).alias("id"), "scope", "embedding"), "id", "embedding", 1, F.col("scope"), least)
    return found.join(best.select(F.col("query_id").alias("id"), (-F.col("id") - 1).alias("memory_id"), "similarity"), "id", "left")


def recorded(found: DataFrame, memories: DataFrame, embedder: models.Embedder, reinforcements: DataFrame, retrievals: DataFrame, as_of: Column, least: float = MIN_CONFIDENCE, scale: float = 1.0) -> DataFrame:
    """Reinforcements that signals (id, scope, text, event_type, confidence) give: of the memory each refers to, once a memory and type, none that is noted already.

    A mistake about a memory that retrieval never showed is a miss.
    """
    own = attributed(found.where(F.col("confidence") >= least), memories, embedder).where("memory_id is not null")
    own = learning.misses(own, retrievals).withColumn("event_type", F.col("final_type")).drop("final_type")
    one = F.min(F.struct("id", "text", "confidence")).alias("own")
    own = own.groupBy("scope", "memory_id", "event_type").agg(one).select("scope", "memory_id", "event_type", "own.text", "own.confidence")
    own = own.withColumn("_marker", marker(F.concat_ws("|", "scope", "text", "event_type")))
    known = reinforcements.where(F.col("note").startswith("sensing:")).select("scope", "memory_id", F.substring("note", 1, 16).alias("_marker")).distinct()
    new = own.join(known, ["scope", "memory_id", "_marker"], "left_anti")
    return new.select("memory_id", "scope", "event_type", (F.col("confidence") * scale).alias("delta"), F.concat_ws(" ", "_marker", F.substring("text", 1, 80)).alias("note"), as_of.alias("created_at"))


def parsed_extractions(rows: DataFrame, answer: str) -> DataFrame:
    """rows with event_type, statement and confidence of each object in a model's answer, a JSON array; answers that aren't one give none."""
    kind = "array<struct<event_type:string,statement:string,confidence:double>>"
    array = F.regexp_extract(F.col(answer), r"(?s)(\[.*\])", 1)
    own = rows.withColumn("_x", F.explode(F.from_json(array, kind))).select(*rows.columns, "_x.*")
    return own.where(F.col("event_type").isin(*EVENT_OF.values(), "reversal") & (F.trim("statement") != ""))


def grounded(found: DataFrame, statement: str, source: str, least: int = 2) -> DataFrame:
    """Extractions that share at least so many words of four letters or more with their source."""
    return found.where(text.shared_words(F.col(statement), F.col(source)) >= least)
