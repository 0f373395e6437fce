"""Explicit schemas of the engine's tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

#: Types by the names that columns are declared with; no session is needed to declare a table.
TYPES = {
    "long": T.LongType(), "int": T.IntegerType(), "short": T.ShortType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()), "array<long>": T.ArrayType(T.LongType()), "array<float>": T.ArrayType(T.FloatType()),
    "map<string,string>": T.MapType(T.StringType(), T.StringType()), "map<string,double>": T.MapType(T.StringType(), T.DoubleType()),
}


def table(columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])


MEMORIES = table(
    "id long, scope string, kind string, title string, body string, tags array<string>, metadata map<string,string>, embedding array<float>, "
    "importance float, decay_rate float, was_truncated boolean, created_at timestamp, updated_at timestamp, tier short, consolidated_at timestamp"
)
FACTS = table("id long, scope string, subject string, predicate string, object string, valid_from timestamp, valid_until timestamp, source_memory_id long, created_at timestamp")
OBSERVATIONS = table(
    "id long, scope string, body string, proof_count int, evidence_ids array<long>, evidence_quotes array<string>, freshness_trend string, "
    "last_reinforced timestamp, created_at timestamp, importance float, embedding array<float>"
)
REINFORCEMENTS = table("id long, memory_id long, scope string, event_type string, delta float, note string, created_at timestamp")
RETRIEVALS = table("id long, scope string, query string, candidate_ids array<long>, created_at timestamp")
WEIGHTS = table("id long, scope string, kind string, version int, weights map<string,double>, score double, note string, is_current boolean, created_at timestamp")
PROMOTIONS = table("id long, scope string, kind string, decision string, new_score double, incumbent_score double, n_train int, n_gate int, version int, note string, created_at timestamp")
DIGESTS = table("scope string, last_digested_at timestamp")

EVENT_TYPES = ("direct_command", "mistake", "reversal", "praise", "miss")
TRENDS = ("strengthening", "stable", "weakening", "stale")


def differences(found: T.StructType, expected: T.StructType) -> list[tuple[str, str | None, str | None]]:
    """Columns that are missing, extra or of another type: name, found type, expected type."""
    a, b = ({f.name: f.dataType.simpleString() for f in s.fields} for s in (found, expected))
    return sorted((k, a.get(k), b.get(k)) for k in a.keys() | b.keys() if a.get(k) != b.get(k))
