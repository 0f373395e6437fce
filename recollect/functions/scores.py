"""Scalar rules of importance, tiers, decay, freshness and ranking."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DAY_MICROS = 86400e6


def tier_of(importance: Column) -> Column:
    i = importance.cast("double")
    return F.when(i < 0.3, 0).when(i < 0.6, 1).when(i < 0.85, 2).otherwise(3)


def clamped_tier(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(3), F.floor(value).cast("int")))


def age_days(at: Column, as_of: Column) -> Column:
    """Not less than 0."""
    return F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros(at)) / F.lit(DAY_MICROS))


def decay_weight(importance: Column, decay_rate: Column, updated_at: Column, as_of: Column) -> Column:
    return importance.cast("double") * F.exp(-decay_rate.cast("double") * age_days(updated_at, as_of))


def escalated(importance: Column, events: Column, alpha: float = 0.4) -> Column:
    """Toward 1 with the number of events, never down."""
    x = F.greatest(F.lit(0.0), events.cast("double"))
    return F.greatest(importance.cast("double"), 1 - 1 / (1 + alpha * x))


def _strength(delta: Column) -> Column:
    return F.least(F.abs(F.coalesce(delta.cast("double"), F.lit(0.5))), F.lit(1.0))


def diminished(importance: Column, delta: Column) -> Column:
    """Toward 0.3, within 0 and 1."""
    c = F.coalesce(importance.cast("double"), F.lit(0.5))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c - (c - 0.3) * _strength(delta) * 0.5))


def bumped(importance: Column, delta: Column) -> Column:
    """Toward 1, never down; what is over 1 stays."""
    c = F.coalesce(importance.cast("double"), F.lit(0.5))
    return F.greatest(c, F.least(F.lit(1.0), c + (1 - c) * _strength(delta) * 0.5))


def freshness(last: Column, proofs: Column, as_of: Column) -> Column:
    """By days since the last reinforcement and the number of proofs."""
    days = age_days(last, as_of)
    return F.when((days < 7) & (proofs >= 3), "strengthening").when(days < 30, "stable").when(days < 90, "weakening").otherwise("stale")


def proof_boost(proofs: Column) -> Column:
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + F.log(F.greatest(F.lit(1.0), proofs.cast("double"))) / 10))
    return 1 + 0.1 * (share - 0.5)


def observation_score(similarity: Column, proofs: Column, trend: Column) -> Column:
    return similarity * proof_boost(proofs) * F.when(trend == "stale", 0.85).otherwise(1.0)


def proximity(at: Column, centre: float, half: float) -> Column:
    """1 in the middle of a window of epoch seconds, 0 from its edge on."""
    return F.greatest(F.lit(0.0), 1 - F.abs(F.unix_micros(at) / 1e6 - centre) / half)


def proximity_boost(at: Column, centre: float, half: float, alpha: float = 0.2) -> Column:
    return 1 + alpha * (proximity(at, centre, half) - 0.5) if half > 0 else F.lit(1.0)


def importance_error(importance: Column, decay_rate: Column) -> Column:
    """Null where both are in range."""
    bad = lambda c, most: c.isNotNull() & ((c < 0) | (c > most) | F.isnan(c.cast("double")))
    return F.when(bad(importance, 10), "importance must be in [0, 10]").when(bad(decay_rate, 1), "decay_rate must be in [0, 1]")


#: Marks of a body that negates or changes something.
NEGATIONS = ("no longer", "not ", " not$", "stopped", "won't", "changed", "instead", "reversed", "removed", "dropped", "deprecated")


def negates(lowered: Column) -> Column:
    found = F.lit(False)
    for mark in NEGATIONS:
        found = found | F.contains(lowered, F.lit(mark))
    return found
