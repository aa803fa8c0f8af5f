"""How much a claim is worth: method, age and confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Base weight and half-life in days of each method; others get the last entry.
METHOD_BASE = {"human": 0.95, "telemetry": 0.90, "code_derived": 0.85, "verifier": 0.80, "llm_inferred": 0.40}
OTHER_BASE = 0.30
HALF_LIFE_DAYS = {"telemetry": 14, "llm_inferred": 30, "verifier": 60, "code_derived": 90, "human": 180}
OTHER_HALF_LIFE = 30


def _lookup(key: Column, table: dict, other: float) -> Column:
    chosen = F.when(F.lit(False), F.lit(float(other)))
    for name, value in table.items():
        chosen = chosen.when(key == name, F.lit(float(value)))
    return chosen.otherwise(F.lit(float(other)))


def method_base(method: Column) -> Column:
    return _lookup(method, METHOD_BASE, OTHER_BASE)


def half_life_days(method: Column) -> Column:
    return _lookup(method, HALF_LIFE_DAYS, OTHER_HALF_LIFE)


def freshness(method: Column, created_at: Column, at: Column) -> Column:
    """Halves with each half-life of the method; claims from the future count as fresh."""
    seconds = F.greatest((F.unix_micros(at) - F.unix_micros(created_at)) / 1e6, F.lit(0.0))
    return F.exp(-F.log(F.lit(2.0)) * seconds / (F.lit(86400.0) * half_life_days(method)))


def weight(method: Column, created_at: Column, confidence: Column, at: Column) -> Column:
    return method_base(method) * freshness(method, created_at, at) * F.coalesce(confidence, F.lit(1.0))


def trust_label(trust: Column) -> Column:
    return F.when(trust >= 0.7, "high").when(trust >= 0.4, "medium").when(trust >= 0.15, "low").otherwise("very low")
