"""Additive score adjustments from a rule table, parameter rewrites and candidate checks."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.operators.candidates import Preferences


@dataclass(frozen=True)
class Adjustment:
    """If ``asked`` is among the answers, items for which ``test`` (SQL) holds get ``delta`` and ``note``."""

    branch: str
    asked: str
    test: str
    delta: int
    note: str


def adjusted(items: DataFrame, answers: set[str], rules: list[Adjustment], branch: str | None = None) -> DataFrame:
    """Add ``adjustment`` (sum of the deltas that apply) and ``notes`` (distinct, in rule order).

    Rules of another branch do not apply; a test that is null does not hold.
    """
    live = [r for r in rules if r.asked in answers and (branch is None or r.branch in (branch, "any"))]
    total, notes = F.lit(0), []
    for r in live:
        holds = F.coalesce(F.expr(r.test), F.lit(False))
        total = total + F.when(holds, r.delta).otherwise(0)
        notes.append(F.when(holds, F.lit(r.note)))
    found = F.array_distinct(F.array_compact(F.array(*notes))) if notes else F.array().cast("array<string>")
    return items.withColumn("adjustment", total.cast("int")).withColumn("notes", found)


#: Tuning modes: each rewrites the preferences, in the order in which they are chosen.
TUNING = {
    "cheaper": lambda p: replace(p, budget=(0.0, p.budget[1] * 0.8) if p.budget else (0.0, 300.0)),
    "quieter": lambda p: replace(p, max_noise=max(1, (p.max_noise or 50) - 10)),
    "any_brand": lambda p: replace(p, brand=None),
}


def tuned(p: Preferences, modes: list[str]) -> Preferences:
    """Fold of tuning modes over the preferences; an unknown mode changes nothing."""
    for m in modes:
        p = TUNING.get(m, lambda x: x)(p)
    return p


def boosted(score: Column, key: Column, boosts: dict[str, int]) -> Column:
    """Score plus the boost of the row's key."""
    table = F.create_map(*[F.lit(x) for kv in boosts.items() for x in kv])
    return score + F.coalesce(F.try_element_at(table, key), F.lit(0))


def device_candidate(text: Column, kind: Column, kinds: tuple[str, ...], negative: str, boilerplate: str, strong: str) -> Column:
    """Decision list: no negative pattern, a fitting kind, and a strong signal once boilerplate is gone."""
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), boilerplate, " ")
    return ~clean.rlike(negative) & kind.isin(*kinds) & clean.rlike(strong)
