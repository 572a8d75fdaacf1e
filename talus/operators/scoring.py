"""Weighted scoring of catalog items; weights are data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talus.operators.candidates import Preferences


@dataclass(frozen=True)
class Weights:
    kind: float = 24.0
    brand: float = 12.0
    noise_base: float = 18.0
    noise_step: float = 2.0
    noise_unknown: float = 4.0
    noise_over: float = 0.8
    noise_floor: float = -12.0
    budget: float = 20.0
    midpoint: float = 6.0
    over_budget: float = 2.0
    over_budget_floor: float = -20.0
    waterproof: float = 8.0
    tag: float = 3.0


#: Presets by name; the pool decides which one applies.
PRESETS = {"balanced": Weights(), "brand_led": Weights(kind=16.0, brand=26.0), "quiet": Weights(noise_base=26.0, noise_step=3.0)}


def half_up(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + 0.5)


def budget_gap(price: Column, budget: tuple[float, float]) -> Column:
    low, high = budget
    return F.greatest(F.lit(low) - price, price - F.lit(high), F.lit(0.0))


def score_columns(items: DataFrame, p: Preferences, w: Weights) -> DataFrame:
    """Add score, hard_misses, budget_gap and noise_gap to items with kind, brand, price, noise, waterproof."""
    price = F.coalesce("price", F.lit(0.0))
    low, high = p.budget or (0.0, 1e12)
    gap = budget_gap(price, (low, high))
    over = F.col("noise") - F.lit(p.max_noise or 0)
    kind = F.when(F.col("kind").eqNullSafe(p.kind), w.kind).otherwise(0.0) if p.kind else F.lit(0.0)
    brand = F.when(F.col("brand").eqNullSafe(p.brand), w.brand).otherwise(0.0) if p.brand else F.lit(0.0)
    if p.max_noise:
        noise = (
            F.when(F.col("noise").isNull(), w.noise_unknown)
            .when(over <= 0, w.noise_base + F.least(F.lit(6.0), F.floor(-over / 5) * w.noise_step))
            .otherwise(F.greatest(F.lit(w.noise_floor), -over * w.noise_over))
        )
    else:
        noise = F.lit(0.0)
    middle = (low + high) / 2
    money = F.when(gap == 0, w.budget + F.greatest(F.lit(0.0), w.midpoint - F.abs(price - middle) / 5)).otherwise(
        F.greatest(F.lit(w.over_budget_floor), -gap * w.over_budget)
    )
    water = F.when(F.col("waterproof") >= (p.waterproof or 0), w.waterproof).otherwise(0.0) if p.waterproof else F.lit(0.0)
    misses = (
        (F.when(~F.col("kind").eqNullSafe(p.kind), 1).otherwise(0) if p.kind else F.lit(0))
        + (F.when(over > 10, 1).otherwise(0) if p.max_noise else F.lit(0))
        + F.when(gap > 20, 1).otherwise(0)
    )
    return items.withColumns(
        {
            "score": F.greatest(half_up(kind + brand + noise + money + water), F.lit(0)).cast("long"),
            "hard_misses": misses.cast("int"),
            "budget_gap": gap,
            "noise_gap": (F.greatest(over, F.lit(0)) if p.max_noise else F.lit(0)).cast("int"),
        }
    )


def rank_order() -> list[Column]:
    """Score, hard misses, budget gap, noise gap, waterproofing (unknown last), price, then id."""
    return [
        F.desc("score"),
        F.asc("hard_misses"),
        F.asc("budget_gap"),
        F.asc("noise_gap"),
        F.coalesce("waterproof", F.lit(-1)).desc(),
        F.asc("price"),
        F.asc("id"),
    ]


def top_ranked(scored: DataFrame, pool: int) -> DataFrame:
    """The best ``pool`` rows with their rank. The limit is a distributed top-k; only its rows are numbered."""
    best = scored.orderBy(*rank_order()).limit(pool)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*rank_order())))


def preset_by_share(items: DataFrame, matches: Column, share: float, yes: str, no: str) -> DataFrame:
    """Which preset applies: ``yes`` if at least ``share`` of the pool matches (never for an empty pool)."""
    got = items.agg(F.count("*").alias("pool"), F.avg(matches.cast("double")).alias("share"))
    return got.withColumn("preset", F.when(F.coalesce("share", F.lit(0.0)) >= share, yes).otherwise(no))


def signal_weights(chosen: DataFrame, templates: DataFrame, by: str) -> DataFrame:
    """Answers joined with their signal templates; the heaviest weight per signal counts."""
    return chosen.join(F.broadcast(templates), "answer").groupBy(by, "signal").agg(F.max("weight").alias("weight"))
