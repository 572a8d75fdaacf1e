"""Candidate filters: hard and soft constraints, two-tier pools, bands and facets."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talus.functions.columns import ascii_edges


@dataclass(frozen=True)
class Preferences:
    """What a customer asks for; None (and 0 for the limits) means no constraint."""

    kind: str | None = None
    brand: str | None = None
    budget: tuple[float, float] | None = None
    max_noise: int | None = None
    waterproof: int | None = None
    excluded_kinds: tuple[str, ...] = ()
    tags: tuple[str, ...] = field(default=())


def eligible(kind: Column, accessory_kinds: tuple[str, ...]) -> Column:
    """Accessories are never recommended; items without a kind are."""
    return ~F.coalesce(kind.isin(*accessory_kinds), F.lit(False))


def hard_ok(kind: Column, p: Preferences) -> Column:
    """Kinds that are excluded outright; an unknown kind is not. See fullscore.gates for all hard gates."""
    ok = ~F.coalesce(kind.isin(*p.excluded_kinds), F.lit(False)) if p.excluded_kinds else F.lit(True)
    return ok


def soft_checks(price: Column, noise: Column, waterproof: Column, p: Preferences) -> dict[str, Column]:
    """One test per constraint. Unknown noise and waterproofing pass; a missing price counts as 0."""
    checks: dict[str, Column] = {}
    if p.budget:
        low, high = p.budget
        checks["budget"] = F.coalesce(price, F.lit(0.0)).between(low, high)
    if p.max_noise:
        checks["noise"] = noise.isNull() | (noise <= p.max_noise)
    if p.waterproof:
        checks["waterproof"] = waterproof.isNull() | (waterproof >= p.waterproof)
    return checks


def soft_ok(price: Column, noise: Column, waterproof: Column, p: Preferences) -> Column:
    return reduce(lambda a, b: a & b, soft_checks(price, noise, waterproof, p).values(), F.lit(True))


def two_tier(items: DataFrame, hard: Column, soft: Column) -> DataFrame:
    """The relaxed pool in one scan; ``passes_soft`` marks the strict pool inside it."""
    return items.where(hard).withColumn("passes_soft", soft)


def near_misses(items: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Per constraint: items that fail it alone. One aggregate over one scan."""
    counts = []
    for name, check in checks.items():
        others = [c for n, c in checks.items() if n != name]
        rest = reduce(lambda a, b: a & b, others, F.lit(True))
        counts.append(F.count_if(~check & rest).alias(name))
    wide = items.agg(*counts)
    return wide.unpivot([], list(checks), "constraint_name", "only_failing")


def price_band(price: Column, bounds: tuple[float, ...]) -> Column:
    """Label of the price's band; a bound belongs to the band above the first one, else below it.

    The lowest band ends before its bound; every later band holds both of its
    ends that an earlier band has not taken.
    """
    label = F.when(price < bounds[0], F.lit(f"under_{bounds[0]:g}"))
    for low, high in zip(bounds, bounds[1:]):
        label = label.when(price <= high, F.lit(f"{low:g}_to_{high:g}"))
    return label.when(price > bounds[-1], F.lit(f"over_{bounds[-1]:g}"))


def contaminant(*texts: Column, patterns: tuple[str, ...]) -> Column:
    """Does any pattern occur in the joined lower-case text?"""
    hay = F.lower(F.concat_ws(" ", *texts))
    return hay.rlike("|".join(f"(?:{ascii_edges(x)})" for x in patterns))


def valid_choice(choice: str, known: list[str], default: str = "all") -> str:
    """A stored facet choice, or the default if the facet no longer has it."""
    return choice if choice in known else default


def valid_choices(rows: DataFrame, choice: str, known: DataFrame, code: str, default: str = "all") -> DataFrame:
    """``rows`` with choices that ``known`` does not have replaced by the default; a null choice is one of them."""
    codes = known.select(F.col(code).alias("known_")).distinct()
    out = rows.join(codes, F.col(choice) == F.col("known_"), "left")
    return out.select(*[F.coalesce("known_", F.lit(default)).alias(choice) if c == choice else F.col(c) for c in rows.columns])


def of_origin(rows: DataFrame, domestic: str, origin: str) -> DataFrame:
    """Rows of an origin: all, domestic (true) or foreign (false); a null is neither."""
    return rows if origin == "all" else rows.where(F.col(domestic).eqNullSafe(F.lit(origin == "domestic")))


def only_favourites(rows: DataFrame, key: Column, favourites: DataFrame, favourite: str) -> DataFrame:
    """Rows whose key is among the favourites, as a semi join; the key is the original id where there is one, else the id."""
    liked = favourites.select(F.col(favourite).alias("liked_")).distinct()
    return rows.withColumn("key_", key).join(liked, F.col("key_") == F.col("liked_"), "left_semi").drop("key_")


def brand_options(rows: DataFrame, brand: str, domestic: str, origin: str) -> DataFrame:
    """(place, brand): the different filled brands of an origin, sorted, whatever else is filtered.

    The list of brands is what a page shows, and is numbered in one task; it
    is the distinct names that come there, not their rows.
    """
    names = of_origin(rows, domestic, origin).where(F.coalesce(F.col(brand), F.lit("")) != "").select(F.col(brand).alias("brand")).distinct()
    return names.select(F.row_number().over(Window.orderBy("brand")).alias("place"), "brand")
