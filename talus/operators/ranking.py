"""Orders, diversified picks, reconciliation with an outside order, pivots and checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def diversified(ranked: DataFrame, label: str, n: int) -> DataFrame:
    """First of each label in rank order, then the rest in rank order, n rows.

    ``ranked`` is a bounded pool with a ``rank``; the window form equals the
    greedy loop.
    """
    first = F.row_number().over(Window.partitionBy(label).orderBy("rank"))
    order = [F.when(F.col("label_rn") > 1, 1).otherwise(0), F.col("rank")]
    out = ranked.withColumn("label_rn", first).orderBy(*order).limit(n)
    return out.withColumn("pick", F.row_number().over(Window.orderBy(*order))).drop("label_rn")


def reconciled(pool: DataFrame, outside: DataFrame, n: int) -> DataFrame:
    """An outside order (id, ext_rank) cut to the pool, each id once, padded from the pool, n rows."""
    once = outside.groupBy("id").agg(F.min("ext_rank").alias("ext_rank"))
    order = F.coalesce(F.col("ext_rank").cast("double"), F.lit(1e9) + F.col("rank"))
    out = pool.join(once, "id", "left").orderBy(order, "id").limit(n)
    return out.withColumn("final_rank", F.row_number().over(Window.orderBy(order, "id")))


def min_max(x: str, unknown: float = -1.0, constant: float = 0.5) -> Column:
    """Normalised position of a value between the columns min_x and max_x of its pool."""
    low, high = F.col(f"min_{x}"), F.col(f"max_{x}")
    return F.when(F.col(x).isNull(), unknown).when(high == low, constant).otherwise((F.col(x) - low) / (high - low))


def with_range(items: DataFrame, *names: str) -> DataFrame:
    """Add min_x and max_x of the whole pool (nulls skipped) from a one-row aggregate."""
    ends = [f(n).alias(f"{p}_{n}") for n in names for p, f in (("min", F.min), ("max", F.max))]
    return items.crossJoin(F.broadcast(items.agg(*ends)))  # one row


def best_direction(options: list[tuple[str, Column]]) -> Column:
    """Name of the option with the largest value; the earlier one wins ties."""
    pairs = F.array(*[F.struct(v.cast("double").alias("v"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, v) in enumerate(options)])
    return F.array_max(pairs)["name"]


def comparison(ranked: DataFrame, attributes: dict[str, str], columns: int) -> DataFrame:
    """One row per attribute, one column per ranked item (item_1, item_2, ...)."""
    text = ranked.select("rank", *[F.col(c).cast("string").alias(a) for a, c in attributes.items()])
    long = text.unpivot(["rank"], list(attributes), "attribute", "value")
    cells = [F.max(F.when(F.col("rank") == k, F.col("value"))).alias(f"item_{k}") for k in range(1, columns + 1)]
    return long.groupBy("attribute").agg(*cells)


def checked(ranked: DataFrame, top: int, forbidden: list, required: list, label: str) -> DataFrame:
    """Scenario check: the first id, forbidden and required labels in the top rows, and the failures."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", label))), lambda r: r)
    got = ranked.where(F.col("rank") <= top).agg(ids.alias("r"))
    have = F.transform("r", lambda r: r[label])
    bad = F.array_intersect(F.array_distinct(have), F.array(*map(F.lit, forbidden)))
    lack = F.array_except(F.array(*map(F.lit, required)), have)
    return got.select(
        F.col("r")[0]["id"].alias("top1"),
        F.size(bad).alias("n_forbidden"),
        F.size(lack).alias("n_missing"),
        ((F.size(bad) == 0) & (F.size(lack) == 0)).alias("passed"),
    )


def confidence(hard_misses: Column, score: Column, gap: Column, least: float = 70) -> Column:
    """Backup for two hard misses or a score under ``least``, conditional for one or any gap, else high."""
    return F.when((hard_misses >= 2) | (score < least), "backup").when((hard_misses > 0) | (gap > 0), "conditional").otherwise("high")


def match_summary(lines: list[tuple[Column, str]], n: int = 4) -> Column:
    """First n distinct lines of the conditions that hold, in order."""
    got = F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in lines]))
    return F.slice(F.array_distinct(got), 1, n)


def primary_reason(lines: Column, score: Callable[[Column, Column], Column], fallback: Column, n: int = 2, gap: str = ", ") -> Column:
    """The n different filled lines of the highest score, earlier ones first at equal scores, joined; without a line the fallback.

    ``score`` takes a line and its index among the different ones.
    """
    distinct = F.array_distinct(F.filter(F.coalesce(lines, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")))
    ranked = F.array_sort(F.transform(distinct, lambda x, i: F.struct((-score(x, i)).alias("s"), i.alias("i"), x.alias("line"))))
    best = F.transform(F.slice(ranked, 1, n), lambda r: r["line"])
    return F.when(F.size(best) > 0, F.array_join(best, gap)).otherwise(fallback)
