"""Exact candidate pairs from inverted indexes: tokens, substrings and letter sets, with long postings dealt to salts.

A pair leaves an index once: it is kept under the first key that its two
sides share, which needs no ``distinct`` over the pairs. The rows of a key
that holds many are split over as many salts as they fill blocks, and the rows
of the other side are copied to each, so that no key's rows meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.sources.tables import written

#: Rows of a key in one task, about.
BLOCK = 20_000
#: Keys are hot, and salted, only if they also have this share of all rows: at most 1 / HOT keys.
HOT = 0.001
#: Characters of a needle that its index key has, at most.
ANCHOR = 8


def salted_join(left: DataFrame, right: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """``left`` and ``right`` joined on ``key``, the long postings of ``right`` in blocks. Both are read twice; no other common columns."""
    counts = right.groupBy(key).agg(F.count("*").alias("n_"))
    total = counts.agg(F.sum("n_")).first()[0] or 0
    hot = counts.where(F.col("n_") > max(block, HOT * total)).select(key, F.ceil(F.col("n_") / block).alias("salts_"))
    hot = F.broadcast(hot)  # at most 1 / HOT rows
    salt = F.coalesce(F.pmod(F.xxhash64(*right.columns), F.col("salts_")), F.lit(0)).alias("salt_")
    dealt = right.join(hot, key, "left").select(*right.columns, salt)
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts_", F.lit(1)) - 1)).alias("salt_")
    return left.join(hot, key, "left").select(*left.columns, copies).join(dealt, [key, "salt_"]).drop("salt_")


def containing(needles: DataFrame, needle: str, hays: DataFrame, hay: str, ratio: float = 0.0) -> DataFrame:
    """``hays`` with each needle that its (short) text contains, once; with ``ratio``, only needles of that share of the text's length.

    A needle's key is its first characters, ANCHOR at most; a text meets it by
    its substrings of those lengths, each different one once.
    """
    n = needles.where(F.length(needle) > 0).select(needle).distinct()
    n = n.withColumn("gram_", F.left(needle, F.lit(ANCHOR)))
    sizes = sorted(r[0] for r in n.select(F.length("gram_")).distinct().collect())  # ANCHOR numbers at most
    each = hays.withColumn("k_", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>")))
    each = each.where((F.length(hay) >= F.col("k_")) & ((F.col("k_") == ANCHOR) | (F.col("k_") >= F.length(hay) * ratio)))
    places = F.sequence(F.lit(1), F.length(hay) - F.col("k_") + 1)
    grams = F.array_distinct(F.transform(places, lambda i: F.substring(F.col(hay), i, F.col("k_"))))
    each = each.select(*hays.columns, F.explode(grams).alias("gram_"))
    met = salted_join(n, each, "gram_").drop("gram_")
    return met.where(F.contains(hay, needle) & (F.length(needle) >= F.length(hay) * ratio))


def sharing(left: DataFrame, x: str, right: DataFrame, y: str) -> DataFrame:
    """Pairs of rows whose arrays x and y have an element in common, each once."""
    a = left.withColumn("token_", F.explode(F.array_distinct(x)))
    b = right.withColumn("token_", F.explode(F.array_distinct(y)))
    met = salted_join(a, b, "token_")
    return met.where(F.element_at(F.array_intersect(x, y), 1) == F.col("token_")).drop("token_")


def letters(text: Column) -> Column:
    """The different characters of a text but white space, in order."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.regexp_replace(text, r"\s+", ""), ""), lambda c: c != "")))


def alike(left: DataFrame, x: str, right: DataFrame, y: str, least: float) -> DataFrame:
    """(x, y) of the different non-empty sets in columns x and y whose Dice coefficient is ``least`` (above 0) or more.

    Sets are compared in the order of the rarest element. With n elements, at
    least n * least / (2 - least) are shared, so the rarest others and one
    more hold a shared one: only they are keys, and only partners of a size
    that can reach the limit are compared.
    """
    both = left.select(F.col(x).alias("set_")).union(right.select(F.col(y).alias("set_"))).distinct()
    ranks = both.select(F.explode("set_").alias("c_")).groupBy("c_").agg(F.count("*").alias("f_"))
    share = least / (2 - least) - 1e-9

    def keyed(df: DataFrame, name: str) -> DataFrame:
        sets = df.select(name).where(F.size(name) > 0).distinct()
        ranked = salted_join(ranks, sets.withColumn("c_", F.explode(name)), "c_").groupBy(name).agg(F.array_sort(F.collect_list(F.struct("f_", "c_"))).alias("o_"))
        rare = F.col("o_.c_")
        keep = F.size(rare) - F.ceil(F.size(rare) * share).cast("int") + 1
        return ranked.select(name, rare.alias(f"{name}_by_rank"), F.explode(F.slice(rare, F.lit(1), keep)).alias("c_"))

    met = salted_join(keyed(left, x), written(keyed(right, y), "keys"), "c_")
    n, m = F.size(x), F.size(y)
    met = met.where((m >= n * share) & (n >= m * share))
    shared = F.array_intersect(f"{x}_by_rank", f"{y}_by_rank")
    met = met.where((F.element_at(shared, 1) == F.col("c_")) & (2 * F.size(shared) >= (least - 1e-9) * (n + m)))
    return met.select(x, y)
