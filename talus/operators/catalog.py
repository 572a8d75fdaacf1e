"""Catalog maintenance: fallback joins, merges, upserts, duplicate groups, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talus.functions.columns import ascii_edges, first_filled, is_blank, is_filled, squeezed


def fallback_join(items: DataFrame, brands: DataFrame, key: str, name: str) -> DataFrame:
    """Left join by ``key``; where that misses, by lower-case ``name``. Brand columns take the first hit.

    A brand name that occurs in several spellings fans out, as in the plain
    join. The items are joined once: each row looks for its brand under one
    of two kinds of keys, the name only if no brand has its key. Rows with
    neither look for nothing and take no part in the join.
    """
    cols = [c for c in brands.columns if c not in (key, name)]
    known = brands.select(F.col(key).alias("known_")).where("known_ IS NOT NULL").distinct()
    tagged = items.join(known, F.col(key) == F.col("known_"), "left")
    by_key, by_name = F.struct(F.lit(0).alias("kind"), F.col(key).cast("string").alias("key")), F.struct(F.lit(1).alias("kind"), F.lower(name).alias("key"))
    probe = F.when(F.col("known_").isNotNull(), by_key).when(~is_blank(F.col(name)), by_name)
    tagged = tagged.select(*items.columns, probe.alias("probe_"))
    index = brands.select(by_key.alias("probe_"), *cols).unionByName(brands.select(by_name.alias("probe_"), *cols))
    found = tagged.where("probe_ IS NOT NULL").join(index.where("probe_.key IS NOT NULL"), "probe_", "left")
    none = tagged.where("probe_ IS NULL").select(*items.columns, *[F.lit(None).cast(brands.schema[c].dataType).alias(c) for c in cols])
    return found.select(*items.columns, *cols).unionByName(none)


def latest_wins(rows: DataFrame, keys: list[str], newest: list[Column]) -> DataFrame:
    """One row per key, the newest: the result of an upsert in which the last write wins."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))).where("rn = 1").drop("rn")


def insert_ignore(target: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows of ``new`` whose key the target lacks, the first of each key in ``order`` (default: the other columns)."""
    rest = [c for c in new.columns if c not in keys]
    order = [*(order or ()), *[c for c in rest if c not in (order or ())]]
    if rest:
        new = new.groupBy(*keys).agg(F.min(F.struct(*order)).alias("first_")).select(*[F.col(c) if c in keys else F.col(f"first_.{c}").alias(c) for c in new.columns])
    else:
        new = new.distinct()
    return new.join(target, keys, "left_anti").select(*new.columns)


def keep_filled(target: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Upsert in which a null new value keeps the old one."""
    cols = [c for c in target.columns if c != key]
    both = target.alias("t").join(new.alias("n"), key, "full")
    return both.select(key, *[F.coalesce(F.col(f"n.{c}"), F.col(f"t.{c}")).alias(c) for c in cols])


def patched(target: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Update from a patch table: its non-null values replace, other rows stay."""
    cols = [c for c in target.columns if c != key]
    p = patch.select(key, *[F.col(c).alias(f"new_{c}") for c in patch.columns if c != key])
    out = target.join(p, key, "left")
    return out.select(key, *[F.coalesce(f"new_{c}", c).alias(c) if f"new_{c}" in out.columns else F.col(c) for c in cols])


def priority_match(probes: DataFrame, rows: DataFrame, on: Column, order: list[Column], by: list[str]) -> DataFrame:
    """Best row per probe by priority, then order; probes without a row are left out."""
    out = probes.join(rows, on)
    return out.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("rn = 1").drop("rn")


def duplicate_groups(rows: DataFrame, key: str, score: Column, id_: str) -> DataFrame:
    """Rows of groups of two or more with the same key: size and keeper (highest score, least id).

    Sizes and keepers come from one pre-aggregated group-by, so a hot key
    costs one row per task before the join back.
    """
    rows = rows.where(~is_blank(F.col(key)))
    best = F.min_by(F.col(id_), F.struct(-score, F.col(id_)))
    groups = rows.groupBy(key).agg(F.count("*").alias("n"), best.alias("keeper")).where("n > 1")
    return rows.join(groups, key)


def merged_fields(groups: DataFrame, key: str, order: list[Column], first: list[str], longest: list[str], more: dict[str, Column] | None = None) -> DataFrame:
    """One row per group, of all its rows: first filled value in keeper order, or the longest text (earlier wins ties).

    ``order`` should tell apart any two rows with different values; ``more`` are further aggregates by name.
    """
    rank = F.struct(*order)
    aggs = [F.min_by(F.col(c), F.when(~is_blank(F.col(c).cast("string")), rank)).alias(c) for c in first]
    aggs += [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(-F.length(c), *order))).alias(c) for c in longest]
    return groups.groupBy(key).agg(*aggs, *[a.alias(n) for n, a in (more or {}).items()])


def keep_first(rows: DataFrame, keys: list[str], ordinal: str, placeholder: Column) -> DataFrame:
    """First row per key in input order; placeholders are never dropped."""
    first = rows.where(~placeholder).groupBy(*[F.col(k).alias(f"first_{k}") for k in keys]).agg(F.min(ordinal).alias("first_at"))
    same = [F.col(k).eqNullSafe(F.col(f"first_{k}")) for k in keys]
    out = rows.join(first, same, "left").where(placeholder | (F.col(ordinal) == F.col("first_at")))
    return out.select(*rows.columns)


def brand_partition(rows: DataFrame, name: str, brand: str) -> DataFrame:
    """Group key of same-name rows: brandless rows join the brand only if the name has exactly one."""
    per = rows.groupBy(name).agg(F.count_distinct(F.when(~is_blank(F.col(brand)), F.lower(brand))).alias("brands"), F.min(F.when(~is_blank(F.col(brand)), F.lower(brand))).alias("only"))
    out = rows.join(per, name)
    own = F.when(~is_blank(F.col(brand)), F.lower(brand)).when(F.col("brands") == 1, F.col("only")).otherwise("")
    return out.withColumn("group_key", F.concat_ws("|", F.lower(name), own)).drop("brands", "only")


def completeness(rows: DataFrame, by: list[Column], fields: dict[str, Column]) -> DataFrame:
    """Per group: rows, and rows that lack each field."""
    return rows.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(lack).alias(f"missing_{n}") for n, lack in fields.items()])


def reference_counts(sources: list[DataFrame], id_: str) -> DataFrame:
    """Counts per id in each source, then their sum over all sources."""
    parts = [s.groupBy(id_).agg(F.count("*").alias("n")) for s in sources]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(id_).agg(F.sum("n").alias("refs"))


def two_key_match(new: DataFrame, target: DataFrame, id_: str, name: str, brand: str, order: str) -> DataFrame:
    """Rows of ``new`` with target_order, the ``order`` of the target they match, and matched_by (id, name_brand or insert).

    A match by a non-empty id goes before one by trimmed lower-case name and
    brand (both filled); of targets with the same key the last one in
    ``order`` counts. New rows are no targets of each other. Both keys look
    up one index, so rows without a key take no part in the join.
    """
    pair = F.concat_ws("\u0000", F.lower(F.trim(name)), F.lower(F.trim(brand)))
    filled = ~is_blank(F.col(name)) & ~is_blank(F.col(brand))
    text = F.col(id_).cast("string")
    keys = F.array(
        F.when(F.coalesce(text, F.lit("")) != "", F.struct(F.lit(0).alias("kind"), text.alias("key"))),
        F.when(filled, F.struct(F.lit(1).alias("kind"), pair.alias("key"))),
    )
    keyed = lambda df: df.select(order, F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("k"))
    index = keyed(target).groupBy("k").agg(F.max(order).alias("target_order"))
    best = keyed(new).join(index, "k").groupBy(order).agg(F.min(F.struct("k.kind", "target_order")).alias("hit"))
    out = new.join(best, order, "left")
    how = F.when(F.col("hit.kind") == 0, "id").when(F.col("hit.kind") == 1, "name_brand").otherwise("insert")
    return out.select(*[F.col(c) for c in new.columns], F.col("hit.target_order").alias("target_order"), how.alias("matched_by"))


def merged_lists(items: DataFrame, url: str, position: str, fill: list[str], hints: str) -> DataFrame:
    """Union of listings by link: least position, first filled fields in position order, union of hints."""
    order = F.col(position)
    aggs = [F.min_by(F.col(c), F.when(~is_blank(F.col(c).cast("string")), order)).alias(c) for c in fill]
    return items.groupBy(url).agg(F.min(order).alias(position), *aggs, F.array_sort(F.array_distinct(F.flatten(F.collect_set(hints)))).alias(hints))


def series_key(name: Column, url: Column, noise: str, marker: str = "/products/") -> Column:
    """The name in lower case without noise words and signs; without one, the URL's slug after the marker in the same way; else the URL."""
    plain = lambda x: squeezed(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), ascii_edges(noise), " "), r"[^\p{L}\p{N}]+", " "))
    address = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"[?#].*$", "")
    slug = F.when(F.contains(address, F.lit(marker)), F.coalesce(F.try_url_decode(F.split_part(F.split_part(address, F.lit(marker), F.lit(2)), F.lit("/"), F.lit(1))), F.lit("")))
    return first_filled(plain(name), plain(slug), address)


def collapse_series(items: DataFrame, key: str, position: str, order: str, fill: list[str], hints: str) -> DataFrame:
    """One row per series: first filled fields in order of position (nulls last), then ``order``; union of hints; rows without a key are left out."""
    place = F.struct(F.col(position).isNull(), F.col(position), F.col(order))
    kinds = dict(items.dtypes)
    firsts = [F.min_by(F.col(c), F.when(is_filled(F.col(c), kinds[c]), place)).alias(c) for c in fill]
    ranked = F.array_sort(F.collect_set(F.struct(place.alias("p"), F.col(hints).alias("h"))))  # bounded by the listings of one series
    union = F.array_distinct(F.flatten(F.transform(ranked, lambda r: F.coalesce(r["h"], F.array().cast("array<string>")))))
    return items.where(~is_blank(F.col(key))).groupBy(key).agg(F.min(position).alias(position), *firsts, union.alias(hints))


def incomplete(rows: DataFrame, fields: list[str], more: dict[str, Column] | None = None) -> DataFrame:
    """Rows that lack any field, with ``missing``, the names of those they lack: what is to be filled again.

    A field is lacking by :func:`talus.functions.columns.is_filled`; ``more``
    are further conditions of lacking by name.
    """
    kinds = dict(rows.dtypes)
    lacks = {f: ~is_filled(F.col(f), kinds[f]) for f in fields} | (more or {})
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in lacks.items()]))
    return rows.withColumn("missing", names).where(F.size("missing") > 0)


def repair_scaled(a: Column, b: Column) -> Column:
    """A price that is about a hundred times the other one is in minor units; unusable prices take the other."""
    ratio = a / b
    return F.when(a.isNull() | (a <= 1), b).when((b > 1) & ratio.between(90, 110), a / 100).otherwise(a)


def recovered_name(*candidates: Column) -> Column:
    """First meaningful name of a chain of candidates."""
    return first_filled(*[F.when(~c.rlike(r"(?i)^(untitled|unknown|n/?a|item ?\d*)$"), c) for c in candidates])
