"""Links: canonical forms, patch rules with reasons, patches from JSON, counts of what a patch or a deletion does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions.columns import squeezed


def query_id(url: Column) -> Column:
    """The number in a link's id parameter; blank if there is none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"[?&]id=(\d+)(?:[&#]|$)", 1)


def canonical_link(url: Column, shop: str, prefix: str) -> Column:
    """A shop link (pattern ``shop``) as ``prefix`` and its item id; scheme-less links get https."""
    link, number = squeezed(url), query_id(squeezed(url))
    return F.when((number != "") & link.rlike(shop), F.concat(F.lit(prefix), number)).when(link.startswith("//"), F.concat(F.lit("https:"), link)).otherwise(link)


def link_patch(current: Column, product: Column, shop: str, prefix: str) -> Column:
    """Struct (next_link, reason) of the patch that a row's link needs, null if none.

    Links of two different items are left alone; else a link becomes
    canonical, one that is no link is replaced by the product's, and a missing
    one is filled from it.
    """
    here, other = squeezed(current), squeezed(product)
    clash = (query_id(here) != "") & (query_id(other) != "") & (query_id(here) != query_id(other))
    own, others = canonical_link(current, shop, prefix), canonical_link(product, shop, prefix)
    patch = lambda link, reason: F.struct(link.alias("next_link"), F.lit(reason).alias("reason"))
    return (
        F.when(clash, F.lit(None))
        .when((here != "") & (own != here), patch(own, "canonical"))
        .when((here != "") & ~here.rlike(r"(?i)^(https?:)?//") & (other != ""), patch(others, "replaced"))
        .when((here == "") & (other != ""), patch(others, "filled"))
    )


def duplicate_link_key(url: Column, tracking: tuple[str, ...], shop_host: str, prefix: str) -> Column:
    """Key under which equal links meet: lower-case scheme and host, no tracking parameters, no hash; a shop's links by item id.

    A text that is no link is its own lower-case key.
    """
    raw = squeezed(url)
    head = F.lower(F.regexp_extract(raw, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1))
    rest = F.substr(raw, F.length(head) + 1)
    path = F.regexp_extract(rest, r"^([^?#]*)", 1)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    params = F.filter(F.split(F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: (p != "") & ~F.split_part(p, F.lit("="), F.lit(1)).isin(*tracking))
    number = query_id(raw)
    kept = F.concat(head, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(F.lit("")))
    shop = F.when(number != "", F.concat(F.lit(prefix), number)).otherwise(F.concat(head, path))
    return F.when(head == "", F.lower(raw)).when(head.rlike(shop_host), shop).otherwise(kept)


def patch_counts(patches: DataFrame, table: str, reason: str) -> DataFrame:
    """Patches counted by table, by reason and over all: (by, value, n) from one aggregation."""
    got = patches.groupingSets([[table], [reason], []], table, reason)
    got = got.agg(F.count("*").alias("n"), F.grouping(table).alias("g1"), F.grouping(reason).alias("g2"))
    by = F.when(F.col("g1") == 0, "table").when(F.col("g2") == 0, "reason").otherwise("all")
    return got.select(by.alias("by"), F.coalesce(F.when(F.col("g1") == 0, F.col(table)), F.when(F.col("g2") == 0, F.col(reason)), F.lit("")).alias("value"), "n")


def json_patch(target: DataFrame, lists: DataFrame, json: str, key: str, column: str) -> DataFrame:
    """Update ``column`` from JSON lists of {key, column} objects; other rows stay. Malformed lists patch nothing."""
    kind = dict(target.dtypes)
    rows = lists.select(F.inline(F.from_json(json, f"array<struct<{key}:{kind[key]},{column}:{kind[column]}>>")))
    rows = rows.groupBy(key).agg(F.max(column).alias("new_value"))
    out = target.join(rows, key, "left")
    return out.select(*[F.coalesce("new_value", c).alias(c) if c == column else F.col(c) for c in target.columns])


def deletion_counts(children: DataFrame, parents: DataFrame, key: str, doomed: Column) -> DataFrame:
    """One row: how many parents a deletion takes and how many of their children go with them."""
    gone = parents.where(doomed).select(key)
    n = children.groupBy(key).agg(F.count("*").alias("n"))  # pre-aggregated: a hot parent costs one row a task
    got = gone.join(n, key, "left")
    return got.agg(F.count("*").alias("parents_deleted"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("children_deleted"))
