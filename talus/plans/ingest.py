"""Ingest and adjustment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.operators import adjustments as A
from talus.operators import ingest as I
from talus.operators import scoring as S
from talus.plans.recommend import ITEMS, WANTED, items
from talus.plans.registry import query, table

RULES = [
    A.Adjustment("quiet", "sleep", "noise <= 15", 9, "very quiet"),
    A.Adjustment("quiet", "sleep", "noise > 40", -7, "too loud"),
    A.Adjustment("any", "gift", "price >= 950", 4, "gift worthy"),
    A.Adjustment("any", "undecided", "waterproof >= 5", 3, "versatile"),
    A.Adjustment("any", "undecided", "name LIKE '%gear%'", 2, "versatile"),
    A.Adjustment("loud", "party", "noise > 40", 9, "loud"),
]


@query(
    ITEMS
    + """ a AS (SELECT id, coalesce(noise <= 15, false) AS r1, coalesce(noise > 40, false) AS r2, coalesce(price >= 950, false) AS r3, coalesce(waterproof >= 5, false) AS r4, name LIKE '%gear%' AS r5 FROM items)
    SELECT id, CAST(9 * CAST(r1 AS INTEGER) - 7 * CAST(r2 AS INTEGER) + 4 * CAST(r3 AS INTEGER) + 3 * CAST(r4 AS INTEGER) + 2 * CAST(r5 AS INTEGER) AS INTEGER) AS adjustment,
    concat_ws('; ', CASE WHEN r1 THEN 'very quiet' END, CASE WHEN r2 THEN 'too loud' END, CASE WHEN r3 THEN 'gift worthy' END, CASE WHEN r4 OR r5 THEN 'versatile' END) AS notes FROM a"""
)
def rec_rule_adjustments(spark, sf_dir):
    """Branch, undecided and free-text adjustments from one rule table."""
    out = A.adjusted(items(spark, sf_dir), {"sleep", "gift", "undecided", "party"}, RULES, "quiet")
    return out.select("id", "adjustment", F.array_join("notes", "; ").alias("notes"))


@query(
    ITEMS
    + """ x AS (SELECT 1), s AS (SELECT id, CASE WHEN kind = 'PROMO' THEN 24 ELSE 0 END + CASE brand WHEN 'Brand#7' THEN 5 WHEN 'Brand#8' THEN 3 ELSE 0 END AS persona_score, price FROM items WHERE price <= 760 * 1.0 + 200)
    SELECT id, persona_score FROM s ORDER BY persona_score DESC, price, id LIMIT 5"""
)
def rec_persona_picks(spark, sf_dir):
    """Tuned preferences and boosted candidate scores, the best five."""
    p = A.tuned(WANTED, ["any_brand", "cheaper", "unknown"])
    base = F.when(F.col("kind") == p.kind, int(S.Weights().kind)).otherwise(0)
    rows = items(spark, sf_dir).where(F.col("price") <= p.budget[1] + 200)
    rows = rows.withColumn("persona_score", A.boosted(base, F.col("brand"), {"Brand#7": 5, "Brand#8": 3}))
    return rows.orderBy(F.desc("persona_score"), "price", "id").limit(5).select("id", "persona_score")


@query(
    """SELECT p_partkey AS id, 'size' AS name, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT p_partkey, 'brand', p_brand FROM part WHERE p_partkey % 3 <> 0
    UNION ALL SELECT p_partkey, 'kind', p_type FROM part"""
)
def ing_parameters(spark, sf_dir):
    """Key and value pairs, canonical names, first value wins, placeholders dropped."""
    part = table(spark, sf_dir, "part")
    brand = F.when(F.col("p_partkey") % 3 == 0, "n/a").otherwise(F.col("p_brand"))
    text = F.concat_ws("; ", F.concat(F.lit("Size : "), "p_size"), F.concat(F.lit("maker: "), brand), F.concat(F.lit("TYPE:"), "p_type"), F.lit("size: 999; odd: 1"))
    return I.parameters(part.select(F.col("p_partkey").alias("id"), text.alias("t")), "id", F.col("t"), {"size": "size", "maker": "brand", "type": "kind"})


@query(
    r"""SELECT p_partkey AS id, regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]+', '-', 'g') AS slug, p_name AS display,
    CASE WHEN p_brand = 'Brand#1' THEN 'X1' WHEN p_type = 'SMALL' THEN 'Small' ELSE p_type END AS country,
    CASE WHEN p_brand = 'Brand#1' THEN 'override' WHEN p_type = 'SMALL' THEN 'alias' ELSE 'stored' END AS reason,
    CASE WHEN p_size % 2 = p_size % 3 THEN CAST(p_size % 2 AS VARCHAR) ELSE 'unisex' END AS hint FROM part"""
)
def ing_names(spark, sf_dir):
    """Slugs, display names, country patches and merged hints."""
    part = table(spark, sf_dir, "part")
    full = F.concat_ws(" ", "p_brand", "p_name")
    country = I.country_patch(F.col("p_brand"), F.col("p_type"), {"small": "Small"}, {"brand#1": "X1"})
    hint = I.merged_hint(F.array((F.col("p_size") % 2).cast("string"), (F.col("p_size") % 3).cast("string")))
    out = part.select(F.col("p_partkey").alias("id"), I.slug(full).alias("slug"), I.display_name(full, F.col("p_brand"), r"\bofficial\b").alias("display"), country.alias("c"), hint.alias("hint"))
    return out.select("id", "slug", "display", F.col("c.value").alias("country"), F.col("c.reason").alias("reason"), "hint")


@query(
    """WITH r AS (SELECT p_partkey AS id, p_brand AS brand, p_name AS name, CASE WHEN p_partkey % 4 = 0 THEN ' ' ELSE p_type END AS kind FROM part),
    c AS (SELECT p_brand AS brand, min(p_type) AS kind FROM part WHERE p_size > 40 GROUP BY 1)
    SELECT id, coalesce(nullif(trim(r.kind), ''), c.kind) AS kind, CAST(row_number() OVER (PARTITION BY r.brand ORDER BY id) AS INTEGER) AS position FROM r LEFT JOIN c ON lower(c.brand) = lower(r.brand)"""
)
def ing_registry_fill(spark, sf_dir):
    """Missing fields from a registry, dense positions."""
    part = table(spark, sf_dir, "part")
    r = part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.when(F.col("p_partkey") % 4 == 0, " ").otherwise(F.col("p_type")).alias("kind"))
    c = part.where("p_size > 40").groupBy(F.col("p_brand").alias("brand")).agg(F.min("p_type").alias("kind"))
    return I.renumbered(I.filled_from(r, c, "brand", ["kind"]), ["brand"], "id").select("id", "kind", "position")


@query(
    r"""SELECT page_id, regexp_replace(url, '^(https?)://[^\s<>"]+$', '{{0}}') AS masked_text, url AS restored, regexp_extract(html, 'var t="([^"]*)"', 1) AS script_text FROM pages"""
)
def ing_mask_links(spark, sf_dir):
    """Links masked and restored; a script's value."""
    m = I.masked(F.col("url"))
    return table(spark, sf_dir, "pages").select(
        "page_id", m["text"].alias("masked_text"), I.unmasked(m["text"], m["links"]).alias("restored"), F.regexp_extract("html", 'var t="([^"]*)"', 1).alias("script_text")
    )
