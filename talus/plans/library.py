"""Queries of the library page and of catalog upkeep: favourites, brands by origin, reasons by score, series, gaps, prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.functions import columns as X
from talus.operators import candidates as N
from talus.operators import catalog as K
from talus.operators import ranking as R
from talus.plans.registry import query, table

SHELF = """WITH s AS (SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN p_partkey + 1 END AS original, p_type AS kind, split_part(p_name, ' ', 2) AS sub, CASE WHEN p_size % 17 = 0 THEN '' ELSE p_brand END AS brand,
    CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END AS domestic, CASE WHEN p_size % 11 <> 0 THEN p_size END AS noise, p_name AS material, p_retailprice AS price FROM part)"""


def shelf(spark, sf_dir):
    p, size = table(spark, sf_dir, "part"), F.col("p_size")
    return p.select(
        F.col("p_partkey").alias("id"), F.when(size % 4 == 0, F.col("p_partkey") + 1).alias("original"), F.col("p_type").alias("kind"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("sub"),
        F.when(size % 17 == 0, "").otherwise(F.col("p_brand")).alias("brand"), F.when(size % 3 == 0, True).when(size % 3 == 1, False).alias("domestic"),
        F.when(size % 11 != 0, size).alias("noise"), F.col("p_name").alias("material"), F.col("p_retailprice").alias("price"),
    )


@query(
    SHELF
    + """ SELECT id, kind, sub, brand FROM s WHERE kind <> 'LARGE' AND domestic AND coalesce(original, id) IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)
    AND (noise IS NULL OR noise <= 40) AND contains(material, 'e') AND price BETWEEN 900 AND 1500"""
)
def lib_favourites(spark, sf_dir):
    """The conjunctive filter with favourites only: by original id where there is one."""
    got = N.of_origin(shelf(spark, sf_dir), "domestic", "domestic").where((F.col("kind") != "LARGE") & (F.col("noise").isNull() | (F.col("noise") <= 40)))
    got = got.where(F.col("material").contains("e") & F.col("price").between(900, 1500))
    liked = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45")
    return N.only_favourites(got, F.coalesce("original", "id"), liked, "l_partkey").select("id", "kind", "sub", "brand")


@query(
    SHELF
    + """, o AS (SELECT 'all' AS origin, brand FROM s UNION ALL SELECT 'domestic', brand FROM s WHERE domestic UNION ALL SELECT 'foreign', brand FROM s WHERE NOT domestic), d AS (SELECT DISTINCT origin, brand FROM o WHERE brand <> '')
    SELECT origin, CAST(row_number() OVER (PARTITION BY origin ORDER BY brand) AS INTEGER) AS place, brand FROM d"""
)
def lib_brand_options(spark, sf_dir):
    """The sorted brands to choose from, for every choice of origin (F8)."""
    rows = shelf(spark, sf_dir)
    each = [N.brand_options(rows, "brand", "domestic", o).select(F.lit(o).alias("origin"), "place", "brand") for o in ("all", "domestic", "foreign")]
    return each[0].unionByName(each[1]).unionByName(each[2])


LINES = ("right kind", "within budget", "quiet enough", "waterproof", "wanted brand")
WEIGHTS = {"right kind": 4, "within budget": 9, "quiet enough": 9, "waterproof": 2, "wanted brand": 11}


@query(
    """WITH p AS (SELECT p_partkey AS id, list_distinct(list_filter([CASE WHEN p_type = 'PROMO' THEN 'right kind' END, CASE WHEN p_retailprice < 1200 THEN 'within budget' END, CASE WHEN p_size <= 25 THEN 'quiet enough' END,
      CASE WHEN p_size % 3 = 0 THEN 'waterproof' END, CASE WHEN p_brand = 'Brand#7' THEN 'wanted brand' END, CASE WHEN p_size = 7 THEN '' END], lambda x: x IS NOT NULL AND x <> '')) AS ignored,
      list_filter([CASE WHEN p_type = 'PROMO' THEN {'i': 0, 'w': 4, 'x': 'right kind'} END, CASE WHEN p_retailprice < 1200 THEN {'i': 1, 'w': 9, 'x': 'within budget'} END, CASE WHEN p_size <= 25 THEN {'i': 2, 'w': 9, 'x': 'quiet enough'} END,
      CASE WHEN p_size % 3 = 0 THEN {'i': 3, 'w': 2, 'x': 'waterproof'} END, CASE WHEN p_brand = 'Brand#7' THEN {'i': 4, 'w': 11, 'x': 'wanted brand'} END], lambda x: x IS NOT NULL) AS l FROM part),
    u AS (SELECT id, unnest(l) AS x FROM p), r AS (SELECT id, x.x AS line, row_number() OVER (PARTITION BY id ORDER BY x.w DESC, x.i) AS k FROM u)
    SELECT p.id, coalesce(string_agg(line, ', ' ORDER BY k) FILTER (WHERE k <= 2), 'a sound choice') AS reason FROM p LEFT JOIN r ON p.id = r.id GROUP BY 1"""
)
def rec_primary_reason(spark, sf_dir):
    """The two lines that matter most by score, then place."""
    holds = (F.col("p_type") == "PROMO", F.col("p_retailprice") < 1200, F.col("p_size") <= 25, F.col("p_size") % 3 == 0, F.col("p_brand") == "Brand#7")
    lines = F.array(*[F.when(c, F.lit(t)) for c, t in zip(holds, LINES)], F.when(F.col("p_size") == 7, ""))
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    reason = R.primary_reason(lines, lambda line, i: F.try_element_at(weight, line), F.lit("a sound choice"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), reason.alias("reason"))


@query(
    """WITH i AS (SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN ' ' ELSE 'New ' || upper(p_name) || ' (' || p_brand || ')' END AS name, 'https://shop.example/products/' || replace(p_name, ' ', '%20') || CASE WHEN p_size % 2 = 0 THEN '?v=1' ELSE '/x' END AS url,
      CASE WHEN p_size % 5 > 0 THEN p_size END AS pos, CASE WHEN p_size % 4 = 0 THEN p_type ELSE '' END AS note, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_type END AS hint FROM part),
    k AS (SELECT *, CASE WHEN trim(name) <> '' THEN trim(regexp_replace(regexp_replace(lower(name), '\\bnew\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) ELSE trim(regexp_replace(regexp_replace(replace(split_part(split_part(split_part(url, '/products/', 2), '?', 1), '/', 1), '%20', ' '), '\\bnew\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) END AS series FROM i)
    SELECT series, min(pos) AS pos, arg_min(note, {'a': pos IS NULL, 'b': pos, 'c': id}) FILTER (WHERE note <> '') AS note, coalesce(array_to_string(list_sort(list(DISTINCT hint) FILTER (WHERE hint IS NOT NULL)), ','), '') AS hints FROM k GROUP BY 1""".replace("\\\\", "\\")
)
def list_collapse_series(spark, sf_dir):
    """Listings of a series in one row: by name, else by the URL's slug; least position, first filled fields, union of hints."""
    p, size = table(spark, sf_dir, "part"), F.col("p_size")
    name = F.when(size % 3 == 0, " ").otherwise(F.concat(F.lit("New "), F.upper("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(")")))
    url = F.concat(F.lit("https://shop.example/products/"), F.replace("p_name", F.lit(" "), F.lit("%20")), F.when(size % 2 == 0, "?v=1").otherwise("/x"))
    rows = p.select(
        F.col("p_partkey").alias("id"), K.series_key(name, url, r"\bnew\b").alias("series"), F.when(size % 5 > 0, size).alias("pos"), F.when(size % 4 == 0, F.col("p_type")).otherwise("").alias("note"),
        F.when(size % 7 != 0, F.array("p_type")).alias("hints"),
    )
    out = K.collapse_series(rows, "series", "pos", "id", ["note"], "hints")
    return out.select("series", "pos", "note", F.array_join(F.array_sort("hints"), ",").alias("hints"))


@query(
    """WITH r AS (SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN ' ' ELSE p_name END AS name, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_brand END AS brand, CASE WHEN p_size % 3 > 0 THEN p_retailprice END AS price, p_size % 11 = 0 AS no_tags, p_size % 13 = 0 AS no_features FROM part),
    m AS (SELECT id, list_filter([CASE WHEN trim(name) = '' THEN 'name' END, CASE WHEN brand IS NULL THEN 'brand' END, CASE WHEN price IS NULL THEN 'price' END, CASE WHEN no_tags THEN 'tags' END, CASE WHEN no_features THEN 'features' END], lambda x: x IS NOT NULL) AS m FROM r)
    SELECT id, array_to_string(m, ',') AS missing FROM m WHERE len(m) > 0"""
)
def aud_refill_set(spark, sf_dir):
    """Rows that lack any of their fields, texts, numbers, lists or JSON, and which: the set to fill again."""
    p, size = table(spark, sf_dir, "part"), F.col("p_size")
    json = F.when(size % 13 != 0, '{"evidence": ["x"]}').when(size % 2 == 0, '{"evidence": []}').otherwise("{}")
    rows = p.select(
        F.col("p_partkey").alias("id"), F.when(size % 5 == 0, " ").otherwise(F.col("p_name")).alias("name"), F.when(size % 7 != 0, F.col("p_brand")).alias("brand"), F.when(size % 3 > 0, F.col("p_retailprice")).alias("price"),
        F.when(size % 11 == 0, F.array().cast("array<string>")).otherwise(F.array("p_type")).alias("tags"), F.parse_json(json).alias("json"),
    )
    evidence = F.try_variant_get("json", "$.evidence", "array<string>")
    out = K.incomplete(rows, ["name", "brand", "price", "tags"], {"features": ~X.is_filled(F.col("json"), "variant") | (F.coalesce(F.size(evidence), F.lit(0)) <= 0)})
    return out.select("id", F.array_join("missing", ",").alias("missing"))


@query(
    """WITH r AS (SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN -1.0 WHEN 2 THEN floor(p_retailprice) ELSE p_retailprice END AS p, CASE p_size % 3 WHEN 0 THEN 'eur' WHEN 1 THEN 'USD' END AS c FROM part)
    SELECT id, CASE WHEN p > 0 THEN CASE WHEN upper(c) = 'EUR' AND p = floor(p) AND p >= 1000 THEN p / 100 ELSE p END END AS price FROM r"""
)
def num_price_by_currency(spark, sf_dir):
    """Positive prices; whole euro amounts of 1000 or more are cents, other currencies stay."""
    size, price = F.col("p_size"), F.col("p_retailprice")
    p = F.when(size % 5 == 0, None).when(size % 5 == 1, -1.0).when(size % 5 == 2, F.floor(price).cast("double")).otherwise(price)
    c = F.when(size % 3 == 0, "eur").when(size % 3 == 1, "USD")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), X.positive_price(p, c).alias("price"))
