"""Queries of catalog repair: link patches, matching, mergeable groups. Links and candidates are made from the catalog's own columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.functions import columns as X
from talus.operators import links as L
from talus.operators import matching as M
from talus.plans.registry import query, table

SHOP, PREFIX = r"(?i)detail\.shop\.example/item\.htm", "https://detail.shop.example/item.htm?id="
TRACKING = ("utm_source", "spm", "ref")

LINKS = """WITH links AS (SELECT p_partkey AS id, p_name AS name, CASE WHEN p_size % 3 = 0 THEN 'toys' ELSE 'items' END AS tab,
    CASE p_size % 8 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN '//detail.shop.example/item.htm?spm=a.b&id=' || p_partkey WHEN 3 THEN 'https://detail.shop.example/item.htm?id=' || p_partkey
      WHEN 4 THEN 'ask in the shop' WHEN 5 THEN 'HTTPS://WWW.Maker.example/p/' || p_partkey || '?utm_source=x&b=2#top' WHEN 6 THEN 'https://detail.shop.example/item.htm?id=1' || p_partkey || '&spm=7'
      ELSE '//maker.example/x' END AS link,
    CASE WHEN p_size % 5 = 0 THEN NULL ELSE 'http://detail.shop.example/item.htm?id=' || p_partkey || '&ref=1' END AS product FROM part)"""
NUMBER = r"regexp_extract({0}, '[?&]id=(\d+)(?:[&#]|$)', 1)"
CANON = "CASE WHEN {n} <> '' AND regexp_matches({0}, '(?i)detail\\.shop\\.example/item\\.htm') THEN 'https://detail.shop.example/item.htm?id=' || {n} WHEN starts_with({0}, '//') THEN 'https:' || {0} ELSE {0} END"
PATCHES = (
    LINKS
    + f""", c AS (SELECT *, trim(coalesce(link, '')) AS a, trim(coalesce(product, '')) AS b FROM links),
    n AS (SELECT *, {NUMBER.format("a")} AS na, {NUMBER.format("b")} AS nb FROM c),
    k AS (SELECT *, {CANON.format("a", n="na")} AS ka, {CANON.format("b", n="nb")} AS kb FROM n),
    p AS (SELECT id, name, tab, a, CASE WHEN na <> '' AND nb <> '' AND na <> nb THEN NULL WHEN a <> '' AND ka <> a THEN 'canonical' WHEN a <> '' AND NOT regexp_matches(a, '(?i)^(https?:)?//') AND b <> '' THEN 'replaced'
      WHEN a = '' AND b <> '' THEN 'filled' END AS reason, ka, kb FROM k),
    patches AS (SELECT id, name, tab, CASE WHEN reason = 'canonical' THEN ka ELSE kb END AS next_link, reason FROM p WHERE reason IS NOT NULL)"""
)


def links(spark, sf_dir):
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    forms = {
        1: F.lit("  "), 2: F.concat(F.lit("//detail.shop.example/item.htm?spm=a.b&id="), key), 3: F.concat(F.lit("https://detail.shop.example/item.htm?id="), key), 4: F.lit("ask in the shop"),
        5: F.concat(F.lit("HTTPS://WWW.Maker.example/p/"), key, F.lit("?utm_source=x&b=2#top")), 6: F.concat(F.lit("https://detail.shop.example/item.htm?id=1"), key, F.lit("&spm=7")), 7: F.lit("//maker.example/x"),
    }
    link = F.coalesce(*[F.when(size % 8 == k, v) for k, v in forms.items()])
    product = F.when(size % 5 != 0, F.concat(F.lit("http://detail.shop.example/item.htm?id="), key, F.lit("&ref=1")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(size % 3 == 0, "toys").otherwise("items").alias("tab"), link.alias("link"), product.alias("product"))


def patches(spark, sf_dir):
    patch = L.link_patch(F.col("link"), F.col("product"), SHOP, PREFIX)
    return links(spark, sf_dir).withColumn("patch", patch).where("patch is not null").select("id", "name", "tab", "patch.*")


@query(PATCHES + " SELECT id, tab, next_link, reason FROM patches")
def lnk_patches(spark, sf_dir):
    """The link patch that each row needs, with its reason."""
    return patches(spark, sf_dir).select("id", "tab", "next_link", "reason")


@query(
    PATCHES
    + """, counted AS (SELECT CASE WHEN grouping(tab) = 0 THEN 'table' WHEN grouping(reason) = 0 THEN 'reason' ELSE 'all' END AS "by", CASE WHEN grouping(tab) = 0 THEN tab WHEN grouping(reason) = 0 THEN reason ELSE '' END AS value, count(*) AS n
      FROM patches GROUP BY GROUPING SETS ((tab), (reason), ()))
    SELECT "by", value, n, NULL AS next_link FROM counted UNION ALL SELECT * FROM (SELECT 'sample', name || ' ' || id, 1, next_link FROM patches ORDER BY id LIMIT 20)"""
)
def lnk_patch_report(spark, sf_dir):
    """Patches by table, by reason and over all, and a sample of twenty, as the report has it."""
    p = patches(spark, sf_dir)
    counts = L.patch_counts(p, "tab", "reason").withColumn("next_link", F.lit(None).cast("string"))
    sample = p.orderBy("id").limit(20).select(F.lit("sample").alias("by"), F.concat_ws(" ", "name", "id").alias("value"), F.lit(1).cast("long").alias("n"), "next_link")
    return counts.unionByName(sample)


@query(
    LINKS
    + r""", t AS (SELECT id, trim(coalesce(link, '')) AS raw FROM links), h AS (SELECT *, lower(regexp_extract(raw, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1)) AS head, regexp_extract(raw, '[?&]id=(\d+)(?:[&#]|$)', 1) AS num FROM t),
    r AS (SELECT *, raw[length(head) + 1:] AS rest FROM h), q AS (SELECT *, CASE WHEN regexp_extract(rest, '^([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(rest, '^([^?#]*)', 1) END AS path,
      list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND split_part(p, '=', 1) NOT IN ('utm_source', 'spm', 'ref')) AS params FROM r)
    SELECT CASE WHEN head = '' THEN lower(raw) WHEN regexp_matches(head, 'shop\.example$') THEN CASE WHEN num <> '' THEN 'https://detail.shop.example/item.htm?id=' || num ELSE head || path END
      ELSE head || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS link_key, count(*) AS n FROM q GROUP BY 1"""
)
def lnk_duplicate_keys(spark, sf_dir):
    """Rows by the key under which equal links meet: lower host, no tracking, a shop's links by item id."""
    key = L.duplicate_link_key(F.col("link"), TRACKING, r"shop\.example$", PREFIX)
    return links(spark, sf_dir).groupBy(key.alias("link_key")).agg(F.count("*").alias("n"))


@query(
    PATCHES
    + """, j AS (SELECT tab, to_json(list({'id': id, 'link': next_link})) AS js FROM patches GROUP BY tab, id % 50), u AS (SELECT unnest(from_json(js, '[{"id":"BIGINT","link":"VARCHAR"}]')) AS x FROM j)
    SELECT l.id, coalesce(u.x.link, l.link) AS link FROM links l LEFT JOIN u ON l.id = u.x.id"""
)
def cat_json_patch(spark, sf_dir):
    """Patches that come as JSON lists, unfolded and applied to the rows."""
    p = patches(spark, sf_dir).select("tab", "id", F.col("next_link").alias("link"))
    lists = p.groupBy("tab", F.col("id") % 50).agg(F.to_json(F.collect_list(F.struct("id", "link"))).alias("js"))
    return L.json_patch(links(spark, sf_dir).select("id", "link"), lists, "js", "id", "link")


@query(
    """WITH gone AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice < 200000)
    SELECT (SELECT count(*) FROM gone) AS parents_deleted, (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM gone)) AS children_deleted"""
)
def aud_deletion_counts(spark, sf_dir):
    """How many rows a deletion takes with it, children before parents."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "k")
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "k")
    return L.deletion_counts(lines, orders, "k", (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") < 200_000))


CHARS = "list_distinct(list_filter(string_split({0}, ''), lambda c: c <> ''))"
TITLES = """WITH targets AS (SELECT DISTINCT p_name AS target FROM part), shop AS (SELECT lower(p_type) || ' ' || p_name AS title, bool_or(p_type <> 'LARGE') AS listed FROM part GROUP BY 1),
    x AS (SELECT target, list_distinct(list_filter(string_split(target, ' '), lambda t: length(t) >= 2)) AS tt, replace(target, ' ', '') AS ts FROM targets), y AS (SELECT title, listed, replace(title, ' ', '') AS cs FROM shop),
    pairs AS (SELECT * FROM x CROSS JOIN y)"""


def titles(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    targets = part.select(F.col("p_name").alias("target")).distinct().withColumn("tt", F.array_distinct(F.filter(F.split("target", " "), lambda t: F.length(t) >= 2)))
    shop = part.groupBy(F.concat_ws(" ", F.lower("p_type"), "p_name").alias("title")).agg(F.bool_or(F.col("p_type") != "LARGE").alias("listed"))
    return targets, shop


@query(
    TITLES
    + f""", s AS (SELECT target, title, least(1.0::DOUBLE, 0.62::DOUBLE * 2.0::DOUBLE * len(list_intersect({CHARS.format("ts")}, {CHARS.format("cs")})) / (len({CHARS.format("ts")}) + len({CHARS.format("cs")}))
      + 0.30::DOUBLE * (len(list_filter(tt, lambda t: contains(title, t))) / greatest(len(tt), 1)::DOUBLE) + CASE WHEN listed THEN 0.08::DOUBLE ELSE 0 END) AS score FROM pairs)
    SELECT target, title, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(score, 9) DESC, title) AS rn FROM s) WHERE rn = 1 AND score >= 0.42"""
)
def match_composite(spark, sf_dir):
    """Best shop title of every name by character Dice, token recall and a bonus, from 0.42, of all titles."""
    targets, shop = titles(spark, sf_dir)
    return M.best_composite(targets, "tt", shop, "listed").withColumn("score", F.round("score", 6))


ALIASES = {"red": ("crimson", "small"), "bolt": ("screw",)}
TOKENS = """list_distinct(list_filter(list_concat(list_concat(list_concat(string_split({0}, ' '), CASE WHEN list_contains(string_split({0}, ' '), 'red') THEN ['crimson', 'small'] ELSE [] END),
    CASE WHEN list_contains(string_split({0}, ' '), 'bolt') THEN ['screw'] ELSE [] END), [{0}]), lambda t: length(t) >= 2))"""


@query(
    f"""WITH targets AS (SELECT DISTINCT p_name AS target FROM part), shop AS (SELECT DISTINCT lower(p_type) || ' ' || p_name AS title FROM part UNION SELECT DISTINCT p_name FROM part WHERE p_size = 7),
    x AS (SELECT target, {TOKENS.format("target")} AS tt FROM targets), y AS (SELECT title, {TOKENS.format("title")} AS ct FROM shop),
    p AS (SELECT *, len(list_intersect(tt, ct)) AS n, least(len(tt), len(ct)) AS lo, greatest(len(tt), len(ct)) AS hi, CASE WHEN contains(target, 'gear') AND contains(title, 'gear') THEN 0.86::DOUBLE ELSE 0.0::DOUBLE END AS alias FROM x CROSS JOIN y),
    s AS (SELECT target, title, title = 'promo ' || target AS cur, CASE WHEN target = title THEN 1.0::DOUBLE WHEN contains(target, title) OR contains(title, target) THEN greatest(alias, least(length(target), length(title)) / greatest(length(target), length(title))::DOUBLE)
      ELSE greatest(alias, n / hi::DOUBLE, 0.72::DOUBLE * n / lo) END AS score FROM p),
    r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY NOT cur, round(score, 9) DESC, title) AS rn FROM s WHERE score >= 0.42)
    SELECT target, title AS match, round(score, 6) AS score, cur AS kept FROM r WHERE rn = 1"""
)
def match_keep_current(spark, sf_dir):
    """The present title if it still scores 0.42, else the best one; tokens with aliases and Han grams."""
    part = table(spark, sf_dir, "part")
    targets = part.select(F.col("p_name").alias("target")).distinct().withColumn("tt", M.title_tokens(F.col("target"), ALIASES))
    shop = part.select(F.concat_ws(" ", F.lower("p_type"), "p_name").alias("title")).union(part.where("p_size = 7").select("p_name")).distinct()
    pairs = M.title_pairs(targets, "tt", shop.withColumn("ct", M.title_tokens(F.col("title"), ALIASES)), "ct", 0.42, (("gear",), ("gear",)))
    alias = F.when(F.col("target").contains("gear") & F.col("title").contains("gear"), 0.86).otherwise(0.0)
    score = F.round(M.title_score(F.col("target"), F.col("title"), F.col("tt"), F.col("ct"), alias), 9)
    best = M.best_or_current(pairs.withColumn("score", score), "target", "title", F.col("title") == F.concat(F.lit("promo "), "target"), 0.42)
    return best.select("target", "match", F.round("score", 6).alias("score"), "kept")


@query(
    """WITH items AS (SELECT p_partkey AS id, regexp_replace(p_name, ' ', '', 'g') AS name, string_split(p_name, ' ') AS keys FROM part), shop AS (SELECT DISTINCT p_type || '|' || p_name AS handle, regexp_replace(lower(p_type) || p_name, ' ', '', 'g') AS title FROM part),
    p AS (SELECT id, name, keys, handle, title, name = 'redgear' AND handle = 'PROMO|red gear' AS alias FROM items CROSS JOIN shop),
    s AS (SELECT *, CASE WHEN alias THEN 100 ELSE CASE WHEN length(name) >= 5 AND contains(title, name) THEN 35 ELSE 0 END + list_sum(list_transform(keys, lambda k: CASE WHEN length(k) >= 4 AND contains(title, k) THEN CASE WHEN length(k) >= 6 THEN 20 ELSE 12 END ELSE 0 END)) END AS score,
      CASE WHEN alias THEN 'alias' WHEN length(name) >= 5 AND contains(title, name) THEN 'name' WHEN len(list_filter(keys, lambda k: length(k) >= 4 AND contains(title, k))) > 0 THEN 'token' ELSE 'none' END AS matched_by FROM p),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, handle) AS rn, lead(score) OVER (PARTITION BY id ORDER BY score DESC, handle) AS second FROM s WHERE score >= 25)
    SELECT id, handle, CAST(score AS INTEGER) AS score, matched_by FROM r WHERE rn = 1 AND (second IS NULL OR score - second >= 4 OR matched_by = 'alias')"""
)
def match_alias_or_clear(spark, sf_dir):
    """Additive candidate scores from 25; no match if the second is within 4, unless an alias names it."""
    part = table(spark, sf_dir, "part")
    names = part.select("p_name").distinct().select("p_name", F.regexp_replace("p_name", " ", "").alias("name"), F.split("p_name", " ").alias("keys"))
    shop = part.select("p_type", "p_name").distinct().select(F.concat_ws("|", "p_type", "p_name").alias("handle"), F.regexp_replace(F.concat(F.lower("p_type"), "p_name"), " ", "").alias("title"))
    alias = (F.col("name") == "redgear") & (F.col("handle") == "PROMO|red gear")
    pairs = M.additive_pairs(names, shop, alias)
    named = names.where("name = 'redgear'").join(F.broadcast(shop.where("handle = 'PROMO|red gear'")))  # one row
    pairs = pairs.unionByName(named)
    scored = pairs.select("p_name", "handle", M.additive_score(F.col("name"), F.col("title"), F.col("keys"), alias).alias("s")).select("p_name", "handle", "s.*")
    best = M.unambiguous(scored, "p_name", "handle", 25, 4)
    return part.join(best, "p_name").select(F.col("p_partkey").alias("id"), "handle", F.col("score").cast("int").alias("score"), "matched_by")


@query(
    f"""WITH r AS (SELECT p_brand AS brand, p_type AS kind, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS k, CASE WHEN p_size % 10 = 0 THEN '' ELSE split_part(p_name, ' ', 2) END AS a, p_size // 4 AS shelf FROM part),
    g AS (SELECT brand, kind, shelf, count(*) FILTER (WHERE k <> '') AS n, count(*) FILTER (WHERE a <> '') AS m, min_by(k, -length(k) || k) FILTER (WHERE k <> '') AS skip FROM r GROUP BY 1, 2, 3),
    lk AS (SELECT DISTINCT ON (brand, kind, shelf) brand, kind, shelf, k AS long_k FROM r WHERE k <> '' ORDER BY brand, kind, shelf, length(k) DESC, k),
    la AS (SELECT DISTINCT ON (brand, kind, shelf) brand, kind, shelf, a AS long_a FROM r WHERE a <> '' ORDER BY brand, kind, shelf, length(a) DESC, a),
    j AS (SELECT r.*, n, m, long_k, long_a, {CHARS.format("k")} AS ck, {CHARS.format("long_k")} AS cl, {CHARS.format("a")} AS ca, {CHARS.format("coalesce(long_a, '')")} AS cb FROM r JOIN g USING (brand, kind, shelf) LEFT JOIN lk USING (brand, kind, shelf) LEFT JOIN la USING (brand, kind, shelf)),
    t AS (SELECT *, k = long_k OR (contains(long_k, k) AND length(k) >= least(6, length(long_k))) OR 2.0::DOUBLE * len(list_intersect(ck, cl)) / (len(ck) + len(cl)) >= 0.72 AS ok,
      CASE WHEN a <> '' THEN a = long_a OR (contains(long_a, a) AND length(a) >= least(4, length(long_a))) OR 2.0::DOUBLE * len(list_intersect(ca, cb)) / (len(ca) + len(cb)) >= 0.78 END AS ok2 FROM j)
    SELECT brand, kind, shelf, n, bool_and(ok) OR (n = max(m) AND coalesce(bool_and(ok2), false)) AS mergeable FROM t WHERE n >= 2 GROUP BY brand, kind, shelf, n"""
)
def ddp_group_mergeable(spark, sf_dir):
    """Groups whose names may be merged: against the longest name, then against the longest alias."""
    shelf = F.floor(F.col("p_size") / 4).cast("int")
    alias = F.when(F.col("p_size") % 10 == 0, "").otherwise(F.split_part("p_name", F.lit(" "), F.lit(2)))
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), shelf.alias("shelf"), X.name_key(F.col("p_name")).alias("k"), alias.alias("a"))
    return M.mergeable_groups(rows, ["brand", "kind", "shelf"], "k", "a")


@query(
    """SELECT o_custkey, o_orderkey AS keeper, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(floor(o_totalprice / 100000) AS INTEGER) DESC, o_orderdate DESC, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE rn = 1"""
)
def ddp_keeper_updated(spark, sf_dir):
    """The row of each group to keep: best score, newest, least id, in one pre-aggregated pass."""
    order = F.struct((-F.floor(F.col("o_totalprice") / 100_000)).alias("s"), (-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("d"), "o_orderkey")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", order).alias("keeper"), F.count("*").alias("n"))


SOURCES = """WITH t AS (SELECT p_partkey AS pos, CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE CAST(p_partkey // 2 AS VARCHAR) END AS oid, CASE WHEN p_size % 7 = 0 THEN ' ' ELSE '  ' || upper(p_name) END AS name,
      CASE WHEN p_size % 11 = 0 THEN NULL ELSE p_brand END AS brand, CASE p_size % 4 WHEN 0 THEN p_type WHEN 1 THEN '  ' WHEN 2 THEN '' END AS note, CASE WHEN p_size % 3 = 0 THEN p_retailprice END AS price FROM part),
    n AS (SELECT p_partkey AS pos, CASE WHEN p_size % 3 = 0 THEN CAST(p_partkey * 2 AS VARCHAR) ELSE '' END AS oid, p_name AS name, CASE WHEN p_size % 13 = 0 THEN '' ELSE lower(p_brand) END AS brand,
      CASE WHEN p_size % 2 = 0 THEN ' ' ELSE p_type || '!' END AS note, CASE WHEN p_size % 5 > 0 THEN p_retailprice + 1 END AS price FROM part),
    i1 AS (SELECT oid, max(pos) AS t1 FROM t WHERE oid <> '' GROUP BY 1),
    i2 AS (SELECT lower(trim(name)) AS k1, lower(trim(brand)) AS k2, max(pos) AS t2 FROM t WHERE trim(name) <> '' AND trim(brand) <> '' GROUP BY 1, 2),
    m AS (SELECT n.*, coalesce(t1, t2) AS target, t1 IS NOT NULL AS by_key FROM n LEFT JOIN i1 ON n.oid = i1.oid LEFT JOIN i2 ON lower(trim(n.name)) = k1 AND lower(trim(n.brand)) = k2),
    h AS (SELECT target, arg_min(note, pos) FILTER (WHERE trim(note) <> '') AS nn, arg_min(price, pos) FILTER (WHERE price IS NOT NULL) AS np, arg_min(brand, pos) FILTER (WHERE trim(brand) <> '') AS nb,
      count(*) FILTER (WHERE by_key) AS by_key, count(*) FILTER (WHERE NOT by_key) AS by_name FROM m WHERE target IS NOT NULL GROUP BY 1),
    a AS (SELECT 'target' AS origin, pos, oid, name, CASE WHEN trim(coalesce(brand, '')) = '' THEN coalesce(nb, brand) ELSE brand END AS brand, CASE WHEN trim(coalesce(note, '')) = '' THEN coalesce(nn, note) ELSE note END AS note, coalesce(price, np) AS price,
        coalesce(by_key, 0) AS by_key, coalesce(by_name, 0) AS by_name,
        CAST(trim(coalesce(brand, '')) = '' AND nb IS NOT NULL AS INTEGER) + CAST(trim(coalesce(note, '')) = '' AND nn IS NOT NULL AS INTEGER) + CAST(price IS NULL AND np IS NOT NULL AS INTEGER) AS filled FROM t LEFT JOIN h ON pos = target
      UNION ALL SELECT 'insert', pos, oid, name, brand, note, price, 0, 0, 0 FROM m WHERE target IS NULL)"""


def two_sources(spark, sf_dir):
    """Two catalogs made of the parts: with ids that repeat or lack, names of other case, and blanks."""
    p = table(spark, sf_dir, "part")
    size, key = F.col("p_size"), F.col("p_partkey")
    own = p.select(
        key.alias("pos"), F.when(size % 5 == 0, None).when(size % 5 == 1, "").otherwise(F.expr("p_partkey div 2").cast("string")).alias("oid"),
        F.when(size % 7 == 0, " ").otherwise(F.concat(F.lit("  "), F.upper("p_name"))).alias("name"), F.when(size % 11 != 0, F.col("p_brand")).alias("brand"),
        F.when(size % 4 == 0, F.col("p_type")).when(size % 4 == 1, "  ").when(size % 4 == 2, "").alias("note"), F.when(size % 3 == 0, F.col("p_retailprice")).alias("price"),
    )
    new = p.select(
        key.alias("pos"), F.when(size % 3 == 0, (key * 2).cast("string")).otherwise("").alias("oid"), F.col("p_name").alias("name"), F.when(size % 13 == 0, "").otherwise(F.lower("p_brand")).alias("brand"),
        F.when(size % 2 == 0, " ").otherwise(F.concat("p_type", F.lit("!"))).alias("note"), F.when(size % 5 > 0, F.col("p_retailprice") + 1).alias("price"),
    )
    return own, new


def merged_sources(spark, sf_dir):
    own, new = two_sources(spark, sf_dir)
    return M.merge_two_sources(own, new, "oid", "name", "brand", "pos", ["brand", "note", "price"])


@query(SOURCES + " SELECT origin, pos, oid, name, brand, note, price FROM a")
def cat_merge_matched(spark, sf_dir):
    """Two catalogs in one: match by id, else by name and brand; blanks are filled in order, what has no match is appended."""
    return merged_sources(spark, sf_dir).select("origin", "pos", "oid", "name", "brand", "note", "price")


@query(SOURCES + " SELECT CAST(sum(by_key) AS BIGINT) AS matched_by_id, CAST(sum(by_name) AS BIGINT) AS matched_by_name_brand, count(*) FILTER (WHERE origin = 'insert') AS inserted, CAST(sum(filled) AS BIGINT) AS fields_filled FROM a")
def cat_merge_summary(spark, sf_dir):
    """What that merge did: matches by either key, inserts, fields filled."""
    return merged_sources(spark, sf_dir).agg(
        F.sum("by_key").alias("matched_by_id"), F.sum("by_name").alias("matched_by_name_brand"), F.count_if(F.col("origin") == "insert").alias("inserted"), F.sum("filled").alias("fields_filled")
    )


@query(
    """WITH cache AS (SELECT split_part(p_name, ' ', 2) || p_size AS k, min(p_partkey) AS hit FROM part GROUP BY 1), k AS (SELECT p_partkey AS id, unnest([split_part(p_name, ' ', 1) || p_size, split_part(p_name, ' ', 2) || (p_size + 1), split_part(p_name, ' ', 2) || p_size]) AS k, unnest([0, 1, 2]) AS pos FROM part)
    SELECT id, min_by(hit, pos) AS hit FROM k JOIN cache USING (k) GROUP BY id"""
)
def cat_first_key_hit(spark, sf_dir):
    """Look-up by a list of keys in which the first one that hits counts."""
    p = table(spark, sf_dir, "part")
    one, two, size = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2)), F.col("p_size")
    cache = p.groupBy(F.concat(two, size.cast("string")).alias("k")).agg(F.min("p_partkey").alias("hit"))
    probes = p.select(F.col("p_partkey").alias("id"), F.array(F.concat(one, size.cast("string")), F.concat(two, (size + 1).cast("string")), F.concat(two, size.cast("string"))).alias("keys"))
    return M.first_key_hit(probes, "id", "keys", cache, "k", "hit")
