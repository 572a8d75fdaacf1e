"""Catalog maintenance, audits and ingest queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.functions import columns as X
from talus.operators import catalog as K
from talus.plans.registry import query, table


@query(
    """WITH l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 3 = 0 THEN -1 ELSE l_suppkey END AS s_suppkey,
      CASE WHEN l_suppkey % 3 = 0 AND l_linenumber % 2 = 0 THEN 'SUPPLIER#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') ELSE '' END AS s_name FROM lineitem)
    SELECT l_orderkey, l_linenumber, count(*) AS n, min(coalesce(a.s_nationkey, b.s_nationkey)) AS nation, sum(coalesce(a.s_nationkey, b.s_nationkey)) AS nations
    FROM l LEFT JOIN supplier a ON a.s_suppkey = l.s_suppkey
    LEFT JOIN supplier b ON a.s_suppkey IS NULL AND lower(b.s_name) = lower(nullif(trim(l.s_name), '')) GROUP BY 1, 2"""
)
def cat_fallback_join(spark, sf_dir):
    """Brand by key, else by name where the key misses."""
    gone = F.col("l_suppkey") % 3 == 0
    name = F.concat(F.lit("SUPPLIER#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"))
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(gone, F.lit(-1)).otherwise(F.col("l_suppkey")).alias("s_suppkey"),
        F.when(gone & (F.col("l_linenumber") % 2 == 0), name).otherwise("").alias("s_name"),
    )
    brands = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    out = K.fallback_join(rows, brands, "s_suppkey", "s_name")
    return out.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.min("s_nationkey").alias("nation"), F.sum("s_nationkey").alias("nations"))


@query(
    """WITH a AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN p_retailprice * 100 WHEN p_partkey % 5 = 0 THEN 0 ELSE p_retailprice END AS pa
      FROM part WHERE p_partkey % 7 <> 0),
    b AS (SELECT l_partkey AS id, max(l_extendedprice / l_quantity) AS pb FROM lineitem WHERE l_quantity > 0 GROUP BY 1)
    SELECT coalesce(a.id, b.id) AS id, round(CASE WHEN pa IS NULL OR pa <= 1 THEN pb WHEN pb > 1 AND pa / pb BETWEEN 90 AND 110 THEN pa / 100 ELSE pa END, 6) AS price,
      pa IS NULL AS only_right, pb IS NULL AS only_left FROM a FULL JOIN b ON a.id = b.id"""
)
def cat_full_outer_repair(spark, sf_dir):
    """Two price sources, full outer, repaired in both directions."""
    p = F.col("p_retailprice")
    a = table(spark, sf_dir, "part").where("p_partkey % 7 <> 0").select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 4 == 0, p * 100).when(F.col("p_partkey") % 5 == 0, 0.0).otherwise(p).alias("pa")
    )
    b = table(spark, sf_dir, "lineitem").where("l_quantity > 0").groupBy(F.col("l_partkey").alias("id")).agg(F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("pb"))
    out = a.join(b, "id", "full")
    return out.select("id", F.round(K.repair_scaled(F.col("pa"), F.col("pb")), 6).alias("price"), F.col("pa").isNull().alias("only_right"), F.col("pb").isNull().alias("only_left"))


@query(
    """SELECT p_partkey, l_orderkey, l_linenumber, priority FROM (
      SELECT p_partkey, l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS priority,
        row_number() OVER (PARTITION BY p_partkey ORDER BY CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END, l_shipdate DESC, l_orderkey, l_linenumber, l_suppkey, l_quantity) AS rn
      FROM part JOIN lineitem ON l_partkey = p_partkey) WHERE rn = 1"""
)
def cat_priority_match(spark, sf_dir):
    """Best line per part by flag priority, then newest."""
    flag = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2).otherwise(3)
    lines = table(spark, sf_dir, "lineitem").withColumn("priority", flag)
    probes = table(spark, sf_dir, "part").select("p_partkey")
    order = [F.asc("priority"), F.desc("l_shipdate"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_suppkey"), F.asc("l_quantity")]
    out = K.priority_match(probes, lines, F.col("l_partkey") == F.col("p_partkey"), order, ["p_partkey"])
    return out.select("p_partkey", "l_orderkey", "l_linenumber", "priority")


@query(
    """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"""
)
def cat_latest_wins(spark, sf_dir):
    """Last write per key (S8 ST4)."""
    out = K.latest_wins(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    return out.select("user_id", "event_type", "event_id", "value")


@query(
    """SELECT DISTINCT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events e WHERE event_type = 'click'
    AND NOT EXISTS (SELECT 1 FROM events t WHERE t.event_type = 'purchase' AND t.user_id = e.user_id
      AND CAST(json_extract_string(t.props, '$.k') AS BIGINT) = CAST(json_extract_string(e.props, '$.k') AS BIGINT))"""
)
def cat_insert_ignore(spark, sf_dir):
    """New pairs that the target lacks, each once."""
    pairs = table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type")
    new, old = (pairs.where(F.col("event_type") == t).select("user_id", "k") for t in ("click", "purchase"))
    return K.insert_ignore(old.distinct(), new, ["user_id", "k"])


@query(
    """WITH old AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS segment, c_nationkey AS nation FROM customer WHERE c_custkey % 5 <> 0),
    new AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) END AS segment, CASE WHEN c_custkey % 4 = 0 THEN c_nationkey + 100 END AS nation FROM customer WHERE c_custkey % 5 <> 1)
    SELECT coalesce(n.id, o.id) AS id, coalesce(n.segment, o.segment) AS segment, coalesce(n.nation, o.nation) AS nation FROM old o FULL JOIN new n ON o.id = n.id"""
)
def cat_fill_merge(spark, sf_dir):
    """Upsert in which null keeps the old value; also the local and remote merge."""
    c = table(spark, sf_dir, "customer")
    i, seg, nat = F.col("c_custkey"), F.col("c_mktsegment"), F.col("c_nationkey")
    old = c.where(i % 5 != 0).select(i.alias("id"), F.when(i % 3 != 0, seg).alias("segment"), nat.alias("nation"))
    new = c.where(i % 5 != 1).select(i.alias("id"), F.when(i % 2 == 0, F.lower(seg)).alias("segment"), F.when(i % 4 == 0, nat + 100).alias("nation"))
    return K.keep_filled(old, new, "id")


@query(
    """WITH patch AS (SELECT l_partkey AS p_partkey, max(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT p.p_partkey, CASE WHEN q > 45 THEN 'BULK' ELSE p_type END AS p_type, p_size, coalesce(q > 45 AND p_type IS DISTINCT FROM 'BULK', false) AS changed
    FROM part p LEFT JOIN patch USING (p_partkey)"""
)
def cat_update_from(spark, sf_dir):
    """Update from a joined patch, no-op changes excluded."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    patch = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_quantity").alias("q"))
    patch = patch.where("q > 45").select("p_partkey", F.lit("BULK").alias("p_type"))
    new = K.patched(part, patch, "p_partkey")
    old = part.select("p_partkey", F.col("p_type").alias("old"))
    return new.join(old, "p_partkey").select("p_partkey", "p_type", "p_size", (~F.col("p_type").eqNullSafe(F.col("old"))).alias("changed"))


@query(
    """WITH new AS (SELECT p_partkey + CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1000000 END AS id, CASE WHEN p_partkey % 3 = 1 THEN upper(p_name) ELSE p_name || '!' END AS name, p_brand AS brand FROM part),
    t AS (SELECT p_partkey AS id, p_name AS name, p_brand AS brand FROM part),
    pair AS (SELECT lower(name) AS k1, lower(brand) AS k2, max(id) AS t2 FROM t GROUP BY 1, 2)
    SELECT new.id, coalesce(t.id, t2) AS target_id, CASE WHEN t.id IS NOT NULL THEN 'id' WHEN t2 IS NOT NULL THEN 'name_brand' ELSE 'insert' END AS matched_by
    FROM new LEFT JOIN t ON t.id = new.id LEFT JOIN pair ON lower(new.name) = k1 AND lower(new.brand) = k2"""
)
def cat_two_key_match(spark, sf_dir):
    """Match by id, else by name and brand, else insert."""
    part, i = table(spark, sf_dir, "part"), F.col("p_partkey")
    t = part.select(i.alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    new = part.select(
        (i + F.when(i % 3 == 0, 0).otherwise(1_000_000)).alias("id"),
        F.when(i % 3 == 1, F.upper("p_name")).otherwise(F.concat("p_name", F.lit("!"))).alias("name"),
        F.col("p_brand").alias("brand"),
    )
    return K.two_key_match(new, t, "id", "name", "brand", "id").select("id", F.col("target_order").alias("target_id"), "matched_by")


HOST = r"regexp_replace(split_part(split_part(split_part(lower(url), '/', 3), '?', 1), '#', 1), '^www\.', '')"


@query(
    rf"""SELECT {HOST} AS host, count(*) AS total, count(*) FILTER (WHERE url LIKE '%?%') AS missing_clean,
    count(*) FILTER (WHERE length(html) < 2000) AS missing_body, count(*) FILTER (WHERE html NOT LIKE '%<footer%') AS missing_footer FROM pages GROUP BY 1"""
)
def aud_completeness(spark, sf_dir):
    """Gaps by host with filtered counts."""
    fields = {"clean": F.col("url").contains("?"), "body": F.length("html") < 2000, "footer": ~F.col("html").contains("<footer")}
    return K.completeness(table(spark, sf_dir, "pages"), [X.url_host(F.col("url")).alias("host")], fields)


@query("SELECT p_brand AS brand, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_orderkey) AS orders FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def aud_distinct_by_brand(spark, sf_dir):
    """Distinct counts by brand."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("p_brand").alias("brand")).agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_orderkey").alias("orders"))


@query(
    """WITH u AS (SELECT l_partkey AS id, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 UNION ALL
      SELECT l_partkey, count(*) FROM lineitem WHERE l_discount > 0.05 GROUP BY 1),
    r AS (SELECT id, CAST(sum(n) AS BIGINT) AS refs FROM u GROUP BY 1)
    SELECT p_partkey AS id, coalesce(refs, 0) AS refs, coalesce(refs, 0) = 0 AS unused FROM part LEFT JOIN r ON id = p_partkey"""
)
def aud_ref_counts(spark, sf_dir):
    """References per item over several sources, zero where none."""
    lines = table(spark, sf_dir, "lineitem").withColumn("id", F.col("l_partkey"))
    refs = K.reference_counts([lines.where("l_returnflag = 'R'"), lines.where("l_discount > 0.05")], "id")
    out = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")).join(refs, "id", "left")
    return out.select("id", F.coalesce("refs", F.lit(0)).alias("refs"), F.col("refs").isNull().alias("unused"))


@query(
    """SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')
    AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) AND c_custkey IN (SELECT o_custkey FROM orders)"""
)
def aud_orphans_anti(spark, sf_dir):
    """Chained anti joins and a semi join."""
    orders = table(spark, sf_dir, "orders").withColumn("c_custkey", F.col("o_custkey"))
    out = table(spark, sf_dir, "customer")
    for bad in (orders.where("o_orderstatus = 'F'"), orders.where("o_totalprice > 400000")):
        out = out.join(bad.select("c_custkey"), "c_custkey", "left_anti")
    return out.join(orders.select("c_custkey"), "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@query(
    r"""WITH p AS (SELECT page_id, CAST(nullif(regexp_extract(url, '/(\d+)(?:\.html)?/?(?:[?#].*)?$', 1), '') AS BIGINT) AS item FROM pages)
    SELECT page_id, item FROM p WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = item AND p_size > 30)"""
)
def aud_semi_like(spark, sf_dir):
    """Pages of wanted items: the id is extracted and hashed, not searched in each link."""
    pages = table(spark, sf_dir, "pages").select("page_id", X.item_id(F.col("url")).cast("long").alias("item"))
    wanted = table(spark, sf_dir, "part").where("p_size > 30").select(F.col("p_partkey").alias("item"))
    return pages.join(wanted, "item", "left_semi").select("page_id", "item")


TRACK = "('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'ref', 'spm', 'fbclid', 'gclid')"
CANON = rf"""WITH b AS (SELECT page_id, url, regexp_replace(split_part(trim(url), '#', 1), '^(?i)https?://', '') AS bare FROM pages),
c AS (SELECT *, regexp_replace(split_part(bare, '?', 1), '/+$', '') AS path, list_filter(string_split(split_part(bare, '?', 2), '&'),
  lambda p: p <> '' AND split_part(p, '=', 1) NOT IN {TRACK}) AS kept FROM b),
canon AS (SELECT page_id, url, regexp_replace(lower(split_part(path, '/', 1)), '^www\.', '') || regexp_replace(path, '^[^/]*', '')
  || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS link_key FROM c)
"""


@query(CANON + "SELECT page_id, link_key FROM canon")
def url_canonical(spark, sf_dir):
    """Link keys without tracking."""
    return table(spark, sf_dir, "pages").select("page_id", X.canonical_url(F.col("url")).alias("link_key"))


@query(
    CANON
    + """, k AS (SELECT page_id, split_part(link_key, '/', 1) AS host, length(url) AS score FROM canon),
    g AS (SELECT host, count(*) AS n, arg_min(page_id, {'a': -score, 'b': page_id}) AS keeper FROM k GROUP BY 1 HAVING count(*) > 1)
    SELECT page_id, host, n, keeper, page_id = keeper AS keeps FROM k JOIN g USING (host)"""
)
def ddp_link_groups(spark, sf_dir):
    """Groups of two or more by link key with their keeper."""
    key = F.split_part(X.canonical_url(F.col("url")), F.lit("/"), F.lit(1))
    rows = table(spark, sf_dir, "pages").select("page_id", key.alias("host"), F.length("url").alias("score"))
    out = K.duplicate_groups(rows, "host", F.col("score"), "page_id")
    return out.select("page_id", "host", "n", "keeper", (F.col("page_id") == F.col("keeper")).alias("keeps"))


@query(
    """WITH d AS (SELECT lang, source, doc_id, n_chars, text FROM documents)
    SELECT lang, source, arg_min(doc_id, {'a': -n_chars, 'b': doc_id}) AS keeper, max({'a': length(text), 'b': -doc_id}).a AS longest, -max({'a': length(text), 'b': -doc_id}).b AS longest_id, count(*) AS n FROM d GROUP BY 1, 2"""
)
def ddp_keeper(spark, sf_dir):
    """Keeper per group and its longest text."""
    d = table(spark, sf_dir, "documents")
    longest = F.max(F.struct(F.length("text").alias("a"), (-F.col("doc_id")).alias("b")))
    out = d.groupBy("lang", "source").agg(F.min_by("doc_id", F.struct(-F.col("n_chars"), F.col("doc_id"))).alias("keeper"), longest.alias("x"), F.count("*").alias("n"))
    return out.select("lang", "source", "keeper", F.col("x.a").alias("longest"), (-F.col("x.b")).alias("longest_id"), "n")


@query(
    """WITH r AS (SELECT l_orderkey AS k, l_linenumber AS ord, CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE l_returnflag END AS flag, repeat(l_linestatus, CAST(l_quantity AS INTEGER)) AS note,
      l_partkey AS p, l_suppkey AS s FROM lineitem)
    SELECT k, struct_extract(min({'a': ord, 'b': p, 'c': s, 'flag': flag}) FILTER (WHERE flag IS NOT NULL), 'flag') AS flag, max(length(note)) AS longest, count(*) AS n FROM r GROUP BY k"""
)
def ddp_merge_fields(spark, sf_dir):
    """First filled and longest values over all rows of a group in keeper order, in one aggregation."""
    r = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ord"), F.when(F.col("l_linenumber") % 2 != 0, F.col("l_returnflag")).alias("flag"),
        F.expr("repeat(l_linestatus, CAST(l_quantity AS INT))").alias("note"), "l_partkey", "l_suppkey", F.lit(1).alias("one"),
    )
    order = [F.col(c) for c in ("ord", "l_partkey", "l_suppkey", "flag")]
    return K.merged_fields(r, "k", order, ["flag"], ["note"], {"n": F.sum("one")}).select("k", "flag", F.length("note").alias("longest"), "n")


@query(
    """WITH d AS (SELECT doc_id, text, left(text, 12) AS k, source = 'src0' AS ph FROM documents),
    f AS (SELECT text, min(doc_id) AS m FROM d WHERE NOT ph GROUP BY 1)
    SELECT doc_id, d.k FROM d LEFT JOIN f ON d.text IS NOT DISTINCT FROM f.text WHERE ph OR doc_id = m"""
)
def ddp_keep_first(spark, sf_dir):
    """First row per whole text in input order; placeholders stay (W5 P8). Two 64-bit hashes stand for the text in the join."""
    hashes = {"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")}
    d = table(spark, sf_dir, "documents").select("doc_id", F.left("text", F.lit(12)).alias("k"), (F.col("source") == "src0").alias("ph"), *[h.alias(n) for n, h in hashes.items()])
    return K.keep_first(d, ["h1", "h2"], "doc_id", F.col("ph")).select("doc_id", "k")


@query(
    """WITH r AS (SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS brand FROM part),
    p AS (SELECT name, count(DISTINCT CASE WHEN brand <> '' THEN lower(brand) END) AS b, min(CASE WHEN brand <> '' THEN lower(brand) END) AS o FROM r GROUP BY 1)
    SELECT id, lower(name) || '|' || CASE WHEN brand <> '' THEN lower(brand) WHEN b = 1 THEN o ELSE '' END AS group_key FROM r JOIN p USING (name)"""
)
def ddp_brand_partition(spark, sf_dir):
    """Same-name rows by brand; brandless rows join a sole brand."""
    r = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_brand")).alias("brand"))
    return K.brand_partition(r, "name", "brand").select("id", "group_key")


@query(
    rf"""WITH p AS (SELECT {HOST} AS host, page_id AS pos, CASE WHEN page_id % 3 = 0 THEN NULL ELSE left(url, 5) END AS scheme, [split_part(url, '/', 4)] AS hints FROM pages)
    SELECT host, min(pos) AS pos, arg_min(scheme, pos) FILTER (WHERE scheme IS NOT NULL) AS scheme, array_to_string(list_sort(list_distinct(flatten(list(hints)))), ',') AS hints FROM p GROUP BY 1"""
)
def list_merge_min_position(spark, sf_dir):
    """Listings by link: least position, first filled fields, union of hints."""
    p = table(spark, sf_dir, "pages").select(
        X.url_host(F.col("url")).alias("host"), F.col("page_id").alias("pos"), F.when(F.col("page_id") % 3 != 0, F.left("url", F.lit(5))).alias("scheme"),
        F.array(F.split_part("url", F.lit("/"), F.lit(4))).alias("hints"),
    )
    return K.merged_lists(p, "host", "pos", ["scheme"], "hints").withColumn("hints", F.array_join("hints", ","))


@query(
    """WITH u AS (SELECT c_mktsegment AS name, CAST(c_custkey AS VARCHAR) AS txt, 1 AS pri, c_custkey AS ord FROM customer WHERE c_custkey % 4 <> 0
      UNION ALL SELECT c_mktsegment, CASE WHEN c_custkey % 8 = 0 THEN ' ' ELSE 'x' || c_custkey END, 2, c_custkey FROM customer WHERE c_custkey % 4 = 0)
    SELECT name, arg_max(txt, {'a': pri, 'b': ord}) AS txt FROM u WHERE trim(txt) <> '' GROUP BY 1"""
)
def json_last_wins_map(spark, sf_dir):
    """Source map: later sources override, last wins, blanks skipped."""
    c, i = table(spark, sf_dir, "customer"), F.col("c_custkey")
    one = c.where(i % 4 != 0).select(F.col("c_mktsegment").alias("name"), i.cast("string").alias("txt"), F.lit(1).alias("pri"), i.alias("ord"))
    two = c.where(i % 4 == 0).select(F.col("c_mktsegment").alias("name"), F.when(i % 8 == 0, " ").otherwise(F.concat(F.lit("x"), i)).alias("txt"), F.lit(2).alias("pri"), i.alias("ord"))
    return one.unionByName(two).where(~X.is_blank(F.col("txt"))).groupBy("name").agg(F.max_by("txt", F.struct("pri", "ord")).alias("txt"))


@query(
    """WITH n AS (SELECT n_nationkey AS k, count(*) AS w FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), base AS (SELECT w FROM n WHERE k = 0)
    SELECT k, round(CAST(base.w AS DOUBLE) / n.w, 6) AS rate, floor(100 * CAST(base.w AS DOUBLE) / n.w + 0.5) AS price FROM n, base"""
)
def fx_cross_rates(spark, sf_dir):
    """Cross rates to a base currency and converted prices."""
    n = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    n = n.groupBy(F.col("n_nationkey").alias("k")).agg(F.count("*").alias("w"))
    rates = n.crossJoin(F.broadcast(n.where("k = 0").select(F.col("w").alias("base"))))  # one row
    rate = F.col("base").cast("double") / F.col("w")
    return rates.select("k", F.round(rate, 6).alias("rate"), F.floor(100 * rate + 0.5).cast("double").alias("price"))


@query("SELECT coalesce(max(c_custkey), -1) + 1 AS next_key, count(*) FILTER (WHERE c_acctbal < 0) AS negative, count(*) FILTER (WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) AS in_list FROM customer")
def aud_next_key(spark, sf_dir):
    """Next sort key and global filtered counts (A5 A2 P10)."""
    return table(spark, sf_dir, "customer").agg(
        (F.coalesce(F.max("c_custkey"), F.lit(-1)) + 1).alias("next_key"), F.count_if(F.col("c_acctbal") < 0).alias("negative"), F.count_if(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).alias("in_list")
    )


@query(
    """SELECT DISTINCT CASE WHEN c_mktsegment LIKE 'B%' OR c_mktsegment LIKE '%RY' THEN 'a' WHEN c_mktsegment ILIKE 'furn%' THEN 'f' ELSE lower(c_mktsegment) END AS grp,
    regexp_extract(c_name, '#0*(\\d)', 1) AS digit, split_part(c_name, '#', 1) AS prefix FROM customer""".replace("\\\\", "\\")
)
def cat_distinct_expressions(spark, sf_dir):
    """Distinct over expressions, pattern lists and captures."""
    seg = F.col("c_mktsegment")
    grp = F.when(F.expr("c_mktsegment LIKE ANY ('B%', '%RY')"), "a").when(seg.ilike("furn%"), "f").otherwise(F.lower(seg))
    return table(spark, sf_dir, "customer").select(grp.alias("grp"), F.regexp_extract("c_name", r"#0*(\d)", 1).alias("digit"), F.split_part("c_name", F.lit("#"), F.lit(1)).alias("prefix")).distinct()


@query(
    """WITH a AS (SELECT p_partkey AS id, p_name AS name, p_size AS size FROM part), b AS (SELECT s_suppkey AS id, s_name AS name FROM supplier)
    SELECT 'part' AS src, id, name, size FROM a UNION ALL SELECT 'supplier', id, name, NULL FROM b"""
)
def cat_union_tagged(spark, sf_dir):
    """Union with a source tag; missing columns are typed nulls."""
    a = table(spark, sf_dir, "part").select(F.lit("part").alias("src"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    b = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("src"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return a.unionByName(b, allowMissingColumns=True)
