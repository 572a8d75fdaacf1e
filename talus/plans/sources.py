"""Queries of sources, sinks and written tables, and of the smaller functions, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from talus.functions import columns as X
from talus.operators import adjustments as A
from talus.operators import candidates as N
from talus.operators import catalog as K
from talus.operators import classify as C
from talus.operators import ingest as I
from talus.plans.registry import query, table
from talus.sources import files, tables


def folder(spark, name: str) -> str:
    return f"{tables.scratch(spark)}/talus/{name}-{uuid.uuid4().hex}"


@query(
    """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1"""
)
def cat_upsert_batches(spark, sf_dir):
    """Three batches of events upserted into a bucketed table, the second one twice (S8 ST4 S14)."""
    t = tables.KeyedTable(spark, folder(spark, "keyed"), ["user_id", "event_type"], "event_id", 16)
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    for batch_id, part in ((0, 0), (1, 2), (1, 2), (2, 1)):  # out of order, and once more
        t.upsert(rows.where(F.col("event_id") % 3 == part), batch_id)
    return t.read()


@query(
    """SELECT CASE WHEN p_size % 2 = 0 THEN 'item:' || p_size || '-' || (p_partkey % 97) ELSE 'title:' || lower(trim(p_name || ' ' || p_type)) END AS key, min(p_partkey) AS id, count(*) AS n FROM part GROUP BY 1"""
)
def src_ingest_resumed(spark, sf_dir):
    """Entries ingested once by item id or title over a run of half of them and a repeated run of all (ST6 S3 S4)."""
    part = table(spark, sf_dir, "part")
    item = F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit("-"), (F.col("p_partkey") % 97).cast("string")))
    rows = part.select(F.col("p_partkey").alias("id"), tables.cache_key(item, F.concat_ws(" ", "p_name", "p_type")).alias("key"))
    path = folder(spark, "entries")
    half = part.agg(F.expr("percentile_approx(p_partkey, 0.5)")).first()[0]
    for few in (rows.where(F.col("id") <= (half or 0)), rows, rows):
        tables.ingest(few, "key", "id", path, 4)
    got = tables.read_ingested(spark, path) if tables.exists(spark, path) else rows
    return got.join(rows.groupBy("key").agg(F.count("*").alias("n")), "key").select("key", "id", "n")


@query("""SELECT p_name AS name, p_retailprice AS price, p_size % 2 = 0 AS reviewed, count(*) AS n FROM part GROUP BY 1, 2, 3""")
def src_buffer_round_trip(spark, sf_dir):
    """Review entries written as JSON arrays and read back, entries that are no objects aside."""
    part = table(spark, sf_dir, "part")
    path = folder(spark, "buffer")
    files.write_buffer(part.select(F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"), (F.col("p_size") % 2 == 0).alias("isReviewed")), path)
    got = files.read_buffer(spark, path)
    return got.groupBy("name", "price", F.col("isReviewed").alias("reviewed")).agg(F.count("*").alias("n"))


@query(
    """WITH v AS (SELECT p_brand AS handle, p_partkey AS id, p_name AS title, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_retailprice END AS price FROM part) SELECT id, title, round(price, 2) AS price FROM v"""
)
def src_storefront(spark, sf_dir):
    """Products of paged feeds with the price of the first variant that has one."""
    part = table(spark, sf_dir, "part")
    price = F.when(F.col("p_size") % 3 == 0, "ask").otherwise(F.format_string("%.2f", "p_retailprice"))
    variants = F.array(F.struct(F.lit(1).alias("id"), F.lit("n/a").alias("price")), F.struct(F.lit(2).alias("id"), price.alias("price")))
    product = F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.array("p_type").alias("tags"), variants.alias("variants"))
    page = F.floor(F.col("p_partkey") / 250)  # feeds have pages of 250 products
    path = folder(spark, "feed")
    part.select(page.alias("page"), product.alias("p")).groupBy("page").agg(F.to_json(F.struct(F.collect_list("p").alias("products"))).alias("value")).write.partitionBy("page").text(path)  # a file per page
    return files.read_storefront(spark, path).select("id", "title", files.variant_price(F.col("variants")).alias("price"))


@query(
    """WITH e AS (SELECT event_type, count(*) AS n, sum(value) FILTER (WHERE value IS NOT NULL) AS s FROM events GROUP BY 1) SELECT event_type, 2 * n AS n FROM e"""
)
def src_append_events(spark, sf_dir):
    """Events appended twice to a log, as feedback is."""
    path = folder(spark, "log")
    rows = table(spark, sf_dir, "events").select("event_type", "event_id")
    for _ in range(2):
        files.append_events(rows, path)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT p_type AS kind, count(*) AS n, true AS same, true AS skipped, true AS changed FROM part WHERE p_partkey % 2 = 0 GROUP BY 1""")
def src_versioned_seed(spark, sf_dir):
    """A table replaced by a seed only when the seed's content version is new; row order does not matter."""
    path = folder(spark, "seed")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    first = files.seed(spark, rows, path, None)
    again = files.seed(spark, rows.repartition(5).where("false"), path, files.content_version(rows.where("false")))  # known: nothing is written
    same = files.content_version(rows.repartition(3)) == first
    skipped = spark.read.parquet(path).count() == rows.count() and again != first
    second = files.seed(spark, rows.where("p_partkey % 2 = 0"), path, first)
    out = spark.read.parquet(path).groupBy(F.col("p_type").alias("kind")).agg(F.count("*").alias("n"))
    return out.select("kind", "n", F.lit(same).alias("same"), F.lit(skipped).alias("skipped"), F.lit(second != first).alias("changed"))


@query(
    """WITH w AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS q FROM part) SELECT q, min(p_partkey) AS id FROM w JOIN part ON contains(lower(p_name), q) GROUP BY 1"""
)
def src_find_brand(spark, sf_dir):
    """The least id whose name contains a word, whatever its case, for every first word."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return files.find_brands(part, part.select(F.upper(F.split_part("name", F.lit(" "), F.lit(1))).alias("q"))).select(F.lower("q").alias("q"), "id")


@query(
    """WITH k AS (SELECT DISTINCT p_type AS t FROM part WHERE p_size > 25), c AS (SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN 'GONE' ELSE p_type END AS choice FROM part)
    SELECT id, coalesce(t, 'all') AS kept FROM c LEFT JOIN k ON choice = t"""
)
def lib_valid_choices(spark, sf_dir):
    """Stored choices that the facet still has, others become "all" (F9)."""
    part = table(spark, sf_dir, "part")
    known = part.where("p_size > 25").select(F.col("p_type").alias("code")).distinct()
    chosen = part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 4 == 0, "GONE").otherwise(F.col("p_type")).alias("choice"))
    return N.valid_choices(chosen, "choice", known, "code").select("id", F.col("choice").alias("kept"))


@query(
    """WITH t AS (SELECT p_partkey AS id, [p_name, p_type] AS a, CASE WHEN p_size % 5 = 0 THEN NULL ELSE [p_type, p_brand] END AS b, CASE p_size % 4 WHEN 0 THEN 'Untitled' WHEN 1 THEN ' ' WHEN 2 THEN 'item 7' ELSE p_name END AS n, p_brand FROM part)
    SELECT id, array_to_string(CASE WHEN b IS NULL THEN a ELSE list_append(a, b[2]) END, '|') AS gallery, CASE WHEN n NOT IN ('Untitled', ' ', 'item 7') THEN n ELSE p_brand END AS name FROM t"""
)
def ing_galleries_and_names(spark, sf_dir):
    """Galleries joined in order, each picture once, and names recovered along a chain."""
    size = F.col("p_size")
    other = F.when(size % 5 != 0, F.array("p_type", "p_brand"))
    name = F.when(size % 4 == 0, "Untitled").when(size % 4 == 1, " ").when(size % 4 == 2, "item 7").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.array_join(I.gallery(F.array("p_name", "p_type"), other), "|").alias("gallery"), K.recovered_name(name, F.col("p_brand")).alias("name")
    )


@query(
    """WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS l, n_chars FROM documents)
    SELECT doc_id, concat_ws('|', CASE WHEN contains(l, 'license') THEN 'legal' END, CASE WHEN contains(l, 'the') THEN 'english' END, CASE WHEN contains(l, 'http') THEN 'link' END) AS tags,
      coalesce(CASE WHEN n_chars % 2 = 0 THEN n_chars END, 45) AS size, coalesce(lang, 'any') AS lang, NOT regexp_matches(regexp_replace(l, 'all rights reserved', ' ', 'g'), 'spam') AND source IN ('src0', 'src1', 'src2') AND regexp_matches(regexp_replace(l, 'all rights reserved', ' ', 'g'), 'right|the') AS device
    FROM (SELECT t.*, lang, source FROM t JOIN documents USING (doc_id))"""
)
def ing_tags_specs_device(spark, sf_dir):
    """Keyword tags, given values over defaults, and the decision list of a candidate."""
    d, text = table(spark, sf_dir, "documents"), F.col("text")
    tags = I.tags(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)tags?:", " "), [("legal", "license"), ("english", "the"), ("link", "http")])
    spec = I.specs({"size": F.when(F.col("n_chars") % 2 == 0, F.col("n_chars")), "lang": F.col("lang")}, {"size": F.lit(45).cast("long"), "lang": F.lit("any")})
    device = A.device_candidate(text, F.col("source"), ("src0", "src1", "src2"), "spam", "all rights reserved", "right|the")
    return d.select("doc_id", F.array_join(tags, "|").alias("tags"), *spec, device.alias("device"))


@query(
    """WITH n AS (SELECT n_regionkey AS region, upper(left(n_name, 3)) AS c, (n_nationkey + 1) * 0.25::DOUBLE AS r, n_nationkey AS k FROM nation),
    x AS (SELECT region, c, arg_max(r, k) AS r FROM n GROUP BY 1, 2), b AS (SELECT region, max(r) FILTER (WHERE c = (SELECT min(c) FROM n)) AS base FROM x GROUP BY 1)
    SELECT region, c AS currency, round(base / r, 9) AS rate FROM x JOIN b USING (region) WHERE base IS NOT NULL
    UNION ALL SELECT region, (SELECT min(c) FROM n), 1.0 FROM b WHERE base IS NULL"""
)
def fx_rates_from_text(spark, sf_dir):
    """Rates found in a text and the cross rates to one currency, or the fallback where it is missing (I16)."""
    n = table(spark, sf_dir, "nation")
    entry = F.concat(F.lit('"USD'), F.upper(F.left("n_name", F.lit(3))), F.lit('" : ["'), ((F.col("n_nationkey") + 1) * 0.25).cast("string"), F.lit('", 1]'))
    texts = n.groupBy(F.col("n_regionkey").alias("region")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", entry.alias("e")))), lambda x: x["e"]), ", ").alias("text"))
    to = (n.agg(F.min(F.upper(F.left("n_name", F.lit(3))))).first()[0]) or "AAA"
    rates = X.cross_rates(X.usd_rates(F.col("text")), to, to, {to: 1.0})
    return texts.select("region", F.explode(rates).alias("currency", "rate")).withColumn("rate", F.round("rate", 9))


@query("SELECT event_id, props AS restored, props IS NULL AS lost FROM events")
def sec_encrypted_props(spark, sf_dir):
    """Private JSON sealed with AES-256-GCM and opened again; with the tag of another value it does not open."""
    key = X.secret_key("0123456789abcdef" * 4)
    path = folder(spark, "sealed")
    table(spark, sf_dir, "events").select("event_id", "props", X.encrypted(F.col("props"), key).alias("e")).write.parquet(path)
    sealed = spark.read.parquet(path)
    spoilt = F.col("e").withField("ciphertext", F.base64(F.concat(F.unbase64("e.ciphertext"), F.lit(b"x"))))
    opened = X.decrypted(F.col("e"), key)
    return sealed.select("event_id", F.when(X.decrypted(spoilt, key).isNull(), opened).alias("restored"), opened.isNull().alias("lost"))


@query(
    """WITH d AS (SELECT doc_id, replace(coalesce(text, ''), chr(13), chr(10)) AS t FROM documents), l AS (SELECT doc_id, t, list_transform(string_split(t, chr(10)), lambda x: length(x)) AS sizes FROM d),
    f AS (SELECT doc_id, t, list_reduce(list_prepend({'n': 0::BIGINT, 'done': 0::BIGINT, 'x': 0::BIGINT}, list_transform(sizes, lambda x: {'n': 0::BIGINT, 'done': 0::BIGINT, 'x': x::BIGINT})),
      lambda s, e: CASE WHEN CASE WHEN s.n > 0 THEN s.n + 1 + e.x ELSE e.x END <= 300 THEN {'n': CASE WHEN s.n > 0 THEN s.n + 1 + e.x ELSE e.x END, 'done': s.done, 'x': 0::BIGINT}
        ELSE {'n': CASE WHEN e.x <= 300 THEN e.x ELSE 0 END, 'done': s.done + CASE WHEN s.n > 0 THEN 1 ELSE 0 END + CASE WHEN e.x > 300 THEN CAST(ceil(e.x / 300.0) AS BIGINT) ELSE 0 END, 'x': 0::BIGINT} END) AS s FROM l)
    SELECT doc_id, CASE WHEN length(t) <= 300 THEN 1 ELSE s.done + CASE WHEN s.n > 0 THEN 1 ELSE 0 END END AS n_chunks, sha256(replace(t, chr(10), '')) AS content FROM f"""
)
def txt_line_chunks(spark, sf_dir):
    """Texts cut into chunks of 300 characters at their lines, and the content that all chunks have together."""
    parts = X.chunks(F.col("text"), 300)
    got = table(spark, sf_dir, "documents").select("doc_id", parts.alias("c"))
    return got.select("doc_id", F.size("c").cast("long").alias("n_chunks"), F.sha2(F.replace(F.array_join("c", ""), F.lit("\n"), F.lit("")).cast("binary"), 256).alias("content"))


@query(
    """WITH dim AS (SELECT p_brand AS parent, p_type AS child, row_number() OVER (PARTITION BY p_brand ORDER BY min(p_size), p_type) AS ordinal FROM part WHERE p_size > 44 GROUP BY 1, 2),
    r AS (SELECT p_partkey AS id, p_brand AS parent, CASE WHEN p_size % 3 > 0 THEN p_type END AS stored, CASE WHEN p_size % 2 = 0 THEN 'SMALL' ELSE 'LARGE' END AS guess FROM part)
    SELECT id, coalesce(a.child, b.child) AS subtype, CAST(coalesce(a.ordinal, b.ordinal) AS INTEGER) AS ordinal FROM r LEFT JOIN dim a ON a.parent = r.parent AND a.child = stored LEFT JOIN dim b ON b.parent = r.parent AND b.child = guess"""
)
def cls_hierarchy(spark, sf_dir):
    """Stored subtypes, then inferred ones, where the hierarchy, a table, has them under the row's type; with their place in it."""
    part = table(spark, sf_dir, "part")
    least = part.where("p_size > 44").groupBy(F.col("p_brand").alias("parent"), F.col("p_type").alias("child")).agg(F.min("p_size").alias("least"))
    dim = I.renumbered(least.withColumn("at", F.struct("least", "child")), ["parent"], "at").select("parent", "child", F.col("position").alias("ordinal"))
    rows = part.select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("parent"), F.when(F.col("p_size") % 3 > 0, F.col("p_type")).alias("stored"), F.when(F.col("p_size") % 2 == 0, "SMALL").otherwise("LARGE").alias("guess")
    )
    return C.under_table(rows, "parent", ["stored", "guess"], dim).select("id", "subtype", "ordinal")
