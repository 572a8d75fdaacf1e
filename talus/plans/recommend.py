"""Recommendation queries over the catalog (part: kind, brand, price; size stands for noise)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.operators import candidates as C
from talus.operators import ranking as R
from talus.operators import scoring as S
from talus.plans.registry import query, table

WANTED = C.Preferences(kind="PROMO", brand="Brand#7", budget=(910.0, 950.0), max_noise=25, waterproof=4, excluded_kinds=("LARGE",))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("kind"),
        F.col("p_brand").alias("brand"),
        F.col("p_retailprice").alias("price"),
        F.when(F.col("p_size") % 11 != 0, F.col("p_size")).alias("noise"),
        F.when(F.col("p_size") % 7 != 0, F.col("p_size") % 9).alias("waterproof"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = items(spark, sf_dir).where(C.hard_ok(F.col("kind"), WANTED) & C.eligible(F.col("kind"), ("SMALL",)))
    return S.score_columns(pool, WANTED, S.PRESETS["balanced"])


ITEMS = """
WITH items AS (
  SELECT p_partkey AS id, p_name AS name, p_type AS kind, p_brand AS brand, p_retailprice AS price,
         CASE WHEN p_size % 11 <> 0 THEN p_size END AS noise,
         CASE WHEN p_size % 7 <> 0 THEN p_size % 9 END AS waterproof
  FROM part),"""
SCORED = ITEMS + """
parts AS (
  SELECT *, greatest(910.0::DOUBLE - price, price - 950.0::DOUBLE, 0.0::DOUBLE) AS budget_gap, noise - 25 AS over
  FROM items WHERE kind NOT IN ('LARGE', 'SMALL')),
scored AS (
  SELECT id, name, kind, brand, price, noise, waterproof, budget_gap,
    CAST(greatest(floor(
      CASE WHEN kind = 'PROMO' THEN 24.0::DOUBLE ELSE 0 END + CASE WHEN brand = 'Brand#7' THEN 12.0::DOUBLE ELSE 0 END
      + CASE WHEN noise IS NULL THEN 4.0::DOUBLE
             WHEN over <= 0 THEN 18.0::DOUBLE + least(6.0::DOUBLE, floor(-over / 5.0::DOUBLE) * 2.0::DOUBLE)
             ELSE greatest(-12.0::DOUBLE, -over * 0.8::DOUBLE) END
      + CASE WHEN budget_gap = 0 THEN 20.0::DOUBLE + greatest(0.0::DOUBLE, 6.0::DOUBLE - abs(price - 930.0::DOUBLE) / 5)
             ELSE greatest(-20.0::DOUBLE, -budget_gap * 2.0::DOUBLE) END
      + CASE WHEN waterproof >= 4 THEN 8.0::DOUBLE ELSE 0 END + 0.5::DOUBLE), 0) AS BIGINT) AS score,
    CAST(CASE WHEN kind <> 'PROMO' THEN 1 ELSE 0 END + CASE WHEN over > 10 THEN 1 ELSE 0 END
      + CASE WHEN budget_gap > 20 THEN 1 ELSE 0 END AS INTEGER) AS hard_misses,
    CAST(greatest(coalesce(over, 0), 0) AS INTEGER) AS noise_gap
  FROM parts),
ranked AS (
  SELECT *, CAST(row_number() OVER (ORDER BY score DESC, hard_misses, budget_gap, noise_gap,
    coalesce(waterproof, -1) DESC, price, id) AS INTEGER) AS rank FROM scored)
"""


@query(SCORED + "SELECT id, kind, brand, score, hard_misses, noise_gap, rank, rank <= 3 AS in_top FROM ranked WHERE rank <= 10")
def rec_topk_weighted(spark, sf_dir):
    """Weighted score, six-key order, pool of ten and final three."""
    top = S.top_ranked(scored(spark, sf_dir), 10)
    return top.select("id", "kind", "brand", "score", "hard_misses", "noise_gap", "rank", (F.col("rank") <= 3).alias("in_top"))


@query(
    ITEMS
    + """ x AS (SELECT 1) SELECT id, kind, price BETWEEN 910 AND 950 AND (noise IS NULL OR noise <= 25)
    AND (waterproof IS NULL OR waterproof >= 4) AS passes_soft FROM items WHERE kind NOT IN ('LARGE', 'SMALL')"""
)
def rec_two_tier_pool(spark, sf_dir):
    """Relaxed pool with the strict pool marked, one scan."""
    hard = C.hard_ok(F.col("kind"), WANTED) & C.eligible(F.col("kind"), ("SMALL",))
    soft = C.soft_ok(F.col("price"), F.col("noise"), F.col("waterproof"), WANTED)
    return C.two_tier(items(spark, sf_dir), hard, soft).select("id", "kind", "passes_soft")


@query(
    ITEMS
    + """ c AS (SELECT price BETWEEN 910 AND 950 AS b, noise IS NULL OR noise <= 25 AS n, waterproof IS NULL OR waterproof >= 4 AS w FROM items)
    SELECT 'budget' AS constraint_name, count(*) FILTER (WHERE NOT b AND n AND w) AS only_failing FROM c
    UNION ALL SELECT 'noise', count(*) FILTER (WHERE NOT n AND b AND w) FROM c
    UNION ALL SELECT 'waterproof', count(*) FILTER (WHERE NOT w AND b AND n) FROM c"""
)
def rec_near_miss_counts(spark, sf_dir):
    """Items that fail exactly one constraint, by constraint."""
    return C.near_misses(items(spark, sf_dir), C.soft_checks(F.col("price"), F.col("noise"), F.col("waterproof"), WANTED))


@query(
    SCORED
    + """, rest AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY rank) AS rn FROM ranked WHERE rank > 3 AND rank <= 60),
    picks AS (SELECT id, brand, score, rank, CAST(row_number() OVER (ORDER BY CASE WHEN rn > 1 THEN 1 ELSE 0 END, rank) AS INTEGER) AS pick FROM rest)
    SELECT * FROM picks WHERE pick <= 8"""
)
def rec_backup_diverse(spark, sf_dir):
    """Backups after the first three: one per brand in rank order, then the rest."""
    pool = S.top_ranked(scored(spark, sf_dir), 60).where("rank > 3")
    return R.diversified(pool, "brand", 8).select("id", "brand", "score", "rank", "pick")


@query(
    SCORED
    + """, pool AS (SELECT * FROM ranked WHERE rank <= 50),
    ends AS (SELECT min(price) a, max(price) b, min(noise) c, max(noise) d FROM pool),
    pos AS (SELECT id, CASE WHEN b = a THEN 0.5 ELSE 1 - (price - a) / (b - a) END AS cheap,
      CASE WHEN noise IS NULL THEN -1 WHEN d = c THEN 0.5 ELSE 1 - (noise - c) / CAST(d - c AS DOUBLE) END AS quiet FROM pool, ends)
    SELECT id, round(cheap, 6) AS cheap, round(quiet, 6) AS quiet,
      CASE WHEN cheap >= quiet THEN 'cheap' ELSE 'quiet' END AS direction FROM pos"""
)
def rec_direction_minmax(spark, sf_dir):
    """Min-max positions in the pool and the stronger direction."""
    pool = R.with_range(S.top_ranked(scored(spark, sf_dir), 50), "price", "noise")
    cheap = 1 - R.min_max("price", 2.0)
    quiet = F.when(F.col("noise").isNull(), -1.0).otherwise(1 - R.min_max("noise", 2.0))
    both = pool.select("id", cheap.alias("cheap"), quiet.alias("quiet"))
    return both.select("id", F.round("cheap", 6).alias("cheap"), F.round("quiet", 6).alias("quiet"), R.best_direction([("cheap", F.col("cheap")), ("quiet", F.col("quiet"))]).alias("direction"))


@query(
    SCORED
    + """, pool AS (SELECT id, rank FROM ranked WHERE rank <= 10),
    ext AS (SELECT id, min(r) AS ext_rank FROM (SELECT id, (id * 7919) % 101 AS r FROM ranked WHERE rank % 2 = 0 AND rank <= 16
            UNION ALL SELECT id, 500 FROM ranked WHERE rank <= 2) GROUP BY id),
    o AS (SELECT p.id, p.rank, CAST(row_number() OVER (ORDER BY coalesce(CAST(ext_rank AS DOUBLE), 1e9 + p.rank), p.id) AS INTEGER) AS final_rank
          FROM pool p LEFT JOIN ext USING (id)) SELECT id, rank, final_rank FROM o WHERE final_rank <= 5"""
)
def rec_rerank_reconcile(spark, sf_dir):
    """An outside order against the pool: intersect, drop repeats, pad, cut."""
    top = S.top_ranked(scored(spark, sf_dir), 16)
    ext = top.where("rank % 2 = 0").select("id", ((F.col("id") * 7919) % 101).alias("ext_rank"))
    ext = ext.unionByName(top.where("rank <= 2").select("id", F.lit(500).cast("long").alias("ext_rank")))
    return R.reconciled(top.where("rank <= 10").select("id", "rank"), ext, 5).select("id", "rank", "final_rank")


@query(
    SCORED
    + """, t AS (SELECT rank, unnest([{'a': 'brand', 'v': brand}, {'a': 'kind', 'v': kind}, {'a': 'score', 'v': CAST(score AS VARCHAR)}]) AS s FROM ranked WHERE rank <= 3)
    SELECT s.a AS attribute, max(s.v) FILTER (WHERE rank = 1) AS item_1, max(s.v) FILTER (WHERE rank = 2) AS item_2,
      max(s.v) FILTER (WHERE rank = 3) AS item_3 FROM t GROUP BY s.a"""
)
def rec_compare_pivot(spark, sf_dir):
    """Attribute rows by the three best items as columns."""
    return R.comparison(S.top_ranked(scored(spark, sf_dir), 3), {"brand": "brand", "kind": "kind", "score": "score"}, 3)


@query(
    ITEMS
    + """ x AS (SELECT 1) SELECT count(*) AS pool, round(avg(CASE WHEN brand IN ('Brand#7', 'Brand#8', 'Brand#9') THEN 1.0 ELSE 0.0 END), 6) AS share,
    CASE WHEN avg(CASE WHEN brand IN ('Brand#7', 'Brand#8', 'Brand#9') THEN 1.0 ELSE 0.0 END) >= 0.35 THEN 'brand_led' ELSE 'balanced' END AS preset FROM items"""
)
def rec_pool_share_preset(spark, sf_dir):
    """Share of the pool's brands decides the weight preset."""
    got = S.preset_by_share(items(spark, sf_dir), F.col("brand").isin("Brand#7", "Brand#8", "Brand#9"), 0.35, "brand_led", "balanced")
    return got.select("pool", F.round("share", 6).alias("share"), "preset")


@query(
    SCORED
    + """SELECT CASE WHEN hard_misses >= 2 OR score < 40 THEN 'backup' WHEN hard_misses > 0 OR budget_gap > 0 THEN 'conditional' ELSE 'high' END AS band,
    count(*) AS n, min(score) AS low, max(score) AS high FROM ranked GROUP BY 1"""
)
def rec_confidence_band(spark, sf_dir):
    """Confidence bands of all scored items."""
    band = R.confidence(F.col("hard_misses"), F.col("score"), F.col("budget_gap"), 40).alias("band")
    return scored(spark, sf_dir).groupBy(band).agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))


@query(
    SCORED
    + """, t AS (SELECT * FROM ranked WHERE rank <= 5)
    SELECT max(id) FILTER (WHERE rank = 1) AS top1, CAST(count(DISTINCT kind) FILTER (WHERE kind IN ('ECONOMY', 'SMALL')) AS INTEGER) AS n_forbidden,
      CAST(1 - count(DISTINCT kind) FILTER (WHERE kind = 'PROMO') AS INTEGER) AS n_missing,
      count(*) FILTER (WHERE kind IN ('ECONOMY', 'SMALL')) = 0 AND count(*) FILTER (WHERE kind = 'PROMO') > 0 AS passed FROM t"""
)
def eval_topk_checks(spark, sf_dir):
    """Scenario: first id, forbidden and required kinds among the five best."""
    return R.checked(S.top_ranked(scored(spark, sf_dir), 5), 5, ["ECONOMY", "SMALL"], ["PROMO"], "kind")


@query(
    SCORED
    + """SELECT id, array_to_string(list_filter([CASE WHEN kind = 'PROMO' THEN 'right kind' END, CASE WHEN budget_gap = 0 THEN 'within budget' END,
      CASE WHEN noise <= 25 THEN 'quiet enough' END, CASE WHEN waterproof >= 4 THEN 'waterproof' END, CASE WHEN brand = 'Brand#7' THEN 'wanted brand' END][1:5],
      lambda x: x IS NOT NULL)[1:4], '; ') AS summary FROM ranked WHERE rank <= 20"""
)
def rec_match_summary(spark, sf_dir):
    """Up to four reasons of the twenty best items."""
    lines = [
        (F.col("kind") == "PROMO", "right kind"),
        (F.col("budget_gap") == 0, "within budget"),
        (F.col("noise") <= 25, "quiet enough"),
        (F.col("waterproof") >= 4, "waterproof"),
        (F.col("brand") == "Brand#7", "wanted brand"),
    ]
    top = S.top_ranked(scored(spark, sf_dir), 20)
    return top.select("id", F.array_join(R.match_summary(lines), "; ").alias("summary"))


@query(
    ITEMS
    + """ t(answer, signal, weight) AS (VALUES ('view', 'discovery', 3), ('view', 'trend', 1), ('click', 'discovery', 5), ('click', 'quiet', 2),
    ('purchase', 'loyal', 8), ('purchase', 'trend', 4), ('signup', 'loyal', 2)),
    s AS (SELECT user_id, signal, max(weight) AS weight FROM events JOIN t ON answer = event_type GROUP BY 1, 2)
    SELECT user_id, signal, weight, CAST(floor(weight / 2.0 + 0.5) AS INTEGER) AS half_weight FROM s"""
)
def rec_preference_signals(spark, sf_dir):
    """Answers to weighted signals, the heaviest per signal, with the half weight of weaker matches."""
    rows = [("view", "discovery", 3), ("view", "trend", 1), ("click", "discovery", 5), ("click", "quiet", 2), ("purchase", "loyal", 8), ("purchase", "trend", 4), ("signup", "loyal", 2)]
    templates = spark.createDataFrame(rows, "answer string, signal string, weight int")
    answers = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("answer"))
    got = S.signal_weights(answers, templates, "user_id")
    return got.withColumn("half_weight", S.half_up(F.col("weight") / 2).cast("int"))


@query(
    """SELECT CASE WHEN p_retailprice < 910 THEN 'under_910' WHEN p_retailprice <= 930 THEN '910_to_930' WHEN p_retailprice <= 950 THEN '930_to_950'
    WHEN p_retailprice > 950 THEN 'over_950' END AS band, count(*) AS n, round(min(p_retailprice), 2) AS low, round(max(p_retailprice), 2) AS high FROM part GROUP BY 1"""
)
def lib_price_bands(spark, sf_dir):
    """Items by price band."""
    band = C.price_band(F.col("price"), (910.0, 930.0, 950.0)).alias("band")
    return items(spark, sf_dir).groupBy(band).agg(F.count("*").alias("n"), F.round(F.min("price"), 2).alias("low"), F.round(F.max("price"), 2).alias("high"))


@query(
    """SELECT p_type AS kind, p_brand AS brand, count(*) AS n, count(*) FILTER (WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)) AS n_favorites
    FROM part WHERE p_name LIKE '%gear%' AND p_size BETWEEN 5 AND 40 AND p_retailprice <= 980 GROUP BY 1, 2"""
)
def lib_filter_facets(spark, sf_dir):
    """Conjunctive library filter and the facets that are left, with favorites as a semi join."""
    part = table(spark, sf_dir, "part").where("p_name LIKE '%gear%' AND p_size BETWEEN 5 AND 40 AND p_retailprice <= 980")
    liked = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("liked", F.lit(True))
    rows = part.join(liked, "p_partkey", "left")
    return rows.groupBy(F.col("p_type").alias("kind"), F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"), F.count_if("liked").alias("n_favorites"))
