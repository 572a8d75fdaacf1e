"""Queries of the full structured score, its gates and preference signals, over the catalog (part)."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.operators import fullscore as S
from talus.operators.candidates import price_band
from talus.plans.registry import query, table

ANSWERS = S.Answers(gender="female", form="PROMO", motor="ring", appearance="small", hidden="small", waterproof=4, max_noise=25, budget=(950.0, 1050.0))

ITEMS = """WITH items AS (SELECT p_partkey AS id, p_name AS name, p_type AS form, split_part(p_name, ' ', 1) AS appearance, split_part(p_name, ' ', 2) AS motor, p_brand AS brand, p_retailprice AS price,
    CASE WHEN p_brand LIKE '%1' THEN 'female' WHEN p_brand LIKE '%2' THEN 'male' WHEN p_brand NOT LIKE '%3' THEN 'unisex' END AS gender,
    CASE WHEN p_size % 11 <> 0 THEN p_size END AS noise, CASE WHEN p_size % 7 <> 0 THEN p_size % 9 END AS waterproof, p_size % 7 AS n_tags FROM part)"""


def items(spark, sf_dir):
    p, size = table(spark, sf_dir, "part"), F.col("p_size")
    gender = F.when(F.col("p_brand").like("%1"), "female").when(F.col("p_brand").like("%2"), "male").when(~F.col("p_brand").like("%3"), "unisex")
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("form"),
        F.split_part("p_name", F.lit(" "), F.lit(1)).alias("appearance"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("motor"),
        F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"), gender.alias("gender"), F.when(size % 11 != 0, size).alias("noise"),
        F.when(size % 7 != 0, size % 9).alias("waterproof"), (size % 7).alias("n_tags"),
    )


def _score_sql(preset: str) -> str:
    w, hard = S.PRESETS[preset], S.HARD[preset]
    gap = "greatest(950.0::DOUBLE - price, price - 1050.0::DOUBLE, 0.0::DOUBLE)"
    score = f"""CASE WHEN gender = 'female' THEN {w["gender_exact"]} WHEN gender = 'unisex' THEN {w["gender_unisex"]} ELSE {w["gender_miss"]} END
      + CASE WHEN form = 'PROMO' THEN {w["form_exact"]} ELSE {w["form_miss"]} END + CASE WHEN motor = 'ring' THEN {w["motor_exact"]} ELSE {w["motor_miss"]} END
      + CASE WHEN appearance = 'small' THEN {w["appearance_exact"]} ELSE {w["appearance_hidden_miss"]} END
      + CASE WHEN waterproof IS NULL THEN {w["waterproof_unknown"]} WHEN waterproof >= 4 THEN {w["waterproof_qualified"]} ELSE {w["waterproof_miss"]} END
      + CASE WHEN noise IS NULL THEN {w["noise_unknown"]} WHEN noise <= 25 THEN {w["noise_qualified"]}
             ELSE -least({-w["noise_miss_max"]}, greatest({-w["noise_miss_min"]}, ceil((noise - 25) / {w["noise_step"]}.0::DOUBLE) * {-w["noise_miss_step"]})) END
      + CASE WHEN {gap} = 0 THEN {w["budget_in_range"]} + greatest(0, {w["midpoint_bonus_max"]} - floor(abs(price - 1000.0::DOUBLE) / {w["midpoint_step"]}.0::DOUBLE + 0.5::DOUBLE))
             ELSE -least({-w["budget_miss_max"]}, {-w["budget_miss_base"]} + ceil({gap} / {w["budget_step"]}.0::DOUBLE) * {-w["budget_miss_step"]}) END
      + least(n_tags, {w["tags_bonus_max"]}) + CASE WHEN name LIKE '%gear%' THEN 7 WHEN name LIKE '%box%' THEN 4 ELSE 0 END"""
    miss = {
        "gender": "gender IS NULL OR gender = 'male'", "form": "form <> 'PROMO'", "motor": "motor <> 'ring'", "appearance": "appearance <> 'small'",
        "waterproof": "waterproof < 4", "noise": "noise > 25", "budget": f"{gap} > 0",
    }
    misses = " + ".join(f"CASE WHEN {miss[h]} THEN 1 ELSE 0 END" for h in hard)
    return f"CAST(greatest(floor({score} + 0.5::DOUBLE), 0) AS BIGINT) AS score_{preset}, CAST({misses} AS INTEGER) AS misses_{preset}"


@query(ITEMS + "SELECT id, " + ", ".join(_score_sql(p) for p in S.PRESETS) + " FROM items")
def rec_full_score(spark, sf_dir):
    """All terms of the structured score under three presets, hard misses by each preset's policy."""
    extra = S.disguise_bonus(F.col("name").contains("gear"), F.col("name").contains("box"), ANSWERS)
    out = ["id"]
    for name, weights in S.PRESETS.items():
        score, misses = S.full_score(ANSWERS, weights, S.HARD[name], F.col("n_tags"), extra)
        out += [score.alias(f"score_{name}"), misses.alias(f"misses_{name}")]
    return items(spark, sf_dir).select(*out)


@query(
    ITEMS
    + """SELECT id, form <> 'LARGE' AND motor <> 'box' AND gender IS NOT NULL AND gender IN ('female', 'unisex') AND appearance IN ('small', 'red', 'blue') AS own_gender,
    form <> 'LARGE' AND motor <> 'box' AND appearance IN ('small', 'red', 'blue') AND NOT coalesce(gender = 'female', false) AS two_men,
    form <> 'LARGE' AND motor <> 'box' AND appearance IN ('small', 'red', 'blue') AS mixed_couple FROM items"""
)
def rec_hard_gates(spark, sf_dir):
    """Eligibility, wanted and unwanted features and the gender gate of single and shared wishes."""
    must, avoid = [F.col("appearance").isin("small", "red", "blue")], [F.col("motor") == "box"]
    gate = lambda a: S.gates(F.col("form") != "LARGE", must, avoid, F.col("gender"), a)
    wishes = {"own_gender": S.Answers(gender="female"), "two_men": S.Answers(gender="unisex", partner="male_male"), "mixed_couple": S.Answers(gender="unisex", partner="mixed")}
    return items(spark, sf_dir).select("id", *[gate(a).alias(n) for n, a in wishes.items()])


FLAGS = {"quiet": ("noise <= 20", 1.0), "cheap": ("price < 950", 0.5), "sealed": ("waterproof >= 6", 1 / 3), "simple": ("n_tags <= 1", 1.0)}
SIGNALS = [("BUILDING", "quiet", 9), ("BUILDING", "cheap", 7), ("MACHINERY", "sealed", 10), ("MACHINERY", "simple", 5), ("HOUSEHOLD", "quiet", 4), ("HOUSEHOLD", "sealed", 8)]


@query(
    ITEMS
    + ", flags AS ("
    + " UNION ALL ".join(f"SELECT id, '{n}' AS signal, {share}::DOUBLE AS share FROM items WHERE {test}" for n, (test, share) in FLAGS.items())
    + "), signals(segment, signal, weight) AS (VALUES "
    + ", ".join(map(str, SIGNALS))
    + """), chosen AS (SELECT DISTINCT c_mktsegment AS segment FROM customer)
    SELECT segment, id, CAST(sum(floor(weight * share + 0.5::DOUBLE)) AS BIGINT) AS score FROM chosen JOIN signals USING (segment) JOIN flags USING (signal) GROUP BY 1, 2"""
)
def rec_signal_items(spark, sf_dir):
    """Preference signals of every segment times item flags, at the full, half or third weight."""
    flag = F.array_compact(F.array(*[F.when(F.expr(test), F.struct(F.lit(n).alias("signal"), F.lit(share).alias("share"))) for n, (test, share) in FLAGS.items()]))
    flags = items(spark, sf_dir).select("id", F.inline(flag))
    chosen = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment")).distinct()
    signals = spark.createDataFrame(SIGNALS, "segment string, signal string, weight int")
    return S.signal_scores(chosen.join(F.broadcast(signals), "segment"), flags, "segment")  # six rows


FAMILIES = [("article", r"\bthe\b", "", 3), ("plural", r"[a-z]{3}es\b", "", 2), ("number", r"\d{3}", r"\d{7}", 5), ("link", r"https?://", "", -4), ("secret", r"api[_ ]?key|token", r"no token", -6)]


@query(
    "WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), f AS (SELECT doc_id, "
    + ", ".join(f"regexp_matches(t, '{p}')" + (f" AND NOT regexp_matches(t, '{n}')" if n else "") + f' AS "{k}"' for k, p, n, _ in FAMILIES)
    + " FROM d) SELECT *, "
    + " + ".join(f'CASE WHEN "{k}" THEN {w} ELSE 0 END' for k, _, _, w in FAMILIES)
    + " AS adjustment FROM f"
)
def txt_signal_families(spark, sf_dir):
    """A struct of signal families with negative patterns, and the sum of their weights."""
    flags, score = S.families(F.col("text"), FAMILIES)
    return table(spark, sf_dir, "documents").select("doc_id", flags.alias("f"), score.alias("adjustment")).select("doc_id", "f.*", "adjustment")


BUDGETS = (r"(?:under|below|bis) (\d{2,5})", r"(\d{2,5}) (?:or less|max)", r"\b(\d{2,5})\b")


@query(
    "SELECT doc_id, coalesce("
    + ", ".join(f"CAST(nullif(regexp_extract(coalesce(text, ''), '{p}', 1), '') AS BIGINT)" for p in BUDGETS)
    + """) AS budget, CASE WHEN regexp_matches(lower(coalesce(text, '')), 'quiet|silent|leise') THEN 'quiet' WHEN regexp_matches(lower(coalesce(text, '')), 'license|copyright') THEN 'legal' WHEN lang = 'en' THEN 'plain' END AS wish FROM documents"""
)
def txt_answers(spark, sf_dir):
    """Answers from free text: a number by the first pattern that occurs, a wish by ordered rules."""
    t = F.lower(F.coalesce("text", F.lit("")))
    wish = F.when(t.rlike("quiet|silent|leise"), "quiet").when(t.rlike("license|copyright"), "legal").when(F.col("lang") == "en", "plain")
    return table(spark, sf_dir, "documents").select("doc_id", S.first_number(F.col("text"), BUDGETS).alias("budget"), wish.alias("wish"))


LEVELS = ("STANDARD", "ECONOMY", "PROMO", "SMALL", "MEDIUM", "LARGE")


@query(
    ITEMS
    + ", levels(form, level) AS (VALUES "
    + ", ".join(f"('{x}', {i})" for i, x in enumerate(LEVELS))
    + """), favourites AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R'),
    picked AS (SELECT items.*, coalesce(noise, 0) <= 40 AND contains(name, 'e') AND form NOT IN ('LARGE') AND gender = 'unisex' AS ok, id IN (SELECT id FROM favourites) AS favourite FROM items)
    SELECT coalesce(level, 99) AS level, form, motor, brand, count(*) AS n, count(*) FILTER (WHERE favourite) AS n_favourites,
      count(*) FILTER (WHERE price < 950) AS "under_950", count(*) FILTER (WHERE price BETWEEN 950 AND 1000) AS "950_to_1000", count(*) FILTER (WHERE price > 1000) AS "over_1000"
    FROM picked LEFT JOIN levels USING (form) WHERE ok GROUP BY 1, 2, 3, 4"""
)
def lib_facets_ordered(spark, sf_dir):
    """Conjunctive filter, then types in hierarchy order with their subtypes, and the brands that this origin has."""
    got = items(spark, sf_dir).where((F.coalesce("noise", F.lit(0)) <= 40) & F.col("name").contains("e") & (F.col("form") != "LARGE") & (F.col("gender") == "unisex"))
    liked = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("id")).distinct().withColumn("favourite", F.lit(True))
    got = got.join(liked, "id", "left")
    level = F.coalesce(*[F.when(F.col("form") == x, i) for i, x in enumerate(LEVELS)], F.lit(99))
    band = price_band(F.col("price"), (950.0, 1000.0))
    counts = [F.count_if(band == b).alias(b) for b in ("under_950", "950_to_1000", "over_1000")]
    return got.groupBy(level.alias("level"), "form", "motor", "brand").agg(F.count("*").alias("n"), F.count_if(F.coalesce("favourite", F.lit(False))).alias("n_favourites"), *counts)
