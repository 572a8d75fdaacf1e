"""Classification, description and scalar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.functions import columns as X
from talus.operators import classify as C
from talus.operators.candidates import contaminant
from talus.plans.registry import query, table

HARD = [("^red ", "hers", "hard red", 0.95), ("^blue ", "his", "hard blue", 0.95)]
SOFT = [("ring|widget", "hers", "soft jewel", 0.7), ("anvil|bolt", "his", "soft tool", 0.7)]
BRANDS = {"Brand#1": "his", "Brand#2": "hers"}
FIRST = [("box$", "case", "accessory", 0.95)]
TYPES = {"hers": [("ring", "jewel", "ring word", 0.9), ("widget|gear", "gadget", "gadget word", 0.8)], "his": [("anvil|bolt", "tool", "tool word", 0.9)], "all": [("gear", "gadget", "gear word", 0.7)]}
SUBTYPES = [("^small|^tiny", "mini", "size word", 0.8), ("^red|^blue", "colour", "colour word", 0.8)]
CHILDREN = {"jewel": ("mini", "colour"), "gadget": ("mini",), "tool": ("colour", "heavy")}


def _cases(column: str, cases) -> str:
    return " ".join(f"WHEN regexp_matches({column}, '{p}') THEN {{'value': '{v}', 'reason': '{r}', 'confidence': {c}::DOUBLE}}" for p, v, r, c in cases)


def _under(code: str) -> str:
    tests = " OR ".join(f"(kind = '{p}' AND {code} IN ({', '.join(repr(x) for x in c)}))" for p, c in CHILDREN.items())
    return f"CASE WHEN {tests} THEN {code} END"


@query(
    f"""WITH p AS (SELECT p_partkey AS id, p_name AS name, p_brand AS brand, CASE p_size % 6 WHEN 0 THEN 'his' WHEN 1 THEN 'odd' END AS stored, CASE p_size % 4 WHEN 0 THEN 'tool' WHEN 1 THEN 'nonsense' END AS old_kind,
      CASE p_size % 5 WHEN 0 THEN 'heavy' WHEN 1 THEN 'mini' END AS old_sub, CASE WHEN p_size % 7 = 0 THEN ' ' ELSE p_type END AS evidence FROM part),
    a AS (SELECT *, CASE {_cases("name", HARD)} WHEN stored IN ('his', 'hers', 'all') THEN {{'value': stored, 'reason': 'stored', 'confidence': 0.9::DOUBLE}} {_cases("name", SOFT)}
      WHEN brand = 'Brand#1' THEN {{'value': 'his', 'reason': 'brand', 'confidence': 0.62::DOUBLE}} WHEN brand = 'Brand#2' THEN {{'value': 'hers', 'reason': 'brand', 'confidence': 0.62::DOUBLE}} ELSE {{'value': 'all', 'reason': 'default', 'confidence': 0.0::DOUBLE}} END AS who FROM p),
    t AS (SELECT *, CASE {_cases("name", FIRST)} """
    + " ".join(f"WHEN who.value = '{w}' AND regexp_matches(name, '{p}') THEN {{'value': '{v}', 'reason': '{r}', 'confidence': {c}::DOUBLE}}" for w, own in TYPES.items() for p, v, r, c in own)
    + f""" ELSE {{'value': 'other', 'reason': 'default', 'confidence': 0.0::DOUBLE}} END AS typed FROM a),
    k AS (SELECT *, CASE WHEN old_kind IN ('case', 'jewel', 'gadget', 'tool', 'other') THEN old_kind ELSE typed.value END AS kind, CASE {_cases("name", SUBTYPES)} ELSE {{'value': 'plain', 'reason': 'default', 'confidence': 0.0::DOUBLE}} END AS sub FROM t),
    s AS (SELECT *, coalesce({_under("old_sub")}, {_under("sub.value")}) AS subtype FROM k)
    SELECT id, who.value AS audience, who.reason AS reason, who.confidence AS confidence, kind, subtype,
      kind IN ('jewel', 'gadget', 'case') AND NOT regexp_matches(name, 'large|anvil') AND trim(evidence) <> '' AND NOT (kind IS NOT DISTINCT FROM old_kind AND subtype IS NOT DISTINCT FROM old_sub) AS safe FROM s"""
)
def cls_resolve(spark, sf_dir):
    """Audience with reason and confidence, type by audience, subtype valid under its type, stored values first, and the gate of safe patches."""
    size, name = F.col("p_size"), F.col("p_name")
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), name.alias("name"), F.col("p_brand").alias("brand"), F.when(size % 6 == 0, "his").when(size % 6 == 1, "odd").alias("stored"),
        F.when(size % 4 == 0, "tool").when(size % 4 == 1, "nonsense").alias("old_kind"), F.when(size % 5 == 0, "heavy").when(size % 5 == 1, "mini").alias("old_sub"),
        F.when(size % 7 == 0, " ").otherwise(F.col("p_type")).alias("evidence"),
    )
    p = p.withColumn("who", C.audience(F.col("stored"), F.col("name"), F.col("name"), F.col("brand"), HARD, SOFT, BRANDS, "all", ("his", "hers", "all")))
    typed = C.type_of(F.col("who.value"), F.col("name"), FIRST, TYPES, "other")["value"]
    p = p.withColumn("kind", F.when(F.col("old_kind").isin("case", "other", *CHILDREN), F.col("old_kind")).otherwise(typed))
    inferred = C.by_pattern(F.col("name"), SUBTYPES, "plain")["value"]
    p = p.withColumn("subtype", F.coalesce(C.under(F.col("kind"), F.col("old_sub"), CHILDREN), C.under(F.col("kind"), inferred, CHILDREN)))
    safe = C.safe_patch((F.col("old_kind"), F.col("old_sub")), (F.col("kind"), F.col("subtype")), F.col("name"), F.col("evidence"), ("jewel", "gadget", "case"), ("large", "anvil"))
    return p.select("id", F.col("who.value").alias("audience"), F.col("who.reason").alias("reason"), F.col("who.confidence").alias("confidence"), "kind", "subtype", safe.alias("safe"))


def _plain(x: str) -> str:
    """SQL of the text of a piece of HTML."""
    out = rf"regexp_replace(regexp_replace({x}, '(?is)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
    for name, sign in X._ENTITIES.items():
        out = f"replace({out}, '{name}', '{sign.replace(chr(39), chr(39) * 2)}')"
    return rf"trim(regexp_replace({out}, '[\s  　]+', ' ', 'g'))"


@query(
    rf"""WITH c AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    f AS (SELECT page_id, {_plain("regexp_extract(h, '(?i)<meta\\s+name=\"description\"\\s+content=\"([^\"]*)\"', 1)")} AS m, {_plain("regexp_extract(h, '\"description\"\\s*:\\s*\"([^\"]*)\"', 1)")} AS j,
      list_filter(list_transform(regexp_extract_all(h, '(?s)<p>(.*?)</p>', 1), lambda x: {_plain("x")}), lambda x: length(x) >= 24)[1] AS b, {_plain("regexp_extract(h, '(?s)<title>(.*?)</title>', 1)")} AS t FROM c)
    SELECT page_id, CASE WHEN length(m) >= 24 THEN m[:600] WHEN length(j) >= 24 THEN j[:600] WHEN b IS NOT NULL THEN b[:600] WHEN length(t) >= 24 THEN t[:600] END AS text,
      CASE WHEN length(m) >= 24 THEN 'meta' WHEN length(j) >= 24 THEN 'json_ld' WHEN b IS NOT NULL THEN 'block' WHEN length(t) >= 24 THEN 'title' END AS source,
      CASE WHEN length(m) >= 24 OR length(j) >= 24 OR b IS NOT NULL THEN 'apply' ELSE 'refetch' END AS decision FROM f"""
)
def dsc_candidates(spark, sf_dir):
    """The first usable description of a page with its source, and whether it is applied (0.8) or fetched again."""
    d = table(spark, sf_dir, "pages").select("page_id", C.description(F.col("html")).alias("d"))
    return d.select("page_id", "d.text", "d.source", F.when(F.col("d.confidence") >= 0.8, "apply").otherwise("refetch").alias("decision"))


@query(
    """WITH p AS (SELECT *, CASE WHEN p_size % 4 > 0 THEN p_retailprice END AS a, CASE WHEN p_size % 3 > 0 THEN p_retailprice * 9 END AS b FROM part)
    SELECT p_partkey AS id, coalesce(CASE WHEN a > 0 AND a < 5000 THEN a END, CASE WHEN b > 0 AND b < 5000 THEN b END, a, b) AS plausible, CASE WHEN p_size * 100.0::DOUBLE = floor(p_size * 100.0::DOUBLE) AND p_size * 100 >= 1000 THEN p_size::DOUBLE ELSE p_size * 100.0::DOUBLE END AS major,
      CAST(floor(p_size * 1.5::DOUBLE * 7.2::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS converted, CASE WHEN p_name LIKE '%gear%' THEN 399.0::DOUBLE WHEN p_name LIKE '%ring%' THEN 199.0::DOUBLE END AS rule_price,
      CASE WHEN p_size % 2 = 0 THEN 'second' ELSE 'first' END AS variant, length(p_name) - length(replace(p_name, ' ', '')) + 1 AS n_words, CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_type END AS kept FROM p"""
)
def num_price_rules(spark, sf_dir):
    """Plausible and major-unit prices, conversion, a price by text, the variant with a price, array lengths and kept arrays."""
    size, price = F.col("p_size"), F.col("p_retailprice")
    a, b = F.when(size % 4 > 0, price), F.when(size % 3 > 0, price * 9)
    variant = lambda title, cost: F.struct(F.lit(title).alias("title"), cost.alias("price"))
    variants = F.array(variant("first", F.when(size % 2 == 0, "ask us").otherwise(size.cast("string"))), variant("second", size.cast("string")))
    words = F.concat(F.lit('["'), F.replace("p_name", F.lit(" "), F.lit('","')), F.lit('"]'))
    new = F.when(size % 3 == 0, F.array("p_name")).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), X.plausible(a, b).alias("plausible"), X.minor_units(size * F.lit(100.0)).alias("major"), X.converted(size * F.lit(1.5)).cast("long").alias("converted"),
        C.rule_price(F.col("p_name"), [("gear", 399.0), ("ring", 199.0)]).alias("rule_price"), C.variant_price(variants)["title"].alias("variant"),
        F.json_array_length(words).cast("long").alias("n_words"), F.get(C.kept_if_empty(new, F.array("p_type")), F.lit(0)).alias("kept"),
    )


@query(
    r"""SELECT doc_id, length(trim(regexp_replace(coalesce(text, ''), '[\s  　]+', ' ', 'g'))) AS n_squeezed, regexp_replace(regexp_replace(regexp_replace(lower(coalesce(lang, '')), '[^\p{Han}a-z0-9]+', '', 'g'), '^(?:e|f)+', ''), '(?:n|r)+$', '') AS bare,
      CAST(nullif(regexp_extract(regexp_replace(coalesce(text, ''), '(\d),(\d{3})', '\1\2', 'g'), '(\d+(?:\.\d+)?)', 1), '') AS DOUBLE) AS first_price,
      CASE WHEN regexp_matches(lower(text), 'submersible|fully waterproof') THEN 7 WHEN regexp_matches(lower(text), 'splash|water.?resistant') THEN 4 END AS waterproof,
      regexp_matches(lower(concat_ws(' ', source, text)), '(?:src1\b)|(?:password)|(?:\bspam\b)') AS contaminant FROM documents"""
)
def txt_scalars(spark, sf_dir):
    """Squeezed text, a key without affixes, the first number, a protection level and a contaminant test."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.length(X.squeezed(t)).cast("long").alias("n_squeezed"), X.without_affixes(X.name_key(F.col("lang")), ("e", "f"), ("n", "r")).alias("bare"),
        X.first_price(t).alias("first_price"), X.waterproof_level(t).alias("waterproof"), contaminant(F.col("source"), t, patterns=(r"src1\b", "password", r"\bspam\b")).alias("contaminant"),
    )
