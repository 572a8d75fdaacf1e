"""Text, classification, matching and page queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talus.functions import columns as X
from talus.operators import matching as M
from talus.operators import rules as T
from talus.operators.postings import alike, containing, letters, sharing
from talus.plans.registry import query, table


@query(
    """SELECT doc_id, lower(trim(text)) LIKE '%the%' AND NOT regexp_matches(lower(text), 'no(t)? the') AS has_the,
    regexp_matches(lower(text), '(ing|tion)[a-z]* (of|to)') AS has_pair,
    regexp_matches(lower(text), 'license') AND NOT regexp_matches(lower(text), 'not licensed') AS licensed FROM documents"""
)
def txt_negation_signal(spark, sf_dir):
    """Positive patterns without negative ones over the haystack."""
    hay = T.haystack(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.signal(hay, "the", "not? the").alias("has_the"), T.signal(hay, "(ing|tion)[a-z]* (of|to)", "$^").alias("has_pair"), T.signal(hay, "license", "not licensed").alias("licensed")
    )


@query(
    r"""WITH p AS (SELECT conv_id, turn, unnest(string_split(regexp_replace(text, '([.!?;])\s+', '\1' || chr(10), 'g'), chr(10))) AS s FROM conversations WHERE role = 'user'),
    t AS (SELECT conv_id, turn, trim(s) AS s, lower(trim(s)) AS l FROM p WHERE trim(s) <> ''),
    h AS (SELECT conv_id, turn, s, CASE WHEN contains(l, 'not') THEN 'negative' WHEN regexp_matches(l, 'tion') THEN 'positive' END AS polarity, 'abstract' AS signal FROM t
      UNION ALL SELECT conv_id, turn, s, CASE WHEN regexp_matches(l, '^(is|was) ') THEN 'negative' WHEN regexp_matches(l, 'ing') THEN 'positive' END, 'ongoing' FROM t)
    SELECT conv_id, turn, signal, polarity, count(DISTINCT s) AS n FROM h WHERE polarity IS NOT NULL GROUP BY 1, 2, 3, 4"""
)
def txt_evidence(spark, sf_dir):
    """Evidence sentences by signal and polarity, each once."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("id", F.struct("conv_id", "turn"))
    got = T.evidence(c, "id", {"description": "text"}, [("abstract", "tion", "not"), ("ongoing", "ing", "^(is|was) ")])
    return got.groupBy("id.conv_id", "id.turn", "signal", "polarity").agg(F.count("*").alias("n"))


@query(
    r"""WITH c AS (SELECT conv_id, turn, lower(text) AS l, text FROM conversations)
    SELECT conv_id, turn, contains(l, 'ing') AND NOT contains(l, 'the ing') AS wants_ing, contains(l, 'est') AS best, contains(l, 'ing') AND NOT contains(l, 'est') AS ing_only,
    CAST(nullif(regexp_extract(text, '(\d{2,4})', 1), '') AS INTEGER) AS amount FROM c"""
)
def txt_intent_flags(spark, sf_dir):
    """Intent flags and a budget number from free text."""
    c = table(spark, sf_dir, "conversations").withColumn("l", F.lower("text"))
    amount = F.regexp_extract("text", r"(\d{2,4})", 1)
    return c.select(
        "conv_id", "turn", T.signal(F.col("l"), "ing", "the ing").alias("wants_ing"), F.contains("l", F.lit("est")).alias("best"), T.signal(F.col("l"), "ing", "est").alias("ing_only"),
        F.when(amount != "", amount.cast("int")).alias("amount"),
    )


RULES = [
    T.Rule("license", ("license", "copyright"), {"lead": 3, "rest": 1}),
    T.Rule("contact", ("@", r"\d{3}[-.]\d{3}"), {"lead": 2, "rest": 2}),
    T.Rule("secret", ("token", "api_key", "password"), {"lead": 2, "rest": 1}),
    T.Rule("table", (r" \| ",), {"lead": 4, "rest": 0}),
]


def _rule_sql(r: T.Rule) -> str:
    parts = [f"CASE WHEN regexp_matches({s}, '{p}') THEN {w} ELSE 0 END" for s, w in r.weights.items() for p in r.patterns]
    return " + ".join(parts)


@query(
    "WITH d AS (SELECT doc_id, source, lower(substr(split_part(trim(text), chr(10), 1), 1, 420)) AS lead, lower(text) AS rest FROM documents), s AS (SELECT doc_id, source, "
    + ", ".join(f"{_rule_sql(r)} AS {r.code}" for r in RULES)
    + """ FROM d), b AS (SELECT *, greatest(license, contact, secret, "table") AS best FROM s)
    SELECT doc_id, best, CASE WHEN best < 2 THEN 'prose' WHEN license = best THEN 'license' WHEN contact = best THEN 'contact' WHEN secret = best THEN 'secret' ELSE 'table' END AS kind,
    CASE WHEN source IN ('src1', 'src2') THEN source WHEN best < 2 THEN 'prose' WHEN license = best THEN 'license' WHEN contact = best THEN 'contact' WHEN secret = best THEN 'secret' ELSE 'table' END AS resolved FROM b"""
)
def txt_classify_argmax(spark, sf_dir):
    """Source-weighted pattern scores, argmax in declared order, minimum, stored value wins."""
    lead = F.lower(F.substring(F.split_part(F.trim("text"), F.lit("\n"), F.lit(1)), 1, 420))
    d = table(spark, sf_dir, "documents").select("doc_id", "source", lead.alias("lead"), F.lower("text").alias("rest"))
    src = {"lead": F.col("lead"), "rest": F.col("rest")}
    d = T.classified(d, src, RULES, 2, "prose")
    return d.select("doc_id", "best", "kind", T.stored_wins(F.col("source"), F.col("kind"), ("src1", "src2")).alias("resolved"))


@query(
    """SELECT CASE WHEN regexp_matches(lower(text), '^the ') THEN 'a' WHEN regexp_matches(text, '[0-9]{4}') THEN 'b' WHEN lang = 'en' THEN 'c' ELSE 'd' END AS value,
    CASE WHEN regexp_matches(lower(text), '^the ') THEN 'article' WHEN regexp_matches(text, '[0-9]{4}') THEN 'number' WHEN lang = 'en' THEN 'language' ELSE 'default' END AS reason, count(*) AS n FROM documents GROUP BY 1, 2"""
)
def txt_decision_list(spark, sf_dir):
    """Decision list with reasons; confidence gates what is applied."""
    t = F.coalesce("text", F.lit(""))
    cases = [(F.lower(t).rlike("^the "), "a", "article", 0.95), (t.rlike("[0-9]{4}"), "b", "number", 0.82), (F.col("lang") == "en", "c", "language", 0.62)]
    got = table(spark, sf_dir, "documents").select(T.decided(cases, "d").alias("x"))
    return got.groupBy("x.value", "x.reason").agg(F.count("*").alias("n"))


DICE = """list_distinct(list_filter(string_split({0}, ''), lambda c: c <> ''))"""


@query(
    rf"""WITH k AS (SELECT p_partkey AS id, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS key FROM part), g AS (SELECT DISTINCT key FROM k),
    p AS (SELECT a.key AS a, b.key AS b, {DICE.format('a.key')} AS x, {DICE.format('b.key')} AS y FROM g a JOIN g b ON a.key < b.key)
    SELECT a, b, round(2.0::DOUBLE * len(list_intersect(x, y)) / (len(x) + len(y)), 6) AS dice FROM p
    WHERE 2.0::DOUBLE * len(list_intersect(x, y)) / (len(x) + len(y)) >= 0.72 OR (least(length(a), length(b)) >= 6 AND (contains(a, b) OR contains(b, a)))"""
)
def txt_name_key_dice(spark, sf_dir):
    """All pairs of different name keys that may be merged, with their character Dice.

    Keys with the same letters share one set; sets that are alike enough come
    from the index of rare letters, a key inside another one from substrings.
    """
    g = table(spark, sf_dir, "part").select(X.name_key(F.col("p_name")).alias("key")).where("key <> ''").distinct()
    x, y = (g.select(F.col("key").alias(n), letters(F.col("key")).alias(f"set_{n}")) for n in ("a", "b"))
    near = x.join(alike(x, "set_a", y, "set_b", 0.72), "set_a").join(y, "set_b").where("a < b").select("a", "b")
    inside = containing(g.where(F.length("key") >= 6), "key", g.select(F.col("key").alias("long")), "long").where("key <> long")
    inside = inside.select(F.least("key", "long").alias("a"), F.greatest("key", "long").alias("b"))
    pairs = near.union(inside).distinct().where(X.mergeable(F.col("a"), F.col("b")))
    return pairs.select("a", "b", F.round(X.char_dice(F.col("a"), F.col("b")), 6).alias("dice"))


@query(
    r"""WITH i AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '([a-z][a-z0-9]{2,})', 1), lambda w: w NOT IN ('the', 'and')))  AS raw, lower(text) AS l FROM benchmark),
    u AS (SELECT item_id, w, min(pos) AS pos FROM (SELECT item_id, unnest(regexp_extract_all(l, '([a-z][a-z0-9]{2,})', 1)) AS w, unnest(range(1, 1 + len(regexp_extract_all(l, '([a-z][a-z0-9]{2,})', 1)))) AS pos FROM i) WHERE w NOT IN ('the', 'and') GROUP BY 1, 2),
    t AS (SELECT item_id, list(w ORDER BY pos)[1:24] AS tokens FROM u GROUP BY 1),
    d AS (SELECT doc_id, lower(text) AS l FROM documents), s AS (SELECT item_id, doc_id, len(list_filter(tokens, lambda w: contains(l, w))) / CAST(len(tokens) AS DOUBLE) AS score FROM t, d)
    SELECT item_id, max(round(score, 6)) AS best, count(*) FILTER (WHERE score >= 0.9) AS n_match, count(*) FILTER (WHERE score < 0.2) AS n_mismatch FROM s GROUP BY 1"""
)
def txt_token_recall(spark, sf_dir):
    """Token recall of every item against all documents, by status."""
    items = table(spark, sf_dir, "benchmark").select("item_id", X.distinctive_tokens(F.col("text"), ("the", "and")).alias("tokens"))
    got = M.token_recall(items, "item_id", "tokens", table(spark, sf_dir, "documents"), "doc_id", "text")
    return got.withColumn("best", F.round("best", 6))


@query(
    rf"""WITH a AS (SELECT DISTINCT p_name AS l, string_split(p_name, ' ') AS w FROM part), c AS (SELECT DISTINCT p_name AS r, string_split(p_name, ' ') AS v FROM part),
    s AS (SELECT l, r, list_distinct(w) AS w, list_distinct(v) AS v FROM a JOIN c ON len(list_intersect(w, v)) > 0 AND l <> r),
    t AS (SELECT l, r, greatest(len(list_intersect(w, v)) / CAST(greatest(len(w), len(v)) AS DOUBLE), 0.72::DOUBLE * len(list_intersect(w, v)) / least(len(w), len(v))) AS score FROM s)
    SELECT l AS name, r AS match, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY score DESC, r) AS rn FROM t) WHERE rn = 1 AND score >= 0.42"""
)
def match_title_best(spark, sf_dir):
    """Best other title at 0.42 or more; titles meet by any word they share."""
    n = table(spark, sf_dir, "part").select(F.col("p_name").alias("l")).distinct().withColumn("w", F.array_distinct(F.split("l", " ")))
    p = sharing(n, "w", n.select(F.col("l").alias("r"), F.col("w").alias("v")), "v").where("l <> r")
    both = F.size(F.array_intersect("w", "v"))
    x, y = F.size("w"), F.size("v")
    p = p.withColumn("score", F.greatest(both / F.greatest(x, y), 0.72 * both / F.least(x, y)))
    best = p.groupBy("l").agg(F.min(F.struct((-F.col("score")).alias("s"), "r")).alias("b")).where("b.s <= -0.42")
    return best.select(F.col("l").alias("name"), F.col("b.r").alias("match"), F.round(-F.col("b.s"), 6).alias("score"))


@query(
    """WITH s AS (SELECT l_partkey AS p, l_suppkey AS c, CAST(sum(l_quantity) AS BIGINT) AS score FROM lineitem GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY score DESC, c) AS rn, lead(score) OVER (PARTITION BY p ORDER BY score DESC, c) AS second FROM s WHERE score >= 25)
    SELECT p, c, score FROM r WHERE rn = 1 AND (second IS NULL OR score - second >= 4)"""
)
def match_ambiguity_reject(spark, sf_dir):
    """Best candidate unless the second one is too close."""
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("c")).agg(F.sum("l_quantity").cast("long").alias("score")).where("score >= 25")
    w = Window.partitionBy("p").orderBy(F.desc("score"), "c")
    r = s.withColumn("rn", F.row_number().over(w)).withColumn("second", F.lead("score").over(w))
    return r.where("rn = 1 AND (second IS NULL OR score - second >= 4)").select("p", "c", "score")


STRIP = r"""regexp_replace(regexp_replace({0}, '(?is)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g')"""


@query(
    r"""SELECT page_id, regexp_extract(html, '<html lang="(\w+)"', 1) AS lang, length(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)) AS h1_chars,
    len(regexp_extract_all(html, '<p>')) AS n_paragraphs, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS n_links, sha256(html) AS etag FROM pages"""
)
def html_extract(spark, sf_dir):
    """Fields, counts and hash of pages by pattern."""
    h = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract(h, r'<html lang="(\w+)"', 1).alias("lang"), F.length(F.regexp_extract(h, r"(?s)<h1>(.*?)</h1>", 1)).alias("h1_chars"),
        F.regexp_count(h, F.lit("<p>")).cast("long").alias("n_paragraphs"), F.size(F.regexp_extract_all(h, F.lit(r'<a href="([^"]*)"'), F.lit(1))).cast("long").alias("n_links"), F.sha2(h, 256).alias("etag"),
    )


@query(
    r"""SELECT doc_id, list_min(list_filter(list_transform(regexp_extract_all(text, '(\d+(?:\.\d+)?)', 1), lambda x: CAST(x AS DOUBLE)), lambda p: p > 0 AND p < 100000)) AS lowest,
    list_min(list_filter(list_transform(regexp_extract_all(text, '(\d{2,3})\.', 1), lambda x: floor(CAST(x AS DOUBLE) + 0.5)), lambda v: v BETWEEN 15 AND 90)) AS noise FROM documents"""
)
def num_min_of_captures(spark, sf_dir):
    """Least of all captured numbers within limits."""
    plain = F.regexp_extract_all(F.col("text"), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
    low = F.array_min(F.filter(F.transform(plain, lambda x: x.cast("double")), lambda p: (p > 0) & (p < 100_000)))
    noise = X.smallest_capture(F.col("text"), (r"(\d{2,3})\.",), 15, 90).cast("double")
    return table(spark, sf_dir, "documents").select("doc_id", low.alias("lowest"), noise.alias("noise"))


@query(
    r"""SELECT doc_id, length(array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(lower(l), 'license|copyright') AND trim(l) <> ''), chr(10))) AS kept_chars,
    len(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '')) AS n_lines, sha1(text) AS hash_key FROM documents"""
)
def txt_line_filter(spark, sf_dir):
    """Lines without boilerplate; hash key."""
    lines = F.split("text", "\n")
    good = F.filter(lines, lambda x: ~F.lower(x).rlike("license|copyright") & (F.trim(x) != ""))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(F.array_join(good, "\n")).cast("long").alias("kept_chars"), F.size(F.filter(lines, lambda x: F.trim(x) != "")).cast("long").alias("n_lines"), F.sha1("text").alias("hash_key"))
