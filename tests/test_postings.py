"""Candidates from postings against all pairs, on titles without common words, and on hot keys."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from talus.operators import matching as M
from talus.operators import postings as P
from talus.plans.registry import ORACLES, QUERIES


def names(n, seed):
    """Titles of random syllables, some run together, some with Han runs, some inside others."""
    r = random.Random(seed)
    syllable = lambda: r.choice("bdfgklmnprstvz") + r.choice("aeiou")
    word = lambda: "".join(syllable() for _ in range(r.randint(1, 4)))
    han = lambda: "".join(chr(0x4E00 + int(r.paretovariate(0.7)) % 400) for _ in range(r.randint(1, 5)))
    out = {"redgear", "red gear set", "x", "aa bb", "bb aa"}
    while len(out) < n:
        parts = [r.choice([word, word, han])() for _ in range(r.randint(1, 4))]
        title = r.choice(["", " "]).join(parts)
        out.add(title if r.random() < 0.8 else r.choice(sorted(out)[:50]) + title)
    return sorted(out)


def folder(spark, at, n):
    """A ``part`` table of varied names."""
    r = random.Random(9)
    rows = [(k, n, f"Brand#{r.randint(1, 5)}", r.choice(["LARGE", "PROMO", "SMALL"]), r.randint(1, 50), 1.0) for k, n in enumerate(names(n, 1))]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{at}/part.parquet")
    return str(at)


@pytest.mark.parametrize("name, n", [("match_composite", 800), ("match_alias_or_clear", 2000), ("txt_name_key_dice", 500)])
def test_equals_all_pairs(spark, tmp_path, name, n):
    at = folder(spark, tmp_path, n)
    con = duckdb.connect()
    con.sql(f"create view part as select * from '{at}/part.parquet/*.parquet'")
    got = QUERIES[name](spark, at)
    sql = ORACLES[name].replace("[^a-z0-9]+", "[^a-z0-9一-龥]+")  # the given tables have no Han names, these do
    rel = con.sql(sql).select(*got.columns)
    plain = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    want = sorted(map(plain, rel.fetchall()))
    assert want and sorted(plain(r) for r in got.collect()) == want


def test_title_pairs_reach_every_score(spark):
    """All pairs scored by the same formula; none at the limit or above is missed."""
    aliases = {"ba": ("de",)}
    part = spark.createDataFrame([(n,) for n in names(500, 2)], "target string")
    left = part.withColumn("tt", M.title_tokens(F.col("target"), aliases))
    right = part.where(F.length("target") % 3 != 0).select(F.col("target").alias("title")).withColumn("ct", M.title_tokens(F.col("title"), aliases))
    has = lambda a, b: F.contains(F.col("target"), F.lit(a)) & F.contains(F.col("title"), F.lit(b))
    alias = F.when(has("ku", "ku") | has("zi", "bo"), 0.86).otherwise(0.0)
    score = M.title_score(F.col("target"), F.col("title"), F.col("tt"), F.col("ct"), alias)
    every = left.crossJoin(right).withColumn("score", score).where("score >= 0.42").select("target", "title")
    pairs = M.title_pairs(left, "tt", right, "ct", 0.42, (("ku", "zi"), ("ku", "bo")))
    found = pairs.withColumn("score", score).where("score >= 0.42").select("target", "title").distinct()
    want = set(map(tuple, every.collect()))
    assert len(want) > 500 and set(map(tuple, found.collect())) == want


def test_containing(spark, monkeypatch):
    r = random.Random(3)
    texts = ["".join(r.choices("ab", k=r.randint(0, 30))) for _ in range(150)] + ["中文abab", ""]
    df = spark.createDataFrame([(t,) for t in texts], "hay string").distinct()
    needles = df.select(F.col("hay").alias("needle"))
    for block in (20_000, 5):
        monkeypatch.setattr(P, "BLOCK", block)
        monkeypatch.setattr(P.salted_join, "__defaults__", (block,))
        for ratio in (0.0, 0.5):
            got = P.containing(needles, "needle", df, "hay", ratio).select("needle", "hay").collect()
            want = [(n, h) for n in set(texts) for h in set(texts) if n and n in h and len(n) >= ratio * len(h)]
            assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("least", [0.3, 0.72, 1.0])
def test_alike(spark, least):
    r = random.Random(4)
    texts = sorted({"".join(r.choices("abcdefgh 中文字", k=r.randint(0, 9))) for _ in range(200)})
    a = spark.createDataFrame([(t,) for t in texts], "t string").select(P.letters(F.col("t")).alias("x"))
    got = P.alike(a, "x", a.withColumnRenamed("x", "y"), "y", least).collect()
    sets = {tuple(sorted(set(t) - {" "})) for t in texts}
    want = [(x, y) for x in sets for y in sets if x and y and 2 * len(set(x) & set(y)) >= (least - 1e-9) * (len(x) + len(y))]
    assert sorted((tuple(g.x), tuple(g.y)) for g in got) == sorted(want)


def test_hot_keys_are_dealt(spark):
    left = spark.range(50).select(F.lit("hot").alias("k"), F.col("id").alias("a")).union(spark.sql("select 'cold', 99L"))
    right = spark.range(3000).select(F.when(F.col("id") % 10 == 0, "cold").otherwise("hot").alias("k"), F.col("id").alias("b"))
    met = P.salted_join(left, right, "k", 100)
    assert met.count() == 50 * 2700 + 300 and met.distinct().count() == met.count()
