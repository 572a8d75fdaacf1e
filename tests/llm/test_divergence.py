"""The audit against a plain count, its SQL, and rows out of the ordinary."""

import glob
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from talus.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, min_docs, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, _ in rows:
        terms = [t.translate(lower) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        groups = [s for g, s in counts if g == lang]
        whole = sum((counts[lang, s] for s in groups), Counter())

        def p(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        q = p(whole)
        for s in groups:
            mine = p(counts[lang, s])
            pairs = []
            for o in groups:
                if o != s:
                    other = p(counts[lang, o])
                    pairs.append((o, sum(abs(mine[t] - other[t]) for t in kept)))
            ahead = [(t, mine[t] - q[t]) for t in kept if counts[lang, s][t] and mine[t] > q[t]]
            for part, found in (("pair", pairs), ("term", ahead)):
                found.sort(key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


def made(n, seed, langs=("en", "en", "en", "de", None, "")):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in ("Red", "grün", "中文", "é", "zz", "Z") for b in ("a", "B", "", "é", "q")]
    return [
        (i, r.choice([None, "", " ".join(r.choices(words, k=r.randint(1, 40))), "a1b_c-d'e\x00f\x7fg"]), r.choice(langs), r.choice([None, "", "s1", "s1", "s1", "s2", "s 3"]), i)
        for i in range(n)
    ]


@pytest.mark.parametrize("cells", [1, 12, 1 << 20])
def test_equals_count(spark, cells):
    rows = made(300, 5)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for clash in ("n", "term", "docs", "chunk", "part", "total", "rank"):
        df = df.withColumn(clash, F.lit("x"))
    got = D.divergence(df, min_docs=3, top=4, cells=cells)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 3, 4)


def test_no_kept_terms_ties_and_repeats(spark):
    rows = [(1, "a b", "en", "x", 1)] * 5 + [(2, None, "en", "y", 1), (3, "b a", "en", "z", 1), (4, "c", "fr", "x", 1), (5, None, "fr", "y", 1), (6, "c", None, None, None)]
    got = D.divergence(spark.createDataFrame(rows, SCHEMA), min_docs=3)
    assert sorted(map(tuple, got.collect())) == brute(rows, 3, 50)


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert D.op13_source_divergence(spark, str(tmp_path)).collect() == []


def test_very_long_text_is_handed_on_in_pieces(spark, monkeypatch):
    rows = [(i, " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(8000)), "en", f"s{i % 2}", 1) for i in range(3)]
    monkeypatch.setattr(D, "HELD", 1000)
    got = D.divergence(spark.createDataFrame(rows, SCHEMA), min_docs=3, top=3)
    assert sorted(map(tuple, got.collect())) == brute(rows, 3, 3)


def test_shares_are_exact():
    r = random.Random(1)
    for _ in range(2000):
        total = r.randint(6, 9 * 10**12)
        count = r.randint(0, total - 5)
        assert int(D.shares(np.array([count]), np.array([total]))[0]) == 1 + 10**9 * (count + 5) // total


def test_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got = D.op13_source_divergence(spark, folder)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(D.ORACLE).select(*got.columns).fetchall())
