"""The manifest against a plain recursion, its SQL, and rows out of the ordinary."""

import glob
import os
import random
import zlib
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from talus.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(text):
    return sha256(text.encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def lower(text):
    return text if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def climb(nodes, fanout):
    """The root and, for each node, its sides level by level."""
    sides = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, held = [], []
        for a in range(0, len(nodes), fanout):
            run = nodes[a : a + fanout]
            for k in range(len(run)):
                for i in under[a + k]:
                    sides[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(h("".join(run)))
            held.append([i for u in under[a : a + fanout] for i in u])
        nodes, under = up, held
    return nodes[0], sides


def brute(rows, fanout=8):
    groups = {}
    for doc_id, text, lang, source, n in rows:
        leaf = h("".join(map(enc, (doc_id, source, lang, n, text))))
        bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        start = h("".join(map(enc, (doc_id, source, lang, n, lower(text))))) if bad else leaf
        groups.setdefault(lang, []).append((doc_id, leaf, start))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[g] = climb([r[1] for r in groups[g]], fanout)
    root, tops = climb([trees[g][0] for g in order], fanout)
    out = []
    for g, above in zip(order, tops):
        for (doc_id, leaf, node), below in zip(groups[g], trees[g][1]):
            for left, right in below + above:
                node = h(left + node + right)
            out.append((doc_id, leaf, trees[g][0], root, h("".join(a + b for a, b in below + above)), node, node == root))
    return out


def op(spark, df, folder):
    df.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    got = merkle.op11_merkle_manifest(spark, str(folder))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, got.collect()), key=repr)


def rows_of(n, langs, seed):
    r = random.Random(seed)
    words = ["Red", "grün", "中文", "x" * 300, "", "plain", "Été"]
    return [(i, r.choice([None, " ".join(r.choices(words, k=4))]), r.choice(langs), r.choice([None, "", "s"]), r.choice([None, i])) for i in range(n)]


CASES = {
    "many groups": rows_of(400, [None, "", *[f"l{i}" for i in range(80)]], 1),
    "one group of a power and one more": rows_of(65, ["en"], 2),
    "hot group": rows_of(600, ["en"] * 9 + ["de", None], 3),
    "one row": [(5, "A", None, None, None)],
    "repeats and null ids": [(1, "A", "en", "s", 1)] * 11 + [(None, None, "en", None, None)] * 3 + [(None, "b", None, None, None), (2, "", "", "", 0)],
}


@pytest.mark.parametrize("name", CASES)
def test_equals_recursion(spark, tmp_path, name):
    rows = CASES[name]
    df = spark.createDataFrame(rows, SCHEMA)
    for clash in ("g", "hash", "idx", "n", "part", "steps", "root"):
        df = df.withColumn(clash, F.lit(7))
    assert op(spark, df, tmp_path) == sorted(brute(rows), key=repr)


def test_no_rows(spark, tmp_path):
    assert op(spark, spark.createDataFrame([], SCHEMA), tmp_path) == []


@pytest.mark.parametrize("fanout", [2, 3])
def test_other_fanouts(spark, fanout):
    rows = rows_of(50, ["a", "b", "c"], 4)
    leaves = merkle.document_leaves(spark.createDataFrame(rows, SCHEMA))
    proofs = merkle.manifest(leaves, ["doc_id"], fanout)
    got = proofs.select("doc_id", F.sha2(merkle.siblings().cast("binary"), 256), merkle.folded(F.coalesce("changed", "hash"))).collect()
    assert sorted(map(tuple, got)) == sorted((r[0], r[4], r[5]) for r in brute(rows, fanout))


def test_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got = merkle.op11_merkle_manifest(spark, folder)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(merkle.ORACLE).select(*got.columns).fetchall())
