import random

import numpy as np
from pyspark.sql import functions as F

from talus.llm.graph import components
from talus.llm.jaccard import COORDS, all_leaves, children, keep_one_per_class, links, runs_needed, sketch


def brute(rows, similarity=0.8):
    """rows: (doc_id, text) -> {doc_id: (class, links)} for distinct ids."""
    sets = {}
    for i, t in rows:
        w = [x.lower() for x in (t or "").split()]
        n = min(5, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    ids = sorted(sets)
    text = {i: t or "" for i, t in rows}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    partners = {i: set() for i in ids}
    for a in ids:
        for b in ids:
            if a < b:
                x, y = sets[a], sets[b]
                same = x == y
                if same or (x and y and len(x & y) / len(x | y) >= similarity):
                    ra, rb = find(a), find(b)
                    root[max(ra, rb)] = min(ra, rb)
                    if x and text[a] != text[b]:
                        partners[a].add(text[b])
                        partners[b].add(text[a])
    return {i: (find(i), len(partners[i])) for i in ids}


def corpus():
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(300)]
    rows, i = [], 0
    for _ in range(60):
        words = rng.choices(vocab, k=rng.randint(1, 150))
        for _ in range(rng.choice([1, 1, 2, 5])):
            w = list(words)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((i, " ".join(w)))
            i += 1
    hot = rng.choices(vocab, k=200)
    for _ in range(560):  # one group of near copies beyond a tile
        w = list(hot)
        w[rng.randrange(200)] = rng.choice(vocab)
        rows.append((i, " ".join(w)))
        i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \n"), (i + 3, rows[0][1]), (i + 4, rows[0][1].upper()), (i + 5, "w " * 3000)]
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sid", F.lit("clash"))
    got = {r.doc_id: (r.class_id, r.n_links) for r in links(df).collect()}
    assert got == brute(rows)


def test_stage_keeps_one(spark):
    rows = corpus()[:40]
    df = spark.createDataFrame(rows + rows[:3] + [(None, "x y z")], "doc_id long, text string").withColumn("lang", F.lit("en"))
    kept = keep_one_per_class(spark, df, "")
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    want = {c for c, _ in brute(rows).values()}
    assert sorted(x for x in ids if x is not None) == sorted(want)
    assert ids.count(None) == 1


def test_stage_decides_by_row(spark):
    rng = random.Random(9)
    a, b, c, d, e, f, g = (" ".join(rng.choices("abcdefghijklmnop", k=40)) for _ in range(7))
    big = 2**53 + 1
    rows = [(1, a), (5, a), (5, b), (7, c), (7, d), (None, e), (None, e), (None, a), (None, f), (None, None), (big, g), (big, g), (9, "")]
    schema = "doc_id long, text string, tid string, key_tid string"
    df = spark.createDataFrame([(*r, "t", "k") for r in rows], schema)
    kept = keep_one_per_class(spark, df, "")
    assert kept.columns == df.columns
    got = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    assert got == sorted([(1, a), (5, b), (7, c), (7, d), (0, e), (0, f), (big, g), (9, "")])


def test_links_of_null_ids(spark):
    rng = random.Random(10)
    base = rng.choices("abcdefghijklmnop", k=300)
    near = [" ".join(base[:i] + ["zz"] + base[i + 1 :]) for i in (50, 150, 250)]
    df = spark.createDataFrame([(None, near[0]), (None, near[1]), (None, near[2]), (None, "other words here")], "doc_id long, text string")
    assert sorted(r.n_links for r in links(df).collect()) == [0, 2, 2, 2]


def test_recall_at_every_depth():
    """Pairs at 0.8 that stay together down to a depth, with the runs that this depth takes."""
    rng = np.random.default_rng(3)
    for depth in range(2, 9):
        pairs, runs = (400 if depth < 5 else 150), runs_needed(0.99, depth)
        missed = 0
        for _ in range(pairs):
            sig = rng.integers(0, 2**32, (2, COORDS), dtype=np.uint32)
            same = rng.permutation(COORDS)[: round(0.8 * COORDS)]
            sig[1, same] = sig[0, same]
            missed += not any(together(sig, run, depth) for run in range(1, runs + 1))
        assert missed / pairs <= 0.03, depth
    assert runs_needed(0.999, 8) > runs_needed(0.999, 4) > runs_needed(0.999, 2)


def together(sig, run, depth):
    nodes = [np.array([run]), np.array([run])]
    for level in range(depth):
        nodes = [np.concatenate([children(np.array([n]), sig[[k]], 0.8, level)[1] for n in nodes[k]] or [np.zeros(0, np.int64)]) for k in (0, 1)]
        both = np.intersect1d(*nodes)
        if not len(both):
            return False
        nodes = [both, both]
    return True


def test_deep_trees_get_more_runs(spark):
    """A family in whose nodes the sub-families lie deep: every pair is still found."""
    rng = random.Random(8)
    rows = []
    for k in range(12):
        words = [f"{k}x{i}" for i in range(60)]
        for j in range(4):
            w = list(words)
            w[rng.randrange(60)] = f"n{j}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    told = sketch(df).select("sid", "n", F.lit(1).alias("texts"), "sig")
    nodes = all_leaves(told, 0.8, 0.99, small=2).collect()
    by = {}
    for r in nodes:
        by.setdefault(r.path, set()).add(r.sid)
    sid = {r.doc_id: r.sid for r in sketch(df).collect()}
    near = [(a, b) for a in range(48) for b in range(a) if a // 4 == b // 4]
    met = sum(any(sid[a] in s and sid[b] in s for s in by.values()) for a, b in near)
    assert met / len(near) > 0.95


def test_empty(spark):
    assert links(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components(spark):
    hub = [(500 + i, 499) for i in range(2000)]
    pairs = hub + [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (102, 100), (7, 7), (200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41))
    assert got[101] == got[102] == 100 and got[200] == 200
    assert all(got[499 + i] == 499 for i in range(2001))
