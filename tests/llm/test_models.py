"""Quality classifier, language identification and language-model scores."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from talus.llm import ctw, langid, quality
from talus.llm.common import WordHasher, fold, words_of

DOCS = "doc_id long, text string, lang string, score double, x string"


def documents():
    rng = random.Random(7)
    syll = {"aa": ["ba", "lo", "ti", "ren"], "bb": ["sch", "ung", "keit", "ver"]}
    rows = []
    for i in range(240):
        lang = "aa" if i % 2 else "bb"
        words = ["".join(rng.choices(syll[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(5, 60))]
        text = " ".join(words) if i % 5 else " ".join(w.upper() + "!!" for w in words)
        rows.append((i, text, lang, 0.5, "clash"))
    return rows + [(900, None, None, None, None), (901, "", "aa", None, None), (902, " 12 ½² !", None, None, None), (903, "balo " * 9000, "aa", None, None), (None, "ti", None, None, None), rows[3]]


def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(0)
    s, y = rng.normal(size=60), rng.integers(0, 2, 60).astype(float)
    steps, values = quality.isotonic(s, y)
    assert (np.diff(values) >= 0).all() and (np.diff(steps) > 0).all()
    # a minimax formula: max over lower ends of min over upper ends of the mean
    order = np.argsort(s)
    y = y[order]
    want = [max(min(y[a : b + 1].mean() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    assert sorted({round(v, 9) for v in want}) == sorted({round(v, 9) for v in values})


def labelled(n=80):
    rng = np.random.default_rng(1)
    return [(rng.normal(size=quality.N_STATS).tolist(), int(rng.integers(0, 2)), int(rng.integers(-(2**62), 2**62))) for i in range(n)]


def test_normal_equations_sum_over_partitions(spark):
    rows = labelled()
    df = spark.createDataFrame(rows, "x array<double>, y int, h long")
    one = quality.fit(df.coalesce(1), n_fourier=16)
    many = quality.fit(df.repartition(4), n_fourier=16)
    assert np.allclose(one.weight, many.weight, atol=1e-8)
    # the same model by one least-squares solution over all rows at once
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    own = np.array([(r[2] >> 24) % 4 != 0 for r in rows])
    z = one.fourier(x[own])
    root = np.sqrt(np.append(np.full(16, 1e-2 * own.sum() / 16), 1e-9))
    want = np.linalg.lstsq(np.vstack([z, np.diag(root)]), np.append(y[own], np.zeros(17)), rcond=None)[0]
    assert np.allclose(one.weight, want, atol=1e-6)
    raw = one.fourier(x) @ want
    steps, values = quality.isotonic(raw[~own], y[~own])
    assert np.allclose(one.score(x), np.interp(raw, steps, values), atol=1e-4)


def test_quality_separates_and_scores_all(spark):
    docs = spark.createDataFrame([*documents(), (2**53 + 1, "balo", None, None, None)], DOCS)
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(240)] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(quality.training_rows(docs, labels, held_out=5), n_fourier=64)
    got = quality.scored(docs, model, 0.3).collect()
    assert len(got) == 247 and all(0 <= r.score <= 1 for r in got)
    own = {r.doc_id: r.predicted for r in got}
    assert np.mean([own[i] == int(i % 5 > 0) for i in range(240)]) > 0.95
    assert 2**53 + 1 in own and None in own


def test_training_rows_are_bounded(spark):
    rows = [(1, f"text {i % 3}") for i in range(600)] + [(2, f"other {i}") for i in range(900)] + [(i, "w") for i in range(3, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")
    assert quality.training_rows(docs, labels).count() == 3 + 900 + 57
    assert quality.training_rows(docs, labels, max_rows=200).count() < 400


def test_quality_edges(spark):
    docs = spark.createDataFrame(documents(), DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(quality.training_rows(docs, none))
    assert {r.score for r in quality.scored(docs, model, 0.3).collect()} == {0.5}
    assert quality.scored(docs.limit(0), model, 0.3).collect() == []
    assert quality.statistics(None, WordHasher()) == quality.statistics("", WordHasher())


def test_letters():
    assert langid.letters("½ ² ① 12 _!") == "" and langid.letters("\u0301 \u0940") == ""
    assert langid.letters("Ab½cd") == "ab cd" and langid.letters("हिन्दी, भाषा!") == "हिन्दी भाषा"


def test_subwords_and_averages_against_plain_counting():
    for clean in ("a", "ba lo", "été"):
        raw, want = f" {clean} ".encode(), {}
        for n in langid.GRAMS:
            for i in range(len(raw) - n + 1):
                h = 0
                for c in raw[i : i + n]:
                    h = (h * 0x01000193 & 0xFFFFFFFF) ^ c
                k = ((h + n) * 0x9E3779B1 & 0xFFFFFFFF) >> 19
                want[k] = want.get(k, 0) + 1
        got = langid.subwords(clean)
        assert {int(k): int(got[k]) for k in np.flatnonzero(got)} == want


def test_language_sample_is_bounded(spark):
    rows = [("same text here", "aa")] * 3000 + [(f"text number {i}", "bb") for i in range(500)]
    df = spark.createDataFrame(rows, "text string, lang string")
    pairs, labels, langs = langid.sample_rows(df, 100)
    assert 40 * 4 <= len(pairs) <= 100 * 4 and langs in (["bb"], ["aa", "bb"])
    assert (labels == langs.index("aa")).sum() <= 4 if "aa" in langs else True


def test_languages_held_out(spark):
    docs = spark.createDataFrame(documents(), DOCS)
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    model = langid.fit(docs.where(~held).select("text", "lang"))
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert got[900].lang_pred == got[901].lang_pred == got[902].lang_pred == "und"
    assert got[903].lang_pred == "aa" and got[None].lang_pred == "aa"
    out = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert out and np.mean([got[i].lang_pred == ("aa" if i % 2 else "bb") for i in out]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_languages_without_training(spark):
    docs = spark.createDataFrame(documents(), DOCS)
    model = langid.fit(docs.limit(0).select("text", "lang"))
    assert {r.lang_pred for r in langid.predict(docs, model).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).collect() == []


# A plain context-tree weighting over dictionaries, one node at a time.


def slow_model(streams, depth):
    counts = {}
    for s in streams:
        for i in range(len(s)):
            for d in range(depth + 1):
                ctx = tuple(s[i - k] if i - k >= 0 else ctw.END for k in range(1, d + 1))
                for b in range(8):
                    node = (1 << b) | (int(s[i]) >> (8 - b))
                    counts.setdefault((ctx, node), [0, 0])[int(s[i]) >> (7 - b) & 1] += 1
    return counts


def slow_kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


def slow_weights(counts, depth):
    w, kids = {}, {}
    for ctx, node in counts:
        if ctx:
            kids.setdefault((ctx[:-1], node), []).append((ctx, node))
    for key in sorted(counts, key=lambda k: -len(k[0])):
        own = slow_kt(*counts[key])
        w[key] = own if len(key[0]) == depth else np.logaddexp(own, sum(w[k] for k in kids[key])) - math.log(2)
    return w


def slow_score(s, counts, w, depth):
    total = 0.0
    for i in range(len(s)):
        for b in range(8):
            node, bit = (1 << b) | (int(s[i]) >> (8 - b)), int(s[i]) >> (7 - b) & 1
            p, left, last = 0.0, 1.0, 0.5
            for d in range(depth + 1):
                key = (tuple(int(s[i - k]) if i - k >= 0 else ctw.END for k in range(1, d + 1)), node)
                if key not in counts:
                    break
                n = counts[key]
                last = (n[1] + 0.5) / (sum(n) + 1)
                stop = math.exp(min(0.0, slow_kt(*n) - (0 if d == depth else math.log(2)) - w[key]))
                p, left = p + left * stop * last, left * (1 - stop)
            p += left * last
            total += math.log10(p if bit else 1 - p)
    return total


@pytest.mark.parametrize("block", [60, 1 << 20])
def test_scores_equal_a_plain_model(spark, block):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["ab", "Abc", "ca", "é"], k=rng.randint(1, 6))), "s") for i in range(12)]
    rows += [(50, None, "s"), (51, "", "s"), (52, "zz\x0bq", "s"), rows[0], (2**53 + 1, "ab", "s"), (None, "ca ab", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    held = {i for i, _, _ in rows if i is not None and i % 3 == 0}
    got = ctw.score(df, F.col("doc_id") % 3 != 0, depth=3, block_bytes=block).collect()
    assert len(got) == len(rows)
    streams = {i: ctw.stream(words_of(t)).astype(int) for i, t, _ in rows}
    train = [(i, t) for i, t, _ in rows if i not in held]
    counts = slow_model([streams[i] for i, _ in train], 3)
    w = slow_weights(counts, 3)
    words = [x for _, t in train for x in [*words_of(t), b"\n"]]
    n, v = len(words), len(set(words))
    text = {i: t for i, t, _ in rows}
    for r in got:
        toks = [*words_of(text[r.doc_id]), b"\n"]
        assert r.held_out == (r.doc_id in held) and r.n_tokens == len(toks) and r.train_tokens == n
        assert r.n_known == sum(x in words for x in toks)
        assert abs(r.base_score - sum(math.log10((words.count(x) + 0.1) / (n + 0.1 * (v + 1))) for x in toks)) < 1e-9
        assert abs(r.score - slow_score(streams[r.doc_id], counts, w, 3)) < 1e-4


def test_probabilities_sum_to_one():
    data = ctw.stream([b"abab", b"abc"])
    seen = ctw.keys_of(data, 2)
    ctx = seen[3] >> np.uint64(8)
    keys = np.unique(np.concatenate([seen, (ctx << np.uint64(8)) | np.arange(256, dtype=np.uint64)]))
    n = np.array([(seen == k).sum() for k in keys], float)
    levels = ctw.levels_of(keys, n, 2, 2)
    log_w = ctw.weigh(levels)
    one = ctw.up(levels[0].node).astype(np.int64)
    sums = [np.bincount(one, x, 65536).reshape(256, 256) for x in (levels[0].n0, levels[0].n1, log_w[0])]
    lp = ctw.log_probs(keys, n, 2, levels, log_w, ctw.top_mixture(*sums))
    assert abs((10 ** lp[keys >> np.uint64(8) == ctx]).sum() - 1) < 1e-9


def test_scores_of_an_empty_table(spark):
    assert ctw.score(spark.createDataFrame([], "doc_id long, text string"), F.lit(True)).collect() == []
