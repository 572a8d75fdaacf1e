"""The registered queries as a whole: columns, folds and what a plain count can say about every row."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from talus.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_training_order": ["slot", "shard", "record", "doc_id", "seq_no", "n_tokens", "crc"],
    "op2_substring_dedup": ["doc_id", "begin", "finish", "n_words", "source_ids"],
    "op4_decontaminate": ["doc_id", "item_id"],
    "op5_jaccard_join": ["doc_id", "class_id", "n_links"],
    "op8_best_fit_packing": ["doc_id"],
}


def fold(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, docs, name):
    got = QUERIES[name](spark, SF)
    assert set(COLUMNS[name]) <= set(got.columns)
    ids = {r.doc_id for r in got.select("doc_id").distinct().collect()}
    assert ids <= set(docs)
    if name in ("op1_training_order", "op5_jaccard_join", "op8_best_fit_packing"):
        assert ids == set(docs)  # no document is left out


def test_op3(spark, docs):
    terms = {i: [w.translate(LOWER) for w in re.findall(r"[^\x20\x09-\x0D]+", d.text or "")] + [None] for i, d in docs.items()}
    seen = Counter(t for i, ts in terms.items() if fold(i, 10) for t in ts)
    n, v = sum(seen.values()), len(seen)
    rows = {r.doc_id: r for r in QUERIES["op3_ctw_score"](spark, SF).collect()}
    assert set(rows) == set(docs)
    for i, ts in terms.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(i, 10) == 0, len(ts), sum(t in seen for t in ts), n)
        assert math.isclose(r.base_score, sum(math.log10((seen[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_op6(spark):
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r.embedding and any(r.embedding)}
    ids = np.array(sorted(vectors))
    all_ = np.stack([vectors[i] for i in ids])
    got = {}
    for r in QUERIES["op6_nearest_neighbours"](spark, SF).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21)) and all(i != q for _, i, _ in rows)
        assert [(-s, i) for _, i, s in rows] == sorted((-s, i) for _, i, s in rows)
        assert all(math.isclose(s, float(vectors[q] @ vectors[i]), rel_tol=1e-9, abs_tol=1e-12) for _, i, s in rows)
        order = np.lexsort((ids, -(all_ @ vectors[q])))
        best = [int(i) for i in ids[order] if i != q][:20]
        hits += len(set(best) & {i for _, i, _ in rows})
    assert hits / (20 * len(got)) >= 0.9


def test_op7_and_op10(spark, docs):
    rows = QUERIES["op7_quality_classifier"](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (fold(r.doc_id, 5) == 0)
    learned = {d.lang for i, d in docs.items() if d.lang is not None and fold(i, 3) != 1}
    rows = QUERIES["op10_language_id"](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(docs)
    for r in rows:
        letters = any(c.isalpha() for c in docs[r.doc_id].text or "")
        assert 0 <= r.score <= 1 and r.held_out == (fold(r.doc_id, 3) == 1) and (r.lang_pred in learned if letters else r.lang_pred == "und")
    sure = [r for r in rows if r.held_out and docs[r.doc_id].lang and len(docs[r.doc_id].text or "") > 200]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in sure]) > 0.95


def test_op9(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = QUERIES["op9_html_text"](spark, SF).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text)
        assert all(line == " ".join(line.split()) and line for line in r.text.split("\n")) or r.text == ""
        for tag in ("nav", "footer", "aside"):
            for part in re.findall(rf"(?s)<{tag}>([^<]{{40,}})</{tag}>", pages[r.page_id].html):
                assert part.strip()[:40] not in r.text
