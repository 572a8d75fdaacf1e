"""Operator 10: language identification by averaged hashed subword embeddings.

Byte n-grams of the lower-cased letters of a text are hashed into a fixed
table of embeddings; their mean goes through a linear softmax. Both layers
are trained by stochastic gradient descent in numpy on a bounded sample; a
temperature calibrates the probabilities, and a calibrated threshold marks
predictions to reject.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm.common import fold, map_batches, table

BUCKETS = 1 << 13
GRAMS = (1, 2, 3, 4)


@lru_cache(1)
def _not_letters() -> re.Pattern:
    """Runs of characters that are neither letters nor marks of letters (general categories L and M)."""
    kept = np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    edge = np.flatnonzero(np.diff(np.r_[False, kept, False]))
    return re.compile("[^" + "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edge.reshape(-1, 2)) + "]+")


def letters(text: str | None) -> str:
    """Lower-cased letters with their marks, each run of anything else one blank; "" if no letter."""
    clean = _not_letters().sub(" ", text or "").strip().lower()
    return clean if any(map(str.isalpha, clean)) else ""


def subwords(clean: str) -> np.ndarray:
    """Bucket counts of the byte n-grams of a cleaned text."""
    b = np.frombuffer(f" {clean} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    total = np.zeros(BUCKETS, np.int64)
    h = np.zeros(len(b), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        h = h[: len(b) - n + 1] * np.uint32(0x01000193) ^ b[n - 1 :]
        if not len(h):
            break
        if n in GRAMS:
            x = (h + np.uint32(n)) * np.uint32(0x9E3779B1)
            total += np.bincount((x >> np.uint32(19)).astype(np.int64), minlength=BUCKETS)
    return total


@dataclass
class LanguageModel:
    langs: list[str]
    embed: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.embed) @ self.weight + self.bias

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.logits(x) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, (at, n) in enumerate(rows):
        x[i, at] = n / n.sum()
    return x


def train(
    rows: list[tuple[np.ndarray, np.ndarray]],
    labels: np.ndarray,
    langs: list[str],
    dim: int = 16,
    epochs: int = 12,
    batch: int = 32,
    rate: float = 40.0,
    seed: int = 11,
    accuracy: float = 0.99,
) -> LanguageModel:
    """SGD over (buckets, counts) rows; a fifth of them calibrates."""
    rng = np.random.default_rng(seed)
    model = LanguageModel(
        langs,
        rng.uniform(-1, 1, (BUCKETS, dim)).astype(np.float32) * 0.5,
        rng.uniform(-1, 1, (dim, len(langs))).astype(np.float32) * 0.5,
        np.zeros(len(langs), np.float32),
    )
    order = rng.permutation(len(rows))
    cut = len(rows) // 5
    held, fit = order[:cut], order[cut:]
    steps, done = epochs * -(-len(fit) // batch), 0
    for _ in range(epochs):
        rng.shuffle(fit)
        for i in range(0, len(fit), batch):
            at = fit[i : i + batch]
            x = dense([rows[j] for j in at])
            h = x @ model.embed
            g = softmax(h @ model.weight + model.bias)
            g[np.arange(len(at)), labels[at]] -= 1
            g /= len(at)
            eta = rate * (1 - done / steps)
            model.embed -= eta * (x.T @ (g @ model.weight.T))
            model.weight -= eta / 40 * (h.T @ g)
            model.bias -= eta / 40 * g.sum(0)
            done += 1
    if len(held):
        z = np.vstack([model.logits(dense([rows[j] for j in held[i : i + 256]])) for i in range(0, len(held), 256)])
        y = labels[held]
        grid = np.geomspace(0.2, 10, 40)
        loss = [-np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = softmax(z / model.temperature)
        right = (p.argmax(1) == y)[order_ := np.argsort(-p.max(1))]
        good = np.flatnonzero(np.cumsum(right) / np.arange(1, len(y) + 1) >= accuracy)
        model.threshold = float(p.max(1)[order_][good[-1]]) if len(good) else 1.0
    return model


def sample_rows(rows: DataFrame, max_train_docs: int, snippets: int = 3) -> tuple[list, np.ndarray, list[str]]:
    """Subword counts of a bounded hash sample of (text, lang), whole texts and short snippets.

    At most ``max_train_docs`` different texts: those with the least hashes,
    each once per language given for it. Repeated rows do not count again.
    """
    rows = rows.withColumn("key", F.xxhash64("text", "lang"))
    n = max(1, rows.agg(F.approx_count_distinct("key")).first()[0])
    share = min(1.0, 1.5 * max_train_docs / n)
    rows = rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = rows.groupBy("key").agg(F.first("text").alias("text"), F.first("lang").alias("lang")).orderBy("key").limit(max_train_docs)

    def run(batches):
        for pdf in batches:
            at, count, lang = [], [], []
            for t, lg in zip(pdf["text"], pdf["lang"]):
                clean = letters(t)
                words = clean.split()
                if not words:
                    continue
                rng = np.random.default_rng(len(words))
                parts = [clean]
                for _ in range(snippets):
                    i = int(rng.integers(len(words)))
                    parts.append(" ".join(words[i : i + int(rng.integers(1, 9))]))
                for p in parts:
                    c = subwords(p)
                    k = np.flatnonzero(c)
                    at.append(k.astype(np.int16))
                    count.append(c[k].astype(np.float32))
                    lang.append(lg)
            yield pd.DataFrame({"lang": lang, "at": at, "n": count})

    got = rows.select("text", "lang").mapInPandas(run, "lang string, at array<smallint>, n array<float>").toPandas()
    langs = sorted(set(got["lang"]))
    code = {x: i for i, x in enumerate(langs)}
    pairs = [(np.asarray(a, np.int64), np.asarray(c, np.float32)) for a, c in zip(got["at"], got["n"])]
    return pairs, np.array([code[x] for x in got["lang"]], np.int64), langs


def fit(rows: DataFrame, max_train_docs: int = 2500) -> LanguageModel:
    """Train on a bounded sample of rows (text, lang not null); the driver's work does not grow with the input."""
    pairs, labels, langs = sample_rows(rows.where("lang is not null"), max_train_docs)
    if not pairs:
        return LanguageModel([], np.zeros((BUCKETS, 1), np.float32), np.zeros((1, 0), np.float32), np.zeros(0, np.float32))
    return train(pairs, labels, langs)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score, accepted for every whole text.

    ``und`` with score 0 if the text is null or has no letter, or if nothing
    was learned; ``accepted`` is false below the calibrated threshold. Texts
    of any length are read whole; null ids are kept; repeated rows are
    predicted as often as they occur; an empty table gives no rows; other
    columns are ignored.
    """

    def make():
        def of(batch):
            clean = [letters(t) for t in batch["text"].to_pylist()]
            pred, score = ["und"] * len(clean), np.zeros(len(clean))
            have = [i for i, c in enumerate(clean) if c] if model.langs else []
            for j in range(0, len(have), 256):
                at = have[j : j + 256]
                x = np.array([subwords(clean[i]) for i in at], np.float32)
                p = model.probabilities(x / x.sum(1, keepdims=True))
                score[at] = np.minimum(p.max(1), 1.0)
                for i, k in zip(at, p.argmax(1)):
                    pred[i] = model.langs[k]
            return {"doc_id": batch["doc_id"], "lang_pred": pred, "score": score, "accepted": (score >= model.threshold) & (score > 0)}

        return of

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows, make, "doc_id long, lang_pred string, score double, accepted boolean")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict every document's language; learn where the fold remainder (of 3) is not 1."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    model = fit(docs.where(~held).select("text", "lang"))
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")
