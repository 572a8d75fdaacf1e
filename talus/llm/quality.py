"""Operator 7: a document quality classifier on random Fourier features.

Document statistics -> standardised -> random Fourier features of a Gaussian
kernel -> ridge regression by normal equations that partitions sum up ->
isotonic calibration. Only the statistics of a row enter its score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm.common import WordHasher, fold, map_batches, shingles, table, words_of, write_table

N_STATS = 20
#: Labelled rows that a fit takes at most.
MAX_TRAIN_ROWS = 100_000


def _classes() -> np.ndarray:
    kind = np.full(256, 4)  # 4: other ASCII signs
    kind[[9, 10, 11, 12, 13, 32]] = 0
    kind[48:58] = 1
    kind[65:91] = 2
    kind[97:123] = kind[128:] = 3
    kind[[ord(c) for c in ".,;:'-"]] = 5
    return kind


_KIND = _classes()


def statistics(text: str | None, hasher: WordHasher) -> list[float]:
    """Twenty statistics of a whole text; an empty or null text has zeros."""
    raw = (text or "").encode("utf-8", "replace")
    words = words_of(text)
    if not words:
        return [0.0] * N_STATS
    n = len(words)
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=6) / len(raw)
    sizes = np.fromiter(map(len, words), np.int64, n)
    h = hasher(words)
    ids, counts = np.unique(h, return_counts=True)
    tri = shingles(h, 3)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup_lines = 1 - len(set(lines)) / len(lines)
    plain = sum(map(bytes.isalpha, words)) / n
    return [
        np.log1p(len(raw)),
        np.log1p(n),
        sizes.mean(),
        sizes.std(),
        np.log1p(sizes.max()),
        (sizes <= 3).mean(),
        *kinds.tolist(),
        kinds[2] / (kinds[2] + kinds[3] + 1e-9),
        len(ids) / n,
        counts.max() / n,
        (h[1:] == h[:-1]).mean() if n > 1 else 0.0,
        1 - len(np.unique(tri)) / len(tri),
        dup_lines,
        np.log1p(len(lines)) - np.log1p(n),
        plain,
    ]


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    freq: np.ndarray
    phase: np.ndarray
    weight: np.ndarray
    steps: np.ndarray  # raw scores at which the calibrated value is known
    values: np.ndarray

    def fourier(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        z = np.sqrt(2 / len(self.phase)) * np.cos(z @ self.freq + self.phase)
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.steps, self.values)


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the best non-decreasing fit of labels to scores."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, sum of scores
    for s, y in zip(score[order], label[order]):
        blocks.append([y, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    b = np.array(blocks)
    return b[:, 2] / b[:, 1], b[:, 0] / b[:, 1]


def _summed(rows: DataFrame, part) -> np.ndarray:
    """Sum an array over the partitions of (x, y) rows; ``part`` maps a batch to its share."""

    def run(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                share = part(np.vstack(pdf["x"]), pdf["y"].to_numpy(float))
                total = share if total is None else total + share
        if total is not None:
            yield pd.DataFrame({"s": [np.ascontiguousarray(total).tobytes()]})

    got = [np.frombuffer(r.s) for r in rows.mapInPandas(run, "s binary").collect()]
    return np.sum(got, axis=0) if got else np.zeros(0)


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, held_out: int | None = None) -> DataFrame:
    """(x, y, h) of labelled documents, at most about ``max_rows``: a table that was written once.

    Labels are sampled first, by a hash of their id, and so are small enough
    to be broadcast; statistics are computed for the documents of the sample
    only. Equal rows (id and text) count once, so that repeated rows neither
    outgrow the bound nor weigh more. If one id has very many texts, a second
    sample by a hash of id and text keeps the bound. Null ids and labels are
    skipped; several labels of a document are averaged; documents with fold
    remainder (of ``held_out``) 0 stay out.
    """
    labels = labels.where("doc_id is not null and quality is not null")
    if held_out is not None:
        labels = labels.where(fold(F.col("doc_id"), held_out) != 0)
    labels = labels.groupBy(F.col("doc_id").alias("id")).agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    n = labels.count()
    share = F.pmod(F.xxhash64("id", F.lit("label")), F.lit(1 << 20)) < int((1 << 20) * min(1.0, max_rows / max(n, 1)))
    labels = F.broadcast(labels.where(share))  # about max_rows rows of 12 bytes
    rows = docs.select("doc_id", "text").join(labels, F.col("doc_id") == F.col("id")).select("y", "text", F.xxhash64("doc_id", "text").alias("h"))

    def make():
        hasher = WordHasher()
        return lambda batch: {"h": batch["h"], "y": batch["y"], "x": [statistics(t, hasher) for t in batch["text"].to_pylist()]}

    rows = write_table(map_batches(rows, make, "h long, y int, x array<double>"), "labelled")
    once = rows.groupBy("h").agg(F.first("y").alias("y"), F.first("x").alias("x"))
    n = rows.agg(F.approx_count_distinct("h")).first()[0]
    if n > 1.2 * max_rows:
        once = once.where(F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < int((1 << 20) * max_rows / n))
    return write_table(once, "training-rows")


def fit(
    rows: DataFrame,
    n_fourier: int = 256,
    ridge: float = 1e-2,
    width: float = 1.0,
    seed: int = 7,
) -> QualityModel:
    """Fit on rows (x, y in 0/1, h) of bounded number, see :func:`training_rows`.

    A quarter of the rows, by h, calibrates, the rest fits. Without rows the
    score is 0.5; with rows of one class only it is that class.
    """
    rows = rows.select("x", F.col("y").cast("double").alias("y"), (F.pmod(F.shiftright("h", 24), F.lit(4)) == 0).alias("calibrate"))
    train = rows.where(~F.col("calibrate"))
    sums = _summed(train, lambda x, y: np.concatenate([[len(y), y.sum()], x.sum(0), (x * x).sum(0)]))
    rng = np.random.default_rng(seed)
    model = QualityModel(
        np.zeros(N_STATS),
        np.ones(N_STATS),
        rng.normal(0, 1, (N_STATS, n_fourier)) * width / np.sqrt(N_STATS),
        rng.uniform(0, 2 * np.pi, n_fourier),
        np.zeros(n_fourier + 1),
        np.array([0.0]),
        np.array([0.5]),
    )
    if not len(sums):
        return model
    m = sums[0]
    model.mean = sums[2 : 2 + N_STATS] / m
    model.scale = np.sqrt(np.maximum(sums[2 + N_STATS :] / m - model.mean**2, 0))
    model.scale[model.scale < 1e-6] = 1.0

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.fourier(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    got = _summed(train, normal)
    k = n_fourier + 1
    penalty = np.full(k, ridge * m / n_fourier)
    penalty[-1] = 1e-9
    model.weight = np.linalg.solve(got[: k * k].reshape(k, k) + np.diag(penalty), got[k * k :])
    held = rows.where("calibrate").select("x", "y").toPandas()  # about a quarter of a bounded table
    if len(held):
        model.steps, model.values = isotonic(model.raw(np.vstack(held["x"])), held["y"].to_numpy(float))
    else:
        model.steps, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def scored(docs: DataFrame, model: QualityModel, threshold: float) -> DataFrame:
    """doc_id, score and predicted of every whole text, in one pass."""

    def make():
        hasher = WordHasher()

        def of(batch):
            x = np.array([statistics(t, hasher) for t in batch["text"].to_pylist()]).reshape(-1, N_STATS)
            score = model.score(x)
            return {"doc_id": batch["doc_id"], "score": score, "predicted": (score >= threshold).astype("int32")}

        return of

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows, make, "doc_id long, score double, predicted int")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document; learn from labels whose fold remainder (of 5) is not 0.

    Null and empty texts get the statistics of an empty text and a score like
    any other; texts of any length are read whole; null ids are kept;
    repeated rows are scored as often as they occur; an empty table gives no
    rows; other columns are ignored.
    """
    docs = table(spark, sf_dir, "documents")
    model = fit(training_rows(docs, table(spark, sf_dir, "labels"), held_out=5))
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored(docs, model, 0.3).select("doc_id", held.alias("held_out"), "score", "predicted")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    """Pipeline stage: documents whose score reaches the threshold, all columns kept.

    Statistics, score and filter are computed in one pass over each document
    row, so that no text is shuffled; labels only train the model. Null ids
    and repeated rows are judged by their text like all others.
    """
    model = fit(training_rows(docs, table(spark, sf_dir, "labels")))
    hashers: list[WordHasher] = []

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        if not hashers:
            hashers.append(WordHasher())
        x = np.array([statistics(t, hashers[0]) for t in texts]).reshape(-1, N_STATS)
        return pd.Series(model.score(x) >= threshold)

    return docs.where(good(F.col("text")))
