"""Operator 3: language-model scoring by context-tree weighting over bytes.

A text is its tokens (A-Z lower-cased, white space one blank) and an end byte.
Each byte is eight binary decisions; each binary decision has a context tree
over the preceding bytes, up to ``DEPTH`` of them. Krichevsky-Trofimov
estimates of all depths are mixed by the weights of context-tree weighting,
from counts over all training texts.

Work is dealt by blocks of documents and by buckets of contexts. A block sends
each bucket its distinct (context, byte) keys with their training counts; the
bucket sums them, weighs the context trees below its two-byte contexts and
returns a log probability per key to every block that asked. What is above
(at most 256 one-byte contexts times 255 binary nodes, whatever the corpus) is
summed by Spark and weighed once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm.common import WordHasher, fold, mix64, table, words_of, write_table

DEPTH = 5
END = 10
_U8 = np.uint64(8)


def lgamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after shifting the argument up by eight."""
    x = np.asarray(x, np.float64)
    shift = np.ones_like(x)
    for i in range(8):
        shift *= x + i
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(shift)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability of n0 zeros and n1 ones."""
    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - lgamma(n0 + n1 + 1.0) - 1.1447298858494002


def stream(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b" ".join(words) + bytes([END]), np.uint8)


def keys_of(data: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """A key per byte: its context, nearest byte highest, then the byte itself."""
    padded = np.concatenate([np.full(depth, END, np.uint8), data]).astype(np.uint64)
    n = len(data)
    key = np.zeros(n, np.uint64)
    for d in range(1, depth + 1):
        key = key << _U8 | padded[depth - d : depth - d + n]
    return key << _U8 | padded[depth:]


class Level:
    """The binary nodes (context of one depth, bits of the byte so far) and their counts."""

    def __init__(self, ctx: np.ndarray, sym: np.ndarray, n: np.ndarray):
        bits = np.arange(8, dtype=np.uint64)
        s = sym[:, None]
        node = (ctx[:, None] << _U8) | (np.uint64(1) << bits) | (s >> (_U8 - bits))
        one = (s >> (np.uint64(7) - bits)) & np.uint64(1)
        self.node, self.at = np.unique(node.ravel(), return_inverse=True)
        self.at = self.at.reshape(-1)
        self.n1 = np.bincount(self.at, (one * n[:, None].astype(np.uint64)).ravel().astype(np.float64), len(self.node))
        self.n0 = np.bincount(self.at, np.repeat(n, 8), len(self.node)) - self.n1

    def estimate(self) -> np.ndarray:
        return (self.n1 + 0.5) / (self.n0 + self.n1 + 1.0)


def up(node: np.ndarray) -> np.ndarray:
    """Node keys with the context one byte shorter."""
    return (node >> np.uint64(16) << _U8) | (node & np.uint64(255))


def levels_of(keys: np.ndarray, n: np.ndarray, depth: int, top: int) -> list[Level]:
    """Levels ``top`` .. ``depth`` of the trees below."""
    out = []
    for d in range(top, depth + 1):
        part = (keys >> np.uint64(8 * (depth - d + 1)) << _U8) | (keys & np.uint64(255))
        short, at = np.unique(part, return_inverse=True)
        out.append(Level(short >> _U8, short & np.uint64(255), np.bincount(at.reshape(-1), n, len(short))))
    return out


def weigh(levels: list[Level]) -> list[np.ndarray]:
    """Log weighted probability of each node, level by level, from the deepest."""
    log_w: list[np.ndarray] = [log_kt(levels[-1].n0, levels[-1].n1)]
    for d in range(len(levels) - 2, -1, -1):
        at = np.searchsorted(levels[d].node, up(levels[d + 1].node))
        below = np.bincount(at, log_w[0], len(levels[d].node))
        log_w.insert(0, np.logaddexp(log_kt(levels[d].n0, levels[d].n1), below) - np.log(2))
    return log_w


class Mixture:
    """Per node: probability mixed so far, weight left, estimate of the deepest seen context."""

    def __init__(self, size: int):
        self.prob, self.left, self.last = np.zeros(size), np.ones(size), np.full(size, 0.5)

    def take(self, at: np.ndarray) -> "Mixture":
        m = Mixture(0)
        m.prob, m.left, m.last = self.prob[at], self.left[at], self.last[at]
        return m

    def add(self, n0: np.ndarray, n1: np.ndarray, log_w: np.ndarray, leaf: bool) -> None:
        seen = n0 + n1 > 0
        est = (n1 + 0.5) / (n0 + n1 + 1.0)
        stop = np.exp(np.minimum(0.0, log_kt(n0, n1) - (0 if leaf else np.log(2)) - log_w)) * seen
        self.prob += self.left * stop * est
        self.left *= 1 - stop
        self.last = np.where(seen, est, self.last)

    def final(self) -> np.ndarray:
        return self.prob + self.left * self.last


def top_mixture(n0: np.ndarray, n1: np.ndarray, below: np.ndarray) -> Mixture:
    """Mixture after depths 0 and 1 from the counts of one-byte contexts.

    Arrays over (context byte, node); ``below`` sums the log weighted
    probabilities of the two-byte contexts.
    """
    log1 = np.logaddexp(log_kt(n0, n1), below) - np.log(2)
    r0, r1 = n0.sum(0), n1.sum(0)
    log0 = np.logaddexp(log_kt(r0, r1), log1.sum(0)) - np.log(2)
    root = Mixture(256)
    root.add(r0, r1, log0, False)
    m = root.take(np.tile(np.arange(256), 256))
    m.add(n0.ravel(), n1.ravel(), log1.ravel(), False)
    return m


def log_probs(keys: np.ndarray, n: np.ndarray, depth: int, levels: list[Level], log_w: list[np.ndarray], top: Mixture) -> np.ndarray:
    """log10 probability of each key's byte in its context."""
    one = levels[0].node & np.uint64(0xFF) | (levels[0].node >> np.uint64(16) << _U8) & np.uint64(0xFF00)
    m = top.take(one.astype(np.int64))  # the nearest byte is a two-byte context's higher one
    m.add(levels[0].n0, levels[0].n1, log_w[0], len(levels) == 1)
    for d in range(1, len(levels)):
        m = m.take(np.searchsorted(levels[d - 1].node, up(levels[d].node)))
        m.add(levels[d].n0, levels[d].n1, log_w[d], d == len(levels) - 1)
    p1 = m.final()[levels[-1].at].reshape(len(keys), 8)
    one = (keys[:, None] >> (np.uint64(7) - np.arange(8, dtype=np.uint64))) & np.uint64(1)
    return np.log10(np.where(one > 0, p1, 1 - p1)).sum(1)


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys as differences: they compress well in files and shuffles."""
    return np.diff(keys, prepend=np.uint64(0)).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, np.uint64), dtype=np.uint64)


def _bucket(keys: np.ndarray, words: bool, depth: int, buckets: int) -> np.ndarray:
    """Buckets of word hashes, or of keys by their two nearest bytes."""
    part = keys if words else mix64(keys >> np.uint64(8 * (depth - 1)))
    return (part % np.uint64(buckets)).astype(np.int64)


class Block:
    """Words and bytes of the documents of a block, with their distinct keys."""

    def __init__(self, texts, depth: int):
        hasher = WordHasher()
        self.parts: list[list[np.ndarray]] = [[], []]
        for t in texts:
            w = words_of(t)
            self.parts[0].append(hasher([*w, bytes([END])]))
            self.parts[1].append(keys_of(stream(w), depth))

    def distinct(self, kind: int, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct keys (0: words, 1: bytes in context) and how often chosen documents hold each."""
        yes, counts = run_lengths([x for x, c in zip(self.parts[kind], chosen) if c])
        no, _ = run_lengths([x for x, c in zip(self.parts[kind], chosen) if not c])
        keys = run_lengths([yes, no])[0]
        n = np.zeros(len(keys), np.int64)
        n[np.searchsorted(keys, yes)] = counts
        return keys, n

    def all_keys(self, kind: int) -> np.ndarray:
        return run_lengths(self.parts[kind])[0]

    def totals(self, kind: int, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Sum per document of the values of its keys (sorted keys are looked up in cache order)."""
        return np.array([values[np.searchsorted(keys, np.sort(x))].sum() for x in self.parts[kind]])


def run_lengths(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of several arrays and their counts."""
    x = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[starts], np.diff(np.append(starts, len(x)))


def _gather(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys of a bucket over all blocks, their counts, and each block's own keys."""
    own = [_unpack(k) for k in pdf["keys"]]
    counts = [np.frombuffer(n, np.uint32) for n in pdf["n"]]
    keys, at = np.unique(np.concatenate(own), return_inverse=True)
    return keys, np.bincount(at.reshape(-1), np.concatenate(counts).astype(float), len(keys)), own


def score(docs: DataFrame, trains, depth: int = DEPTH, block_bytes: int = 8 << 20) -> DataFrame:
    """Score whole texts of (doc_id, text); learn from rows for which ``trains`` holds.

    Returns doc_id, held_out, n_tokens (words and one end), n_known (tokens
    seen in training), train_tokens, base_score (smoothed word frequencies)
    and score (context-tree weighting), both as log10 probabilities of the
    whole text. Null texts are empty: their one token is the end. Null ids
    are kept and their rows train unless ``trains`` says no. Repeated
    rows count and are scored as often as they occur; an empty table gives no
    rows; other columns are ignored. ``block_bytes`` bounds a task's text on
    average. A bucket's keys are bounded by the two-byte contexts hashed to
    it, not by a number: they grow with the corpus, at its commonest context's
    share of the distinct keys (about 3 %).
    """
    # ids travel as text: pandas columns would round long ids beside nulls
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.coalesce(trains, F.lit(True)).alias("trains"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // block_bytes
    buckets = int(min(max(blocks, 8), 4096))
    docs = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        block, out = Block(pdf["text"], depth), []
        for kind in (0, 1):
            keys, n = block.distinct(kind, pdf["trains"].to_numpy(bool))
            of = _bucket(keys, kind == 0, depth, buckets)
            order = np.argsort(of, kind="stable")
            for b, at in zip(*_runs(of[order], order)):
                out.append((kind, int(b), int(pdf["block"].iloc[0]), _pack(keys[at]), n[at].astype(np.uint32).tobytes()))
        return pd.DataFrame(out, columns=["kind", "bucket", "block", "keys", "n"])

    counted = docs.groupBy("block").applyInPandas(count, "kind int, bucket int, block long, keys binary, n binary")
    counted = write_table(counted, "context-counts")

    def tops(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, n, _ = _gather(pdf)
        levels = levels_of(keys, n, depth, 2)
        log_w = weigh(levels)[0]
        node, at = np.unique(up(levels[0].node), return_inverse=True)
        sums = [np.bincount(at.reshape(-1), x) for x in (levels[0].n0, levels[0].n1, log_w)]
        return pd.DataFrame({"node": node.astype(np.int64), "n0": sums[0], "n1": sums[1], "below": sums[2]})

    sums = counted.where("kind = 1").groupBy("bucket").applyInPandas(tops, "node long, n0 double, n1 double, below double")
    sums = sums.groupBy("node").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "below")))
    got = sums.toPandas()  # at most 256 contexts times 255 nodes
    flat = [np.zeros(65536) for _ in range(3)]
    for x, c in zip(flat, ("n0", "n1", "below")):
        x[got["node"].to_numpy(np.int64)] = got[c]
    top = top_mixture(*(x.reshape(256, 256) for x in flat))

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, n, own = _gather(pdf)
        if pdf["kind"].iloc[0] == 0:
            value = n
        else:
            levels = levels_of(keys, n, depth, 2)
            value = log_probs(keys, n, depth, levels, weigh(levels), top)
        raw = [value[np.searchsorted(keys, k)].astype(np.float32 if pdf["kind"].iloc[0] else np.float64).tobytes() for k in own]
        out = pdf[["kind", "bucket", "block"]].assign(value=raw, tokens=0.0, distinct=0)
        out.loc[out.index[0], ["tokens", "distinct"]] = n.sum(), int((n > 0).sum())
        return out

    told = counted.groupBy("kind", "bucket").applyInPandas(
        answer, "kind int, bucket int, block long, value binary, tokens double, distinct long"
    )
    told = write_table(told, "context-values")
    total = told.where("kind = 0").agg(F.sum("tokens"), F.sum("distinct")).first()
    n_train, n_distinct = total[0] or 0.0, total[1] or 0

    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        block = Block(left["text"], depth)
        value = []
        for kind in (0, 1):
            keys = block.all_keys(kind)
            of = _bucket(keys, kind == 0, depth, buckets)
            v = np.empty(len(keys))
            for b, raw in right.loc[right["kind"] == kind, ["bucket", "value"]].itertuples(index=False):
                v[of == b] = np.frombuffer(raw, np.float32 if kind else np.float64)
            value.append((keys, v))
        (words, c), (grams, lp) = value
        base = np.log10((c + 0.1) / (n_train + 0.1 * (n_distinct + 1)))
        return pd.DataFrame(
            {
                "doc_id": left["doc_id"],
                "held_out": ~left["trains"],
                "n_tokens": [len(x) for x in block.parts[0]],
                "n_known": block.totals(0, words, (c > 0).astype(float)).round().astype(np.int64),
                "train_tokens": int(n_train),
                "base_score": block.totals(0, words, base),
                "score": block.totals(1, grams, lp),
            }
        )

    told = told.select("kind", "bucket", "block", "value")
    shape = "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = docs.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(finish, shape)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def _runs(of: np.ndarray, order: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Distinct values of a sorted array, and the parts of ``order`` that belong to each."""
    cuts = np.flatnonzero(np.diff(of)) + 1
    return [int(x) for x in of[np.concatenate([[0], cuts])]], np.split(order, cuts)


def op3_ctw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document; the model learns where the fold remainder (of 10) is not 0."""
    return score(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 10) != 0)
