"""Operator 5: n-gram Jaccard self-join by chosen paths.

Each text's set of word shingles is represented by ``COORDS`` min-hash
tokens. A run splits all sets recursively: at a node of the tree a few
coordinates are sampled, and a set goes to the child of each sampled
coordinate's token, 1 / similarity children on average. Small nodes are
compared pair by pair; a node that no longer shrinks (near copies) is compared
in tiles of bounded size. Runs are repeated until the chance of missing a pair
at the threshold is below the target at the depth that the data really reach:
a deeper tree gets more runs. Pairs that the min-hash tokens make
likely are verified on the whole shingle sets, each in the first of its common
nodes only, so that links can be counted without ever listing them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm.common import WordHasher, drop_table, framed, fresh, join_unique, map_batches, mix64, shingles, sized, slices, table, words_of, write_table
from talus.llm.graph import components

COORDS = 64
SHINGLE = 5
TILE = 512
_A = mix64(np.arange(1, COORDS + 1, dtype=np.uint64)) | np.uint64(1)
_B = mix64(np.arange(1001, COORDS + 1001, dtype=np.uint64))


def shingle_set(text: str | None, hasher: WordHasher) -> np.ndarray:
    """Sorted distinct hashes of a text's five-word shingles (of all its words, if fewer)."""
    return np.unique(shingles(hasher(words_of(text)), SHINGLE))


def signature(s: np.ndarray) -> np.ndarray:
    """COORDS min-hash tokens of 32 bits: chance alone must not put texts into one node."""
    low = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 2048):
        low = np.minimum(low, (s[i : i + 2048, None] * _A + _B).min(0))
    return (mix64(low) >> np.uint64(32)).astype(np.uint32)


def set_key(s: np.ndarray) -> int:
    """A 63-bit hash of a shingle set; 0 for the empty one."""
    import xxhash

    return (xxhash.xxh3_64_intdigest(s.tobytes()) >> 1 or 1) if len(s) else 0


def text_key() -> F.Column:
    """A 64-bit hash of a row's text; null is the empty text."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, sid (hash of the shingle set; 0: no words), tid (hash of the text), n (set size), sig."""

    def make():
        hasher = WordHasher()

        def of(batch):
            sets = [shingle_set(t, hasher) for t in batch["text"].to_pylist()]
            return {
                "doc_id": batch["doc_id"],
                "sid": [set_key(s) for s in sets],
                "tid": batch["tid"],
                "n": [len(s) for s in sets],
                "sig": [signature(s).tobytes() if len(s) else b"" for s in sets],
            }

        return of

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("tid"), "text")
    return map_batches(rows, make, "doc_id long, sid long, tid long, n int, sig binary")


def survival(depth: int) -> float:
    """The chance that a pair at the threshold shares a node ``depth`` levels down in one run."""
    alive = 1.0
    for _ in range(depth):
        alive = 1 - (1 - alive / COORDS) ** COORDS  # a common token is sampled 1 / COORDS of the time
    return alive


def runs_needed(recall: float, depth: int = 2) -> int:
    """Runs until a pair at the threshold shares a node ``depth`` levels down with probability ``recall``."""
    alive = survival(depth)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive)) if alive < 1 else 1


def children(path: np.ndarray, sig: np.ndarray, similarity: float, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, child node) for each child of each row; ``path`` is a node a row, or the one root at which all rows stand."""
    limit = np.uint64(int(2**64 / (similarity * COORDS)))
    coord = np.arange(COORDS, dtype=np.uint64)
    node = mix64(path.astype(np.uint64) + np.uint64(level * 7919))
    i, j = np.nonzero(mix64(node[:, None] ^ mix64(coord + np.uint64(77))[None, :]) < limit)
    if len(node) == 1:
        i, j = np.repeat(np.arange(len(sig)), len(j)), np.tile(j, len(sig))
        node = np.repeat(node, len(sig))
    child = mix64(node[i] ^ mix64((sig[i, j].astype(np.uint64) << np.uint64(8)) + coord[j])) >> np.uint64(1)
    return i, child.astype(np.int64)


def split(rows: DataFrame, similarity: float, level: int, runs: range | None = None) -> DataFrame:
    """Children (path, sid, size of the parent) of rows (path, sid, sig, n_rows); of the roots of ``runs``, if given."""

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            sig = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(-1, COORDS)
            sid, size = pdf["sid"].to_numpy(), pdf["n_rows"].to_numpy()
            for root in [None] if runs is None else runs:
                path = pdf["path"].to_numpy() if root is None else np.array([root])
                i, child = children(path, sig, similarity, level)
                yield pd.DataFrame({"path": child, "sid": sid[i], "parent": size[i]})

    own = ["path", "sid", "sig", "n_rows"] if runs is None else ["sid", "sig", "n_rows"]
    return rows.select(*own).mapInPandas(run, "path long, sid long, parent long")


def leaves(sets: DataFrame, similarity: float, runs: range, max_depth: int = 8, small: int = TILE) -> tuple[DataFrame, int]:
    """(path, sid, n_rows) of the nodes to compare over ``runs``, and the depth reached; nodes with a single set are left out.

    Nodes still large at ``max_depth`` are compared in tiles like all others.
    """
    rows = sets.select("sid", "sig", F.lit(sets.count()).alias("n_rows"))
    out = None
    for level in range(max_depth):
        below = write_table(split(rows, similarity, level, None if level else runs), "paths")
        sizes = below.groupBy("path").agg(F.count("*").alias("n_rows")).where("n_rows > 1")
        counted = write_table(below.join(sizes, "path"), "shared-nodes")
        drop_table(below)
        done = (F.col("n_rows") <= small) | (F.col("n_rows") > 0.6 * F.col("parent"))
        if level == max_depth - 1:
            done = F.lit(True)
        part = counted.where(done).select("path", "sid", "n_rows")
        out = part if out is None else out.unionByName(part)
        wide = counted.where(~done).select("path", "sid", "n_rows")
        if wide.isEmpty():
            break
        rows = wide.join(sets.select("sid", "sig"), "sid")
    return out, level + 1


def all_leaves(sets: DataFrame, similarity: float, recall: float, **how) -> DataFrame:
    """Leaves of as many runs as ``recall`` takes at the depth that they reach."""
    done, need, deepest, out = 0, runs_needed(recall), 2, None
    while done < need:
        nodes, depth = leaves(sets, similarity, range(done + 1, need + 1), **how)
        out = nodes if out is None else out.unionByName(nodes)
        deepest = max(deepest, depth)
        done, need = need, runs_needed(recall, deepest)
    return out


def likely_pairs(sig, n, side, paths, path: int, similarity: float, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a tile that may reach the similarity and have no earlier node in common.

    ``side``: 0 for rows of the tile's first block, 1 of its second, 2 where
    both blocks are the same.
    """
    low = np.minimum(n[:, None], n[None, :]) >= similarity * np.maximum(n[:, None], n[None, :])
    if len(side) and side[0] == 2:
        low &= np.triu(np.ones(low.shape, bool), 1)
    else:
        low &= (side[:, None] == 0) & (side[None, :] == 1)
    i, j = np.nonzero(low)
    keep = []
    for a in range(0, len(i), 20_000):
        x, y = i[a : a + 20_000], j[a : a + 20_000]
        ok = (sig[x] == sig[y]).mean(1) >= similarity - slack
        x, y = x[ok], y[ok]
        earlier = np.zeros(len(x), bool)
        for p in range(paths.shape[1]):
            own = paths[x, p]
            earlier |= (own < path) & (own >= 0) & (paths[y] == own[:, None]).any(1)
        keep.append((x[~earlier], y[~earlier]))
    if not keep:
        return i, j
    return np.concatenate([k[0] for k in keep]), np.concatenate([k[1] for k in keep])


def intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sorted sets i and j."""
    if len(i) < 40:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], np.int64)
    values, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(counts > 1) - 1
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    ok = counts[at] > 1
    owner, column = owner[ok], shared[at[ok]]
    total = np.zeros(len(i), np.float32)
    for c in range(0, int(shared[-1]) + 1 if len(shared) else 0, 4096):
        part = (column >= c) & (column < c + 4096)
        m = np.zeros((len(sets), 4096), np.float32)
        m[owner[part], column[part] - c] = 1
        total += (m @ m.T)[i, j]
    return total.astype(np.int64)


def _tile_rows(g: dict[str, np.ndarray], similarity: float, slack: float) -> tuple[np.ndarray, np.ndarray]:
    sig = np.frombuffer(b"".join(g["sig"]), np.uint32).reshape(-1, COORDS)
    longest = max(map(len, g["paths"]))
    paths = np.full((len(sig), longest), -1, np.int64)
    for r, p in enumerate(g["paths"]):
        paths[r, : len(p)] = p
    return likely_pairs(sig, g["n"], g["side"], paths, int(g["path"][0]), similarity, slack)


_TILE = ["path", "a", "b"]


def classes(docs: DataFrame, similarity: float = 0.8, recall: float = 0.999, slack: float = 0.18) -> DataFrame:
    """One row per document: doc_id, tid (text key), class_id (least doc_id of its near-duplicate class), n_links, kept.

    Two texts are linked if the Jaccard similarity of their sets of five-word
    shingles is at least ``similarity``; classes are the connected components.
    n_links counts the other different texts linked to a document's text.
    Words are split at white space, A-Z in lower case; a text of one to four
    words has one shingle. Null and empty texts and those of white space alone
    are copies of each other, with no links. Equal texts and repeated rows
    share a class without counting as links. ``kept`` holds for the rows of
    the class's first document: least doc_id, null ids last, ties by tid.
    Null ids take part like others; a class without any other id has a null
    class_id. An empty table gives no rows; other columns are ignored.
    ``recall`` is the least chance of finding a pair at the threshold; found
    pairs are verified on whole sets, and a found pair's likelihood test
    allows ``slack`` (over three deviations).
    """
    told = write_table(sketch(docs), "sketches")
    sets = told.groupBy("sid", "tid").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tid")
    sets = sets.groupBy("sid").agg(
        F.min(first).alias("least"), F.count("*").cast("int").alias("texts"), F.sum("rows").alias("rows"), F.first("n").alias("n"), F.first("sig").alias("sig")
    )
    sets = write_table(sets, "sets")
    some = sets.where("sid <> 0").select("sid", "n", "texts", "sig")
    nodes = all_leaves(some, similarity, recall)
    found = write_table(nodes, "nodes")
    drop_table(nodes)
    own = found.groupBy("sid").agg(F.sort_array(F.collect_list("path")).alias("paths"))  # a few per run
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / TILE).cast("int"))
    mine = F.pmod(F.xxhash64("sid", "path"), F.col("n_blocks")).cast("int")
    tiles = found.withColumn("n_blocks", blocks).withColumn("mine", mine)
    tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    tiles = tiles.select(
        "path",
        F.least("mine", "other").alias("a"),
        F.greatest("mine", "other").alias("b"),
        F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"),
        "sid",
    )
    # a block meets itself in its own tile and every other block in one tile each
    rows = tiles.join(some.join(own, "sid"), "sid")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, *_TILE).sortWithinPartitions(*_TILE)

    columns = rows.columns

    def likely(batches):
        for g in slices(batches, _TILE):
            if len(g["sid"]) > 1:
                i, j = _tile_rows(g, similarity, slack)
                for r in np.union1d(i, j):
                    yield tuple(g[c][r] for c in columns)

    def probe(batches):
        return framed(likely(batches), columns)

    shape = rows.schema
    wanted = write_table(rows.mapInPandas(probe, shape), "likely")
    drop_table(found)
    needed = wanted.select("sid").distinct().join(sets.select("sid", "least"), "sid").select("least.doc_id", "least.tid")
    needed = write_table(needed, "needed")

    def make():
        hasher = WordHasher()

        def of(batch):
            got = [shingle_set(t, hasher) for t in batch["text"].to_pylist()]
            return {"sid": [set_key(s) for s in got], "items": [s.tobytes() for s in got]}

        return of

    texts = row_join(docs.select("doc_id", "text"), sized(needed, 32), "left_semi").select("text")
    items = map_batches(texts, make, "sid long, items binary").groupBy("sid").agg(F.first("items").alias("items"))
    rows = wanted.join(items, "sid").repartition(parts, *_TILE).sortWithinPartitions(*_TILE)

    def verified(batches):
        for g in slices(batches, _TILE):
            i, j = _tile_rows(g, similarity, slack)
            if not len(i):
                continue
            n, sid, weight = g["n"], g["sid"], g["texts"]
            both = intersections([np.frombuffer(b, np.uint64) for b in g["items"]], i, j)
            ok = both >= similarity * (n[i] + n[j] - both) - 1e-9
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            count = np.bincount(i, weight[j], len(sid)) + np.bincount(j, weight[i], len(sid))
            root = np.arange(len(sid))
            while True:
                low = root.copy()
                np.minimum.at(low, i, root[j])
                np.minimum.at(low, j, root[i])
                low = low[low]
                if (low == root).all():
                    break
                root = low
            for r in np.flatnonzero(count):
                yield int(sid[r]), int(sid[root[r]]), int(count[r])

    def verify(batches):
        return framed(verified(batches), ["u", "v", "links"])

    joined = write_table(rows.mapInPandas(verify, "u long, v long, links long"), "links")
    comp = components(joined.select("u", "v"))
    counts = joined.groupBy("u").agg(F.sum("links").alias("links"))
    named = sets.join(comp, sets.sid == comp.node, "left").join(counts, sets.sid == counts.u, "left")
    named = named.select("sid", F.coalesce("root", "sid").alias("root"), "least", "texts", "rows", F.coalesce("links", F.lit(0)).alias("links"))
    named = write_table(named, "named")
    drop_table(sets, wanted, needed, joined, comp)
    roots = named.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("size"))
    roots = write_table(roots, "class-firsts")
    named = join_unique(named, roots, "root", "size", named.count())
    n_links = F.when(F.col("sid") == 0, F.lit(0)).otherwise(F.col("links") + F.col("texts") - 1).cast("long")
    named = write_table(named.select("sid", "first", "rows", n_links.alias("n_links")), "set-classes")
    out = join_unique(told.select("doc_id", "sid", "tid"), named, "sid", "rows", told.count())
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tid") == F.col("first.tid"))
    return out.select("doc_id", "tid", F.col("first.doc_id").alias("class_id"), "n_links", kept.alias("kept"))


def row_join(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of rows by doc_id, null ids too, and the key of their text; ``keys`` has doc_id and tid."""
    keys = keys.select(F.col("doc_id").alias("a"), F.col("tid").alias("b"))
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(keys, docs["doc_id"].eqNullSafe(keys["a"]) & (key == keys["b"]), how)


def links(docs: DataFrame, similarity: float = 0.8, recall: float = 0.999, slack: float = 0.18) -> DataFrame:
    """doc_id, class_id and n_links of every document, see :func:`classes`."""
    return classes(docs, similarity, recall, slack).select("doc_id", "class_id", "n_links")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of every document."""
    return links(table(spark, sf_dir, "documents"))


def keep_one_per_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the first row of each near-duplicate class stays, all columns kept.

    First is the least doc_id, null ids last, then the least hash of the
    text. Decisions are taken by row (doc_id and text): of several texts with
    one doc_id only the copies go, and rows with a null doc_id are compared
    like others. Rows with the same doc_id and text are one document; any one
    of them stays.
    """
    told = classes(docs).groupBy("doc_id", "tid").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    told = write_table(told.where("not kept or n > 1"), "copies")
    once = row_join(docs, sized(told, 32), "left_anti").select(docs.columns)
    twice = told.where("kept").select("doc_id", "tid")
    if twice.isEmpty():
        return once
    again = row_join(docs, sized(twice, 32), "left_semi")
    key = fresh(docs, "tid")
    again = again.withColumn(key, text_key()).dropDuplicates(["doc_id", key]).select(docs.columns)
    return once.union(again)
