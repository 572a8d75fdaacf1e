"""Operator 6: nearest neighbours by inner product from randomly rotated one-bit codes.

A vector's residual from its nearest coarse centre is rotated and kept as one
bit a dimension; what the bits leave over is rotated anew and coded in the same
way, ``LEVELS`` times. A norm and one correction scalar a level give unbiased
estimates of inner products, from bit counts of packed codes and query planes,
and a bound on their error after each level. Only the codes meet the queries:
a first scan over the most promising centres finds, per query, k candidates
whose exact products set a floor; a second scan skips every centre, and drops
after each level every vector, whose upper bound stays below the floor. The
original vectors are fetched for the survivors alone.

Equal vectors form a class that is searched once, so that thousands of copies
cost one candidate. Queries and codes meet in blocks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talus.llm.common import drop_table, map_batches, sized, table, write_table

LEVELS, PLANES = 4, 6
#: Pairs of a query and a code that are estimated at a time.
PAIRS = 1 << 17


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    raw = np.packbits(bits, axis=1)
    if raw.shape[1] % 8:
        raw = np.pad(raw, ((0, 0), (0, -raw.shape[1] % 8)))
    return raw.view(np.uint64)


def popcount(words: np.ndarray) -> np.ndarray:
    if words.shape[1] == 1:
        return np.bitwise_count(words[:, 0]).astype(np.float32)
    return np.bitwise_count(words).sum(1, dtype=np.float32)


class BitCoder:
    """Fitted on a bounded sample: coarse centres; and a random rotation for each level."""

    def __init__(self, sample: np.ndarray, dim: int, centres: int = 16, seed: int = 5, error: float = 2.4):
        rng = np.random.default_rng(seed)
        self.rotations = [np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(LEVELS)]
        self.error, self.dim = error, dim
        c = sample[rng.permutation(len(sample))[:centres]] if len(sample) else np.zeros((1, dim))
        for _ in range(10 if len(sample) else 0):
            near = self._nearest(sample, c)
            c = np.vstack([sample[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
        self.centres = c

    @staticmethod
    def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return ((c * c).sum(1) - 2 * (x @ c.T)).argmin(1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words of all levels, centre, residual norm, alignment of each level's code with what it codes)."""
        near = self._nearest(x, self.centres)
        rest = x - self.centres[near]
        norm = np.sqrt((rest * rest).sum(1))
        words, align = [], []
        for rotation in self.rotations:
            turned = rest @ rotation
            size = np.sqrt((rest * rest).sum(1))
            sign = np.where(turned > 0, 1.0, -1.0)
            a = np.maximum(np.abs(turned).sum(1) / np.maximum(size, 1e-300) / np.sqrt(self.dim), 1e-9)
            words.append(packed(turned > 0))
            align.append(np.minimum(a, 1.0))
            rest = rest - (size * a / np.sqrt(self.dim))[:, None] * (sign @ rotation.T)
        return np.hstack(words), near.astype(np.int32), norm.astype(np.float32), np.column_stack(align).astype(np.float32)

    def turned(self, q: np.ndarray, level: int) -> tuple[np.ndarray, ...]:
        """Queries turned and rounded to PLANES bits: per query least, step, sum, norm of the rounding; bit planes."""
        x = q @ self.rotations[level]
        low = x.min(1)
        step = np.maximum((x.max(1) - low) / (2**PLANES - 1), 1e-300)
        whole = np.rint((x - low[:, None]) / step[:, None])
        planes = [packed(whole.astype(np.uint8) >> np.uint8(p) & 1 > 0) for p in range(PLANES)]
        rest = x - low[:, None] - step[:, None] * whole
        return *(v.astype(np.float32) for v in (low, step, x.sum(1), np.sqrt((rest * rest).sum(1)))), planes

    def survivors(self, q: np.ndarray, centre: int, words, norm, align, floor: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (query, row, estimate) of one centre whose upper bound reaches the query's floor after every level.

        ``most``: only so many best rows per query after the first level.
        """
        width, root, n = words.shape[1] // LEVELS, np.sqrt(self.dim), len(words)
        length = np.sqrt((q * q).sum(1)).astype(np.float32)
        single = 3e-6 * (norm + np.float32(np.sqrt((self.centres[centre] ** 2).sum())))  # of single-precision sums
        i, j = np.repeat(np.arange(len(q)), n), np.tile(np.arange(n), len(q))
        known, size = np.repeat((q @ self.centres[centre]).astype(np.float32), n), norm[j]
        est = known
        for level in range(LEVELS):
            low, step, total, rounding, planes = self.turned(q, level)
            part = words[j, level * width : (level + 1) * width]
            t = 2 * low[i] * popcount(part) - total[i]
            for p in range(PLANES):
                t += (2 ** (p + 1) * step)[i] * popcount(part & planes[p][i])
            a = align[j, level]
            rest = np.maximum(1 - a * a, 0)
            est = known + size / (a * root) * t
            wide = np.sqrt(rest + 3e-7)  # alignments are kept in single precision
            slack = size / a * self.error * (length[i] * wide / np.sqrt(max(self.dim - 1, 1)) + rounding[i] / root) + single[j] * length[i]
            keep = est + slack >= floor[i]
            if most is not None and level == 0 and n > most:
                grid = est.reshape(-1, n)
                keep &= (grid >= np.partition(grid, n - most, axis=1)[:, [n - most]]).ravel()
            known = (known + size * a / root * t)[keep]
            i, j, est, size = i[keep], j[keep], est[keep], (size * np.sqrt(rest))[keep]
        return i, j, est


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, embedding) that take part in a search.

    Null, empty and zero vectors and those with null or non-finite components
    are left out; so are those of another length than the commonest, and rows
    with a null vec_id.
    """
    e = F.col("embedding")
    ok = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where("vec_id is not null").select("vec_id", "embedding")
    rows = rows.where(e.isNotNull() & F.coalesce(ok, F.lit(False))).where(F.exists(e, lambda v: v != 0))
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).head(1)
    return rows.where(F.size("embedding") == (sizes[0]["n"] if sizes else 0))


def reranked(pairs: DataFrame, asked: DataFrame, reps: DataFrame) -> DataFrame:
    """(q, cls, least vec_id of the class, score) of pairs: exact inner products of the original vectors, in double precision."""
    rows = pairs.join(asked.select(F.col("cls").alias("q"), F.col("embedding").alias("a")), "q")
    rows = rows.join(reps.select("cls", "least", F.col("embedding").alias("b")), "cls").select("q", "cls", "least", "a", "b")

    def make():
        def of(batch):
            n = batch.num_rows
            a, b = (batch[c].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) if n else np.zeros((0, 1)) for c in ("a", "b"))
            return {"q": batch["q"], "cls": batch["cls"], "least": batch["least"], "score": np.einsum("ij,ij->i", a, b)}

        return of

    return map_batches(rows, make, "q long, cls long, least long, score double")


def nearest(
    vectors: DataFrame,
    query: F.Column,
    k: int = 20,
    sample: int = 4096,
    centres: int = 16,
    probe: int = 4,
    code_block: int = 8192,
    query_block: int = 2048,
) -> DataFrame:
    """The k nearest rows of every row for which ``query`` holds, by inner product in double precision.

    Returns query_id, rank (from 1), vec_id, score; a query's own row is no
    candidate, all others are, other rows of its vec_id too; ties go to the
    smaller vec_id; fewer than k candidates give them all. Rows that take no
    part: see :func:`usable`. An empty table gives no rows; columns other than
    vec_id and embedding are ignored. ``sample`` bounds the rows on which the
    ``centres`` are fitted; every row is coded and searched. ``probe`` is the
    number of centres of the first scan. ``code_block`` and ``query_block``
    bound the rows of a task's group.
    """
    rows = usable(vectors).withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")})
    rows = write_table(rows, "vectors")
    least = Window.partitionBy("h1", "h2").orderBy("vec_id")
    members = rows.withColumn("rn", F.row_number().over(least)).where(F.col("rn") <= k + 1)
    members = write_table(members, "vector-members")
    reps = members.where("rn = 1").select(F.monotonically_increasing_id().alias("cls"), F.col("vec_id").alias("least"), "h1", "h2", "embedding")
    reps = write_table(reps, "vector-classes")
    queries = rows.where(query).select(F.col("vec_id").alias("query_id"), "h1", "h2")
    queries = write_table(queries.join(reps.select("h1", "h2", "cls"), ["h1", "h2"]).select("query_id", "cls"), "queries")
    asked = write_table(reps.join(sized(queries.select("cls").distinct(), 16), "cls", "left_semi").select("cls", "embedding"), "asked")
    n_reps, n_asked = reps.count(), asked.count()
    taken = reps.where(F.pmod("h2", F.lit(1 << 20)) < (1 << 20) * min(1.0, sample / max(n_reps, 1)))
    fitted = [r.embedding for r in taken.select("embedding").limit(2 * sample).collect()]
    dim = len((reps.select("embedding").head(1) or [[[0.0]]])[0][0])
    coder = BitCoder(np.array(fitted, float).reshape(-1, dim), dim, centres)

    def make():
        def of(batch):
            n = batch.num_rows
            x = batch["embedding"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, dim)
            words, near, norm, align = coder.encode(x)
            code = [a.tobytes() + b.tobytes() for a, b in zip(words, align)]
            return {"cls": batch["cls"], "near": near, "norm": norm.astype(float), "code": code}

        return of

    codes = write_table(map_batches(reps.select("cls", "embedding"), make, "cls long, near int, norm double, code binary"), "codes")
    radius = {r.near: (r.n, r.far) for r in codes.groupBy("near").agg(F.count("*").alias("n"), F.max("norm").alias("far")).collect()}  # a row per centre
    n_blocks = {c: -(-n // code_block) for c, (n, _) in radius.items()}
    n_qb = max(1, -(-n_asked // query_block))
    cb_count = F.element_at(F.create_map(*(F.lit(x) for c in n_blocks.items() for x in c)), F.col("near")) if n_blocks else F.lit(1)
    spread = codes.withColumn("cb", F.pmod(F.xxhash64("cls"), cb_count).cast("int"))
    spread = spread.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_qb - 1))))

    def routed(floors: DataFrame | None) -> DataFrame:
        """(q, embedding, floor, near, qb, cb): each query with the blocks of the centres to scan for it."""
        own = asked.select("cls", F.col("embedding").cast("array<double>").alias("embedding"), F.lit(float("-inf")).alias("floor"))
        if floors is not None:
            own = own.drop("floor").join(floors.withColumnRenamed("q", "cls"), "cls", "left").fillna(float("-inf"), ["floor"])

        all_centres = floors is not None

        def make():
            here = np.array(sorted(radius), np.int64)
            far = np.array([radius[c][1] for c in here])

            def of(batch):
                x = batch["embedding"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
                top = x @ coder.centres[here].T + np.sqrt((x * x).sum(1))[:, None] * far * (1 + 1e-6)
                if not all_centres:
                    ok = top >= -np.sort(-top, axis=1)[:, [min(probe, len(here)) - 1]]
                else:
                    ok = top >= batch["floor"].to_numpy(zero_copy_only=False)[:, None]
                return {"q": batch["cls"], "embedding": batch["embedding"], "floor": batch["floor"], "nears": [here[o].tolist() for o in ok]}

            return of

        sent = map_batches(own, make, "q long, embedding array<double>, floor double, nears array<int>")
        sent = sent.withColumn("qb", F.pmod(F.xxhash64("q"), F.lit(n_qb)).cast("int")).withColumn("near", F.explode("nears")).drop("nears")
        return sent.withColumn("cb", F.explode(F.sequence(F.lit(0), (cb_count - 1).cast("int"))))

    def scan(most: int | None):
        def of(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out: list[tuple] = []
            if len(left) and len(right):
                raw = np.frombuffer(b"".join(right["code"]), np.uint8).reshape(len(right), -1)
                cut = raw.shape[1] - 4 * LEVELS
                words, align = np.ascontiguousarray(raw[:, :cut]).view(np.uint64), np.ascontiguousarray(raw[:, cut:]).view(np.float32)
                norm, cls, centre = right["norm"].to_numpy(np.float32), right["cls"].to_numpy(), int(right["near"].iloc[0])
                ids, vectors, floors = left["q"].to_numpy(), np.vstack(left["embedding"]), left["floor"].to_numpy(np.float32)
                few = max(1, PAIRS // len(right))
                for a in range(0, len(left), few):
                    i, j, est = coder.survivors(vectors[a : a + few], centre, words, norm, align, floors[a : a + few], most and 4 * most)
                    ends = np.searchsorted(i, np.arange(len(ids[a : a + few]) + 1))
                    for q, x, y in zip(ids[a : a + few].tolist(), ends, ends[1:]):
                        at, e = j[x:y], est[x:y]
                        if most is not None and len(at) > most:
                            best = np.argpartition(-e, most - 1)[:most]
                            at, e = at[best], e[best]
                        out.append((q, cls[at].tolist(), e.tolist()))
            return pd.DataFrame(out, columns=["q", "cls", "est"])

        return of

    def scanned(floors: DataFrame | None, most: int | None) -> DataFrame:
        keys = ["near", "qb", "cb"]
        both = routed(floors).groupBy(*keys).cogroup(spread.groupBy(*keys))
        return both.applyInPandas(scan(most), "q long, cls array<long>, est array<double>").select("q", F.inline(F.arrays_zip("cls", "est")))

    first = Window.partitionBy("q").orderBy(F.desc("est"), "cls")
    pairs = scanned(None, k + 1).withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= 2 * (k + 1)).select("q", "cls")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "least")
    floors = reranked(pairs, asked, reps).withColumn("rn", F.row_number().over(best)).where(F.col("rn") == k + 1)
    floors = write_table(floors.select("q", F.col("score").alias("floor")), "floors")  # k other classes reach it
    pairs = write_table(scanned(floors, None).select("q", "cls"), "survivors")
    found = reranked(pairs, asked, reps).withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k + 1).drop("rn")
    found = write_table(found, "nearest-classes")
    drop_table(codes, floors, pairs)
    named = reps.select("cls", "h1", "h2").join(members.select("h1", "h2", "vec_id"), ["h1", "h2"])
    named = named.groupBy("cls").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))  # k + 1 at most
    rows_of = found.join(named, "cls").groupBy("q").agg(F.collect_list(F.struct("score", "cls", "ids")).alias("near"))
    own = queries.join(rows_of.withColumnRenamed("q", "cls"), "cls")

    def without_own(x):
        """Ids of a class; the query's own row is taken out of its own class once."""
        at = F.array_position(x["ids"], F.col("query_id")).cast("int")
        less = F.concat(F.slice(x["ids"], 1, F.greatest(at - 1, F.lit(0))), F.slice(x["ids"], at + 1, k + 1))
        return F.when((x["cls"] == F.col("cls")) & (at > 0), less).otherwise(x["ids"])

    each = F.flatten(F.transform("near", lambda x: F.transform(without_own(x), lambda i: F.struct((-x["score"]).alias("s"), i.alias("vec_id")))))
    out = own.select("query_id", F.posexplode(F.slice(F.array_sort(each), 1, k)).alias("rank", "n"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("n.vec_id").alias("vec_id"), (-F.col("n.s")).alias("score"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every row of ``embeddings`` whose vec_id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
