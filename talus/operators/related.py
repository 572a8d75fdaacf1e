"""The best related rows of a group by cosine, tag overlap and a bonus.

A group's queries meet its rows in blocks of bounded size. A block's scores
are products of matrices; a row that may be among a query's best by them, with
a margin for their rounding, gets its score once more, summed in order as by
:func:`talus.functions.columns.cosine`, and only those scores decide.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows and queries of a group in one block, about; queries, pairs and different tags that are scored at once.
ROWS, QUERIES, STRIPE, PAIRS, TAGS = 4096, 2048, 256, 1 << 17, 64
_WIDE = Context(prec=400)


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as by Spark: the shortest decimal of a double, half away from zero."""
    unit = Decimal(1).scaleb(-digits)
    values, at = np.unique(x, return_inverse=True)
    return np.array([float(Decimal(repr(v)).quantize(unit, ROUND_HALF_UP, _WIDE)) if np.isfinite(v) else v for v in values.tolist()])[at]


class Vectors:
    """Vectors of a block in rows padded with 0, their lengths, and the place of their first null."""

    def __init__(self, column: pa.ChunkedArray):
        lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
        self.length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, width = lists.flatten(), int(self.length.max(initial=0))
        own = np.arange(width) < self.length[:, None]
        self.x, gap = np.zeros(own.shape), np.zeros(own.shape, bool)
        self.x[own] = pc.fill_null(flat.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
        gap[own] = flat.is_null().to_numpy(zero_copy_only=False)
        self.null_at = np.where(gap.any(1), gap.argmax(1), width) if width else np.zeros(len(gap), np.int64)
        self.known: dict[int, tuple] = {}

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the first n numbers: unit vectors (0 where there is none), which vectors these do not stand for, squared lengths summed in order, vectors with a null."""
        if n not in self.known:
            x, void, square = self.x[:, :n], self.null_at < np.minimum(n, self.length), np.zeros(len(self.x))
            with np.errstate(all="ignore"):
                for d in range(n):
                    square += x[:, d] * x[:, d]
                size = np.sqrt(square)
                sane = np.isfinite(size) & (size > 1e-140) & ~void
                unit = np.where(sane[:, None], x / np.where(sane, size, 1.0)[:, None], 0.0)
            self.known[n] = unit, ~sane & ~void & (x != 0).any(1), square, void
        return self.known[n]


def about(a: Vectors, at: slice, b: Vectors) -> np.ndarray:
    """Cosines of some of a with b over common lengths, to the accuracy of a matrix product; NaN where that cannot tell."""
    out = np.zeros((len(a.x[at]), len(b.x)))
    for i in np.unique(a.length[at]):
        for j in np.unique(b.length):
            rows, cols, n = np.flatnonzero(a.length[at] == i), np.flatnonzero(b.length == j), int(min(i, j))
            (u, odd_u, *_), (v, odd_v, *_) = a.of(n), b.of(n)
            part = u[at][rows] @ v[cols].T
            part[odd_u[at][rows]] = np.nan
            part[:, odd_v[cols]] = np.nan
            out[np.ix_(rows, cols)] = part
    return out


def cosines(a: Vectors, i: np.ndarray, b: Vectors, j: np.ndarray) -> np.ndarray:
    """Cosines of pairs over common lengths, summed in order; 0 for empty or zero vectors and for those with a null."""
    common, out = np.minimum(a.length[i], b.length[j]), np.zeros(len(i))
    for n in np.unique(common):
        own = np.flatnonzero(common == n)
        (_, _, square_a, void_a), (_, _, square_b, void_b) = a.of(int(n)), b.of(int(n))
        for at in range(0, len(own), PAIRS):
            some = own[at : at + PAIRS]
            p, q = i[some], j[some]
            with np.errstate(all="ignore"):
                dot = np.zeros(len(some))
                for d in range(n):
                    dot += a.x[p, d] * b.x[q, d]
                size = np.sqrt(square_a[p] * square_b[q])
                size = np.where(np.isfinite(size) & (size > 1e-140), size, np.sqrt(square_a[p]) * np.sqrt(square_b[q]))
                out[some] = np.where((size == 0) | void_a[p] | void_b[q], 0.0, dot / size)
    return out


def overlaps(queries: list, rows: list) -> np.ndarray:
    """Elements of each query's tags that each row's tags hold; repeats in a query's count, nulls do not."""
    known: dict[str, int] = {}
    mine = [(i, known.setdefault(t, len(known))) for i, tags in enumerate(queries) for t in tags or () if t is not None]
    theirs = [(j, known[t]) for j, tags in enumerate(rows) for t in set(tags or ()) if t in known]
    out = np.zeros((len(queries), len(rows)))
    (i, s), (j, t) = (np.array(x, np.int64).reshape(-1, 2).T for x in (mine, theirs))
    for low in range(0, len(known), TAGS):
        count, has = np.zeros((len(queries), TAGS)), np.zeros((len(rows), TAGS))
        a, b = (s >= low) & (s < low + TAGS), (t >= low) & (t < low + TAGS)
        np.add.at(count, (i[a], s[a] - low), 1)
        has[j[b], t[b] - low] = 1
        out += count @ has.T
    return out


def related(
    rows: DataFrame, group: str, id_: str, vector: str, query: Column, k: int, digits: int,
    cosine_weight: float = 1.0, tags: str | None = None, tag_weight: float = 0.0, bonus: Column | None = None,
) -> DataFrame:
    """(q, c, score, rank): the k best other rows c of its group for each row q that ``query`` marks.

    The score is cosine_weight * cosine + tag_weight * overlap + the row's
    bonus (null: 0); it ranks by its value rounded to ``digits``, then by the
    smaller id (a whole number). Null and zero vectors have cosine 0; rows
    without a group or an id take no part.
    """
    v = F.col(vector) if dict(rows.dtypes)[vector] == "array<float>" else F.col(vector).cast("array<double>")
    extra = F.coalesce(bonus.cast("double"), F.lit(0.0)) if bonus is not None else F.lit(0.0)
    own_tags = F.col(tags) if tags else F.lit(None).cast("array<string>")
    e = rows.select(F.col(group).alias("g"), F.col(id_).cast("long").alias("id"), v.alias("v"), own_tags.alias("tags"), extra.alias("bonus"), F.coalesce(query, F.lit(False)).alias("asks"))
    e = e.where("g IS NOT NULL AND id IS NOT NULL")
    counts = e.groupBy("g").agg(F.ceil(F.count("*") / ROWS).alias("parts"), F.ceil(F.count_if("asks") / QUERIES).alias("stripes"))
    large = F.broadcast(counts.where("parts > 1 OR stripes > 1"))  # a group of at least QUERIES rows each
    one = F.lit(1).cast("long")
    e = e.join(large, "g", "left").withColumns({"parts": F.coalesce("parts", one), "stripes": F.greatest(F.coalesce("stripes", one), one), "h": F.xxhash64("id", "v")})
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda c: F.col(c).alias(c)  # noqa: E731  (a new column on each side of the cogroup)
    part, stripe = (F.pmod("h", F.col(n)) for n in ("parts", "stripes"))
    asked = e.where("asks").withColumn("stripe", stripe).select(own("g"), every("parts").alias("part"), own("stripe"), own("id"), own("v"), own("tags"))
    met = e.withColumn("part", part).select(own("g"), own("part"), every("stripes").alias("stripe"), own("id"), own("v"), own("tags"), own("bonus"))

    step = STRIPE

    def best(queries: pa.Table, others: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if queries.num_rows and others.num_rows:
            a, b = Vectors(queries["v"]), Vectors(others["v"])
            q, c, plus = (t[n].to_numpy() for t, n in ((queries, "id"), (others, "id"), (others, "bonus")))
            their = others["tags"].to_pylist() if tags else None
            for low in range(0, len(q), step):
                at = slice(low, low + step)
                both = overlaps(queries["tags"][at].to_pylist(), their) if tags else np.zeros((len(q[at]), len(c)))
                s = cosine_weight * about(a, at, b) + tag_weight * both + plus
                unsure, same = ~np.isfinite(s), q[at, None] == c
                s[unsure | same] = -np.inf
                least = np.partition(s, -k, axis=1)[:, -k] if len(c) > k else np.full(len(s), -np.inf)
                wide = np.abs(s, where=np.isfinite(s), out=np.zeros_like(s)).max(initial=1.0) + abs(cosine_weight)
                margin = 1.01 * 10.0**-digits + 4e-16 * (a.x.shape[1] + 64) * wide
                i, j = np.nonzero(((s >= least[:, None] - margin) | unsure) & ~same)
                score = cosine_weight * cosines(a, i + low, b, j) + tag_weight * both[i, j] + plus[j]
                tied = np.bincount(i, minlength=len(s))[i] > k
                key = score.copy()
                key[tied] = half_up(score[tied], digits)
                order = np.lexsort((c[j], np.where(np.isnan(key), -np.inf, -key), ~np.isnan(key), i))
                first = np.searchsorted(i[order], np.arange(len(s)))
                top = order[np.arange(len(i)) - first[i[order]] < k]
                out.append((q[at][i[top]], c[j[top]], score[top]))
        return pa.table({n: np.concatenate(x) for n, x in zip(("q", "c", "score"), zip(*out))})

    keys = ["g", "part", "stripe"]
    found = asked.groupBy(*keys).cogroup(met.groupBy(*keys)).applyInArrow(best, "q long, c long, score double")
    w = Window.partitionBy("q").orderBy(F.round("score", digits).desc(), "c")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
