"""Small helpers that the training-data operators share.

Intermediate tables go to the shared folder that ``spark.checkpoint.dir``
names (any executor can read them again after a loss); a private temporary
folder is used only where that setting is missing and the master is local, as
in tests. On a cluster without the setting this is an error.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words: runs of anything but blank, tab, newline, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
#: A joined side of at most this many bytes (counted, not estimated) is broadcast.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared scratch folder of the cluster; set here only where unset."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="talus-scratch-"))
        where = context.getCheckpointDir()
    return where


def write_table(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/talus/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(*tables: DataFrame) -> None:
    """Delete the scratch tables that these frames read, once nothing needs them any more."""
    for df in tables:
        spark = df.sparkSession
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if f"{scratch_dir(spark).split(':', 1)[-1].strip('/')}/talus/" in name:
                path = spark._jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sized(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a (cheaply counted) table for broadcast if it is proven small.

    ``row_bytes`` bounds a row's size. Beyond ``limit`` the table is returned
    as it is and the join shuffles both sides.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


#: Bytes of rows that one task of a sorted shuffle should get.
TASK_BYTES = 16 << 20


def parts_for(rows: int, row_bytes: int) -> int:
    """Number of partitions for counted rows of about ``row_bytes`` each, so that a task's share does not grow with the input."""
    return max(1, -(-rows * row_bytes // TASK_BYTES))


def numbered(rows: DataFrame, order: list[str], tag: str) -> DataFrame:
    """``rows`` with ``idx``, the place within ``g`` by ``order`` from 0, and ``n``, the rows of ``g``.

    Rows are dealt into ranges of (g, order); ``row_number`` runs inside a
    range and the counts of the ranges before it are added.
    """
    keys = ["g", *order]
    ranged = rows.repartitionByRange(parts_for(rows.count(), 256), *keys)
    local = write_table(ranged.withColumn("part", F.spark_partition_id()), tag)
    counts = local.groupBy("g", "part").agg(F.count("*").alias("rows"))
    of_group = Window.partitionBy("g")
    counts = counts.select(
        "g",
        "part",
        (F.sum("rows").over(of_group.orderBy("part")) - F.col("rows")).alias("before"),
        F.sum("rows").over(of_group).alias("n"),
    )
    # one row per range and group; a group key of usual length is far below 256 bytes
    widest = local.agg(F.max(F.octet_length("g"))).first()[0] or 0
    place = F.row_number().over(Window.partitionBy("g", "part").orderBy(*order)) - 1
    return local.withColumn("place", place).join(sized(counts, 64 + widest), ["g", "part"]).withColumn("idx", F.col("place") + F.col("before")).drop("part", "place", "before")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


#: A key with more than this share of all rows is hot: there are at most 1 / HOT of them.
HOT = 0.001


def join_unique(rows: DataFrame, unique: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Join rows to a table with one row per key, without a hot key's rows in one task.

    ``weight`` names the column of ``unique`` with the number of rows of a
    key, ``total`` is the number of all rows. Hot keys, 1 / HOT at most
    whatever the input, are broadcast and their rows stay where they are.
    Both tables are read twice, so they should be written ones.
    """
    hot = F.coalesce(F.col(weight) > F.lit(HOT * total), F.lit(False))
    few = F.broadcast(unique.where(hot))
    rest = rows.join(few.select(key), key, "left_anti").join(unique.where(~hot), key)
    return rows.join(few, key).unionByName(rest)


_ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
    "array<double>": pa.list_(pa.float64()), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
}


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in ddl.split(","))])


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], ddl: str) -> DataFrame:
    """Map Arrow batches to columns. Unlike pandas columns, 64-bit ids stay exact beside nulls.

    ``make`` is called once per task and gives the function of a batch, so
    that it may hold state (caches, automata).
    """
    schema = arrow_schema(ddl)

    def run(batches):
        of = make()
        for batch in batches:
            yield pa.RecordBatch.from_pydict(of(batch), schema=schema)

    return df.mapInArrow(run, ddl)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD))


def fold(text: Column, modulus: int) -> Column:
    """crc32 of an id as text, modulo: the split of rows into folds."""
    return F.crc32(text.cast("string").cast("binary")) % F.lit(modulus)


_WS = bytes(range(9, 14)) + b" "
#: Byte map: A-Z to a-z, every white-space byte to a blank.
LOWER_BLANK = bytes(
    32 if b in _WS else b + 32 if 65 <= b <= 90 else b for b in range(256)
)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), element-wise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8 bytes, A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").translate(LOWER_BLANK).split()


class WordHasher:
    """64-bit hashes of words, remembered for up to ``keep`` distinct words."""

    def __init__(self, keep: int = 200_000):
        self.keep, self.seen = keep, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        seen = self.seen
        if len(seen) > self.keep:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash for each window of ``n`` word hashes.

    A text of fewer than ``n`` words has one shingle of all its words; a text
    of no words has none.
    """
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    m = len(hashes) - n + 1
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = out * _MIX + hashes[i : i + m]
    return mix64(out)


def slices(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Groups of equal keys of sorted batches as arrays by column; a group may span batches."""
    rest = None
    for pdf in batches:
        if not len(pdf):
            continue
        cols = {c: pdf[c].to_numpy() for c in pdf.columns}
        if rest is not None:
            cols = {c: np.concatenate([rest[c], v]) for c, v in cols.items()}
        n = len(next(iter(cols.values())))
        new = np.zeros(n - 1, bool)
        for k in keys:
            new |= cols[k][1:] != cols[k][:-1]
        ends = np.flatnonzero(new) + 1
        start = 0
        for end in ends:
            yield {c: v[start:end] for c, v in cols.items()}
            start = end
        rest = {c: v[start:] for c, v in cols.items()}
    if rest is not None:
        yield rest


def framed(rows: Iterator[tuple], columns: list[str], size: int = 2000) -> Iterator[pd.DataFrame]:
    """Rows as frames of about ``size`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pd.DataFrame(held, columns=columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns)
