"""Written tables that batches change: a bucketed upsert with a ledger, and an ingest that resumes by key.

Tables are plain Parquet under a folder that all executors share. Work of a
batch is in proportion to the buckets that it touches; what a stopped job has
committed is not done again.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a folder of this machine only where that is unset and the master is local."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="talus-tables-"))
        where = context.getCheckpointDir()
    return where


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the scratch folder and read again: computed once, safe from lost executors."""
    path = f"{scratch(df.sparkSession)}/talus/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def newest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the greatest ``order`` (nulls least), ties to the greatest other values; combined before the shuffle."""
    rest = [order, *[c for c in rows.columns if c not in (*keys, order)]]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("best_"))
    return best.select(*[F.col(c) if c in keys else F.col(f"best_.{c}").alias(c) for c in rows.columns])


class KeyedTable:
    """A table of the newest row per key, in ``buckets`` folders by a hash of the key.

    :meth:`upsert` rewrites the buckets that a batch touches and no others. A
    batch has an id: once it is in the ledger, the same id changes nothing. A
    job that stops between the two is simply run again, as the newest row of
    a key is the same however often a batch is applied. One writer at a time.
    Keys may be null; the columns of all batches are the same.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: str, buckets: int = 64):
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path, keys, order, buckets
        self.data, self.ledger = f"{path}/data", f"{path}/ledger"

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.data).drop("bucket")

    def done(self) -> list[int]:
        """Ids of the batches in the ledger."""
        return sorted(r[0] for r in self.spark.read.parquet(self.ledger).collect()) if exists(self.spark, self.ledger) else []

    def upsert(self, batch: DataFrame, batch_id: int) -> bool:
        """Apply a batch; False if the ledger has it."""
        if exists(self.spark, f"{self.ledger}/batch={batch_id}"):
            return False
        rows = newest(batch, self.keys, self.order).select("*", self._bucket())
        if exists(self.spark, self.data):
            touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # ``buckets`` numbers at most
            old = self.spark.read.parquet(self.data).where(F.col("bucket").isin(touched))
            rows = newest(old.select(*batch.columns).unionByName(rows.select(*batch.columns)), self.keys, self.order).select("*", self._bucket())
        dealt = rows.repartition("bucket")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.data)
        mark = self.spark.range(1).select(F.lit(batch_id).cast("long").alias("batch_id"))
        mark.coalesce(1).write.mode("overwrite").parquet(f"{self.ledger}/batch={batch_id}")
        return True

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: the stream's own batch ids go to the ledger."""
        return lambda batch, batch_id: (self.upsert(batch, batch_id), None)[1]


def cache_key(item_id: Column, title: Column) -> Column:
    """``item:`` and the id where there is one, else ``title:`` and the trimmed lower-case title."""
    known = F.trim(F.coalesce(item_id.cast("string"), F.lit("")))
    return F.when(known != "", F.concat(F.lit("item:"), known)).otherwise(F.concat(F.lit("title:"), F.lower(F.trim(F.coalesce(title, F.lit(""))))))


def ingest(entries: DataFrame, key: str, order: str, path: str, slices: int = 8, high_water: bool = False) -> int:
    """Append the entries whose key the table at ``path`` does not have, the first of each key in ``order``; returns the slices written.

    Keys are dealt to slices by hash. Each slice is one committed write that
    holds entries and, as their column ``key``, the ledger of what has been
    seen; a run that stops takes up after the last one. With ``high_water``,
    only entries above the greatest ``order`` that the slice has are looked
    at: right for entries whose order only grows. A null key is no entry.
    """
    spark = entries.sparkSession
    rest = [order, *[c for c in entries.columns if c not in (key, order)]]
    part = F.pmod(F.xxhash64(key), F.lit(slices))
    written = 0
    for k in range(slices):
        new = entries.where(F.col(key).isNotNull() & (part == k))
        where = f"{path}/slice={k}"
        if exists(spark, where):
            seen = spark.read.parquet(where)
            if high_water:
                top = seen.agg(F.max(order)).first()[0]
                new = new if top is None else new.where(F.col(order) > top)
            new = new.join(seen.select(key), key, "left_anti")
        first = new.groupBy(key).agg(F.min(F.struct(*rest)).alias("first_"))
        first = first.select(*[F.col(c) if c == key else F.col(f"first_.{c}").alias(c) for c in entries.columns])
        if not first.isEmpty():
            first.write.mode("append").parquet(where)
            written += 1
    return written


def read_ingested(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("slice")
