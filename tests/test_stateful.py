"""State processors: equal to the batch form across restarts, and empty of what has expired."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from talus.operators.events import fixed_window_limit
from talus.streaming import stateful
from talus.streaming.views import event_stream

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def rocksdb(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stateful.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


class Feed:
    """A stream over files that are added between runs; every run restarts from the checkpoint."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema = spark, str(folder), schema

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")

    def run(self, make, mode="append"):
        df = make(event_stream(self.spark, f"{self.folder}/in", self.schema))
        q = df.writeStream.format("parquet").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/cp").outputMode(mode).trigger(availableNow=True).start()
        assert q.awaitTermination(90)
        return self.spark.read.parquet(f"{self.folder}/out")

    def state(self, name):
        return self.spark.read.format("statestore").option("stateVarName", name).load(f"{self.folder}/cp").count()


def test_rate_limit_over_restarts(spark, tmp_path):
    r = random.Random(1)
    rows = [(r.choice(["hot", "hot", "a", "b", None]), T0 + dt.timedelta(seconds=r.randint(0, 5000)), i) for i in range(600)]
    rows.sort(key=lambda x: x[1] + dt.timedelta(seconds=r.randint(0, 200)))  # out of order by less than the watermark's delay
    feed = Feed(spark, tmp_path, "k string, ts timestamp, id long")
    make = lambda s: stateful.rate_limited(s, "k", "ts", "id", 300_000_000, 7, "250 seconds")
    for part in (rows[:200], rows[200:350], rows[350:], [("last", T0 + dt.timedelta(hours=9), 10_000)], [("last", T0 + dt.timedelta(hours=9), 10_001)]):
        feed.add(part)
        got = feed.run(make)
    batch = spark.createDataFrame(rows, feed.schema).withColumn("t", F.unix_micros("ts"))
    want = fixed_window_limit(batch, "k", "t", "id", 300_000_000, 7).select("k", "id", "window_count", "allowed")
    found = [tuple(x) for x in got.select("k", "id", "window_count", "allowed").collect()]
    assert sorted(found) == sorted(map(tuple, want.collect())) and len(found) == sum(k is not None for k, _, _ in rows)
    assert feed.state("window") == 0  # every window has ended
    assert feed.state("pending") == 1  # the last key's slot waits for a later watermark


def test_unique_viewers_over_restarts_and_expiry(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # a clock always has more batches to run
    feed = Feed(spark, tmp_path, "card long, viewer string")
    make = lambda s: stateful.unique_viewers(s, "card", "viewer")
    feed.add([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (None, "a"), (1, None)])
    assert feed.run(make).count() == 3
    feed.add([(1, "a"), (2, "b"), (2, "b")])
    assert sorted(map(tuple, feed.run(make).collect())) == [(1, "a"), (1, "b"), (2, "a"), (2, "b")]
    short = Feed(spark, tmp_path / "short", feed.schema)
    expiring = lambda s: stateful.unique_viewers(s, "card", "viewer", ttl_ms=1)
    short.add([(1, "a")])
    short.run(expiring)
    short.add([(1, "a"), (3, "c")])
    assert short.run(expiring).count() == 3  # a is new again
    assert short.state("seen") <= 2


def test_retained_rows_end(spark, tmp_path):
    day = dt.timedelta(days=1)
    feed = Feed(spark, tmp_path, "s string, ts timestamp, v string")
    make = lambda x: stateful.retained(x, "s", "ts", "v", 90, "1 day")
    feed.add([("x", T0, "1"), ("x", T0 + day, "2"), ("y", T0, "3"), (None, T0, "4")])
    feed.run(make)
    feed.add([("y", T0 + 60 * day, "5"), ("x", T0 - 0.5 * day, "0")])
    feed.run(make)
    feed.add([("z", T0 + 120 * day, None)])
    feed.run(make)
    feed.add([("z", T0 + 121 * day, "6")])
    got = feed.run(make)
    assert sorted((r.s, r.v) for r in got.where("expired").collect()) == [("x", "2")]
    assert feed.state("row") == 2  # y, renewed after 60 days, and z
