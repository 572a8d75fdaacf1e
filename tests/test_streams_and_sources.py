import glob
import json
import random

import pytest
from pyspark.sql import functions as F

from talus.sources import files, tables
from talus.sources.tables import KeyedTable
from talus.streaming import views


def test_buffer_and_storefront(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.json").write_text(json.dumps([{"name": "a", "price": 3.5, "extra": 1}, {"isReviewed": True}, {}]))
    assert sorted((r.name or "", r.isReviewed) for r in files.read_buffer(spark, str(tmp_path / "b")).collect()) == [("", True), ("a", None)]
    (tmp_path / "s").mkdir()
    for k in range(2):
        page = {"products": [{"id": k, "title": f"t{k}", "variants": [{"id": 1, "price": "n/a"}, {"id": 2, "price": "12.50"}]}]}
        (tmp_path / "s" / f"{k}.json").write_text(json.dumps(page))
    got = files.read_storefront(spark, str(tmp_path / "s")).select("id", files.variant_price(F.col("variants")).alias("p")).collect()
    assert sorted((r.id, r.p) for r in got) == [(0, 12.5), (1, 12.5)]


def test_seed_and_append(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    path = str(tmp_path / "t")
    v = files.seed(spark, rows, path, None)
    assert files.content_version(rows.orderBy(F.desc("id")).repartition(3)) == v
    assert files.content_version(rows.withColumn("x", F.upper("x"))) != v
    files.append_new(spark, spark.createDataFrame([(2, "z"), (3, "c")], "id int, x string"), path, ["id"])
    assert sorted(r.x for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]
    assert files.incremental(rows, "id", 1).count() == 1
    brands = spark.createDataFrame([(2, "Acme"), (1, "ACME Pro")], "id int, name string")
    assert files.find_brand(brands, "acme").first().id == 1


def run(df, mode="append", batch=None, name="out"):
    w = df.writeStream.outputMode(mode).trigger(availableNow=True)
    q = (w.foreachBatch(batch) if batch else w.format("memory").queryName(name)).start()
    q.awaitTermination()


def stream(spark, tmp_path, rows, schema):
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return views.event_stream(spark, str(tmp_path / "in"), schema)


def test_first_views(spark, tmp_path):
    schema = "card int, viewer string, ts timestamp"
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    s = stream(spark, tmp_path, [[(1, "a", t), (1, "a", t)], [(1, "b", t), (1, "a", t)]], schema)
    run(views.first_views(s, "card", "viewer", "ts", "1 hour"), name="first_views")
    assert spark.table("first_views").count() == 2


def test_latest_sink(spark, tmp_path):
    schema = "id int, v string, at int"
    s = stream(spark, tmp_path, [[(1, "old", 1), (1, "new", 2), (2, "x", 1)]], schema)
    sink = views.latest_sink(spark, str(tmp_path / "out"), ["id"], "at", 4)
    run(s, batch=sink)
    sink(spark.createDataFrame([(1, "newer", 3)], schema), 0)  # a replay of batch 0 changes nothing
    assert sorted((r.id, r.v) for r in KeyedTable(spark, str(tmp_path / "out"), ["id"], "at", 4).read().collect()) == [(1, "new"), (2, "x")]


def test_upsert_touches_only_its_buckets(spark, tmp_path):
    schema = "id int, v string, at int"
    t = KeyedTable(spark, str(tmp_path / "t"), ["id"], "at", 8)
    r = random.Random(2)
    rows = [(r.choice([None, *range(40)]), r.choice([None, "a", "b"]), r.randint(0, 50)) for _ in range(300)]
    files_now = lambda: {f for f in glob.glob(f"{tmp_path}/t/data/bucket=*/*.parquet")}
    assert t.upsert(spark.createDataFrame(rows[:200], schema), 0)
    before = files_now()
    assert t.upsert(spark.createDataFrame([(7, "late", -1), (7, "new", 99)], schema), 1)
    after = files_now()
    assert len(before) == len(after) == 8 and len(before - after) == 1  # one bucket is new, the others keep their files
    assert not t.upsert(spark.createDataFrame([(8, "never", 100)], schema), 1) and files_now() == after
    assert t.upsert(spark.createDataFrame(rows[200:], schema), 2) and t.done() == [0, 1, 2]
    best = {}
    for row in [*rows, (7, "late", -1), (7, "new", 99)]:
        best[row[0]] = max(best.get(row[0], (-9, False, "")), (row[2], row[1] is not None, row[1] or ""))
    assert {x.id: (x.at, x.v is not None, x.v or "") for x in t.read().collect()} == best


def test_ingest_resumes_after_a_stop(spark, tmp_path):
    rows = [(i, None if i % 3 else i // 2, f" Title {i % 11} ") for i in range(200)]
    df = spark.createDataFrame(rows, "pos int, item int, title string").withColumn("key", tables.cache_key(F.col("item"), F.col("title")))
    path = str(tmp_path / "t")

    class Stop(Exception):
        pass

    real, calls = tables.exists, []

    def failing(spark, where):  # stops at the fourth slice
        calls.append(where)
        if len(calls) == 4:
            raise Stop
        return real(spark, where)

    tables.exists = failing
    try:
        with pytest.raises(Stop):
            tables.ingest(df, "key", "pos", path)
    finally:
        tables.exists = real
    assert 0 < tables.read_ingested(spark, path).count()
    tables.ingest(df, "key", "pos", path)
    assert tables.ingest(df, "key", "pos", path) == 0
    want = {}
    for pos, item, title in rows:
        want.setdefault(f"item:{item}" if item is not None else f"title:{title.strip().lower()}", pos)
    assert {r.key: r.pos for r in tables.read_ingested(spark, path).collect()} == want
    assert tables.read_ingested(spark, path).count() == len(want)
    more = df.withColumn("pos", F.col("pos") + 1000).withColumn("key", F.concat("key", F.lit("'")))
    tables.ingest(df.unionByName(more), "key", "pos", path, high_water=True)
    assert tables.read_ingested(spark, path).count() == 2 * len(want)
