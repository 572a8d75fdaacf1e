"""Archives against a plain rule, gzip and the exact round trip; the merge against a sort."""

import glob
import gzip
import hashlib
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from talus.llm import warc

SCHEMA = "page_id long, url string, html string"


def brute(rows):
    groups = {}
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r[:2])
    for r in rows:
        groups.setdefault(r[2] or "", []).append(r)
    out = []
    for html, same in groups.items():
        data = html.encode()
        first = max(same, key=key)
        for r in same:
            again = len(data) >= 1000 and r[:2] != first[:2] and first[0] is not None
            out.append((r[0], len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", first[0] if again else None))
    return sorted(out, key=repr)


def op(spark, rows, folder):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for clash in ("payload", "captured", "original", "same", "run", "digest", "pos"):
        df = df.withColumn(clash, F.lit(1))
    df.write.mode("overwrite").parquet(f"{folder}/pages.parquet")
    got = warc.op12_warc_archive(spark, str(folder))
    assert got.columns[:5] == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return sorted((tuple(r)[:5] for r in got.collect()), key=repr)


ODD = [
    (1, "http://a.org/\r\nWARC-Type: x", "x" * 1000), (2, None, "x" * 1000), (3, "", "x" * 999), (4, "u", "x" * 999), (5, "u", None), (6, "u", ""),
    (7, "http://b.org", "é" * 500), (8, "http://b.org", "é" * 500), (8, "http://b.org", "é" * 500), (8, "http://a.org", "é" * 500),
    (None, "n", "y" * 2000), (None, "m", "y" * 2000), (9, "z", "\r\n\r\nWARC/1.1\r\n\x1f\x8b\x08\x00" * 400), (10, "z", "long " * 400_000), (-3, "z", "w" * 1500), (None, None, "w" * 1500),
]


def test_odd_rows(spark, tmp_path):
    assert op(spark, ODD, tmp_path) == brute(ODD)


def test_many_copies_by_either_join(spark, tmp_path, monkeypatch):
    r = random.Random(3)
    texts = ["t" * 1200, "s" * 1500, "short", None] + [str(k) * 1100 for k in range(10, 60)]
    rows = [(i, f"http://h{r.randint(0, 3)}.org/{i % 7}", texts[0] if i % 3 == 0 else r.choice(texts)) for i in range(800)]
    want = brute(rows)
    assert op(spark, rows, tmp_path) == want
    monkeypatch.setattr(warc, "sized", lambda df, size: df.select("*"))
    monkeypatch.setattr(warc, "HOT", 0.1)
    assert op(spark, rows, tmp_path) == want


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op12_warc_archive(spark, str(tmp_path)).collect() == []


def test_archives_are_gzip_and_payloads_come_back(spark, tmp_path):
    rows = [(i, f"http://www.h{i % 5}.org:80/P?b={i}&a=1#x", f"<p>{i}</p>" * (i % 40)) for i in range(300)] + ODD
    captures = warc.page_captures(spark.createDataFrame(rows, SCHEMA))
    path = f"{tmp_path}/archives"
    warc.write_archives(captures, path, archive_bytes=5_000)
    files = glob.glob(f"{path}/run=*/part-*")
    assert len(files) > 4
    text = b"".join(gzip.decompress(open(f, "rb").read()) for f in files)
    assert text.count(b"WARC-Record-ID: ") == len(rows)
    got = warc.read_archives(spark, path).collect()
    full = [(r.page_id, bytes(r.payload).decode()) for r in got if r.record_type == "response"]
    want = [(b[0], b[1], b[2]) for b in brute(rows) if b[3] == "response"]
    assert sorted(((i, len(p.encode()), hashlib.sha1(p.encode()).hexdigest()) for i, p in full), key=repr) == sorted(want, key=repr)
    for r in got[::20]:  # a record by its offset alone
        name = r.run.removeprefix("file:")
        with open(name, "rb") as f:
            f.seek(r.offset)
            fields, body = warc.parse(gzip.decompress(f.read(r.length)))
        assert fields["warc-record-id"] == r.record_id


def test_index_is_in_order(spark, tmp_path, monkeypatch):
    rows = [(i, "http://hot.org/a" if i % 3 else f"http://h{i % 11}.net/{i % 2}", f"{i}") for i in range(500)]
    path = f"{tmp_path}/archives"
    warc.write_archives(warc.page_captures(spark.createDataFrame(rows, SCHEMA).repartition(6)), path, archive_bytes=2_000)
    monkeypatch.setattr(warc, "parts_for", lambda n, size: 7)
    index = warc.merged(warc.read_archives(spark, path, payload=False)).orderBy("pos").collect()
    assert [r.pos for r in index] == list(range(500))
    keys = [warc.capture_order(r.asDict()) for r in index]
    assert keys == sorted(keys)


def test_damaged_archive():
    data = warc.gzipped(warc.record(1, "u", "2024-01-01T00:00:00Z", b"abc", hashlib.sha1(b"abc").hexdigest(), None))
    with pytest.raises(ValueError):
        list(warc.members(data[:-9]))
    with pytest.raises(ValueError):
        warc.parse(b"GET / HTTP/1.1\r\n\r\n")


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    r = random.Random(k)
    runs = [sorted((r.randint(0, 30), j) for j in range(r.randint(0, 20))) for _ in range(k)]
    assert list(warc.LoserTree(runs)) == sorted(x for run in runs for x in run)


def test_url_keys():
    assert warc.url_key("HTTP://www.Example.org:80/A?b=2&A=1#top") == "org,example)/a?a=1&b=2"
    assert warc.url_key("https://m.a.net:8080") == "net,a,m:8080)/"
    assert warc.url_key("urn:page:7") == "urn:page:7"
    assert warc.url_key("http://[bad") == "http://[bad"


def test_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got = warc.op12_warc_archive(spark, folder)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(con.sql(warc.ORACLE).select(*got.columns).fetchall(), key=repr)
