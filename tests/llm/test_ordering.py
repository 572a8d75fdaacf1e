import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from talus.llm.ordering import encoder, feistel, read_from, records_of, shards, write_shards


@pytest.mark.parametrize("size", [1, 2, 3, 17, 1000, 4097])
def test_feistel_is_a_bijection(size):
    a = feistel(np.arange(size), size, 7)
    assert sorted(a.tolist()) == list(range(size))
    if size > 100:
        assert (a != feistel(np.arange(size), size, 8)).any()


ROWS = [(i, ("word%d " % (i % 7)) * (i * 3 % 40)) for i in range(60)] + [(60, None), (61, ""), (5, "other"), (5, "other"), (2**53 + 1, "big id"), (None, "x y")]


def expected(spark, rows, key, seq_len, path):
    """Slot -> (doc_id, seq_no, n_tokens, record), number by number in plain Python."""
    encode, end = encoder(path)
    hashed = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.xxhash64("text").alias("t")).collect()
    numbered = []
    for r in sorted(hashed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.t)):
        ids = [int(x) for x in encode(r.text or "")] + [end]
        for n, k in enumerate(range(0, len(ids), seq_len)):
            part = ids[k : k + seq_len]
            numbered.append((r.doc_id, n, len(part), np.asarray(part + [end] * (seq_len - len(part)), np.uint16).tobytes()))
    slots = feistel(np.arange(len(numbered)), len(numbered), key)
    return dict(zip(slots.tolist(), numbered))


@pytest.mark.parametrize("path", [None, "/opt/tokenizers/byte_bpe_50k.tiktoken"])
def test_every_sequence_stands_in_its_slot(spark, tmp_path, path):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("slot", F.lit("clash"))
    how = {"key": 3, "tokenizer": path, "seq_len": 16, "records": 10}
    out = str(tmp_path / "shards")
    made = write_shards(df, out, **how)
    rows = sorted(made.collect(), key=lambda r: r.shard)
    want = expected(spark, ROWS, 3, 16, path)
    got = {r.first_slot + i: (r.doc_ids[i], r.seq_nos[i], r.n_tokens[i], bytes(r.payload[i * 32 : i * 32 + 32])) for r in rows for i in range(r.records)}
    assert got == want
    assert [r.first_slot for r in rows] == [10 * i for i in range(len(rows))]
    assert all(r.records == 10 for r in rows[:-1])
    recs = records_of(made).orderBy("slot").collect()
    assert [(r.slot, r.doc_id, r.crc) for r in recs] == [(s, want[s][0], zlib.crc32(want[s][3])) for s in sorted(want)]
    assert read_from(spark, out, 25, 10).select("shard").first()[0] == 2
    again = {r.shard: bytes(r.payload) for r in shards(df.repartition(3), **how).collect()}
    assert again == {r.shard: bytes(r.payload) for r in rows}


def test_stopped_runs_are_taken_up(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    how = {"key": 3, "seq_len": 16, "records": 10}
    whole, part = str(tmp_path / "whole"), str(tmp_path / "part")
    rows = {r.shard: r for r in write_shards(df, whole, **how).collect()}
    spark.read.parquet(whole).where("shard in (0, 3)").write.parquet(part)
    got = write_shards(df, part, **how).collect()
    assert len(got) == len(rows) and {r.shard: r for r in got} == rows
    for other in ({**how, "key": 4}, {**how, "seq_len": 32}):
        with pytest.raises(ValueError):
            write_shards(df, part, **other)
    with pytest.raises(ValueError):
        write_shards(df.where("doc_id <> 7"), part, **how)


def test_empty(spark):
    assert shards(spark.createDataFrame([], "doc_id long, text string")).collect() == []
