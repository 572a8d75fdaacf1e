"""Operator 1: training-order materialisation of token sequences.

Documents become token sequences of at most ``seq_len`` tokens. The sequences
are numbered in document order, a keyed Feistel permutation with cycle-walking
maps each number to a slot of the training order, and range partitions of the
slots write shards of records of one fixed stride, so that a reader starts
anywhere by arithmetic alone.
"""

from __future__ import annotations

import base64
import uuid
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm.common import BROADCAST_BYTES, arrow_schema, mix64, parts_for, scratch_dir, slices, table, write_table

# Fixed value: the split pattern that goes with these ranks.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEQ_LEN = 512
RECORDS = 4096
BATCH = 256  # documents that a task returns at a time
WIDTH = 2  # bytes of a token: little-endian, unsigned
SHARD_SCHEMA = (
    "order_id long, shard long, first_slot long, records int, stride int, payload binary,"
    " doc_ids array<long>, seq_nos array<int>, n_tokens array<int>"
)


@lru_cache(1)
def encoder(path: str | None):
    """(function from text to token ids, id of the end token) for a file of byte-level BPE ranks; None: a token per byte."""
    if path is None:
        return (lambda text: np.frombuffer(text.encode("utf-8", "replace"), np.uint8)), 256
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return own.encode_ordinary, max(ranks.values()) + 1


def feistel(index: np.ndarray, size: int, key: int, rounds: int = 6) -> np.ndarray:
    """Bijection of 0 .. size - 1: balanced Feistel rounds, walked until inside the range."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    shift, mask = np.uint64(half), np.uint64((1 << half) - 1)
    keys = mix64(np.arange(1, rounds + 1, dtype=np.uint64) + mix64(np.array([key & (2**64 - 1)], np.uint64)))
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix64(right + k) & mask)
        out[todo] = left << shift | right
        todo = todo[out[todo] >= np.uint64(size)]
    return out.astype(np.int64)


def tokenised(docs: DataFrame, path: str | None) -> DataFrame:
    """(doc_id, t, tokens, n): the tokens of each whole text and an end token; t is a hash of the text."""

    def run(batches):
        encode, end = encoder(path)
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                part = batch.slice(k, BATCH)
                tokens = [np.append(np.asarray(encode(x or ""), np.uint16), np.uint16(end)).tobytes() for x in part["text"].to_pylist()]
                columns = {"doc_id": part["doc_id"], "t": part["t"], "tokens": tokens, "n": [len(x) // WIDTH for x in tokens]}
                yield pa.RecordBatch.from_pydict(columns, arrow_schema(shape))

    shape = "doc_id long, t long, tokens binary, n long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t"))
    return rows.mapInArrow(run, shape)


def first_numbers(rows: DataFrame, order: list[str], weight: str, key: str) -> tuple[DataFrame, int]:
    """Running totals of ``weight`` in a total order: (rows of ``key``, ``weight`` and ``first``; grand total).

    Range partitions sum up alone; only one total per partition reaches the driver.
    """

    def run(batches):
        total = 0
        for pdf in batches:
            sums = pdf[weight].cumsum()
            yield pdf.assign(first=sums - pdf[weight] + total)
            total += int(sums.iloc[-1]) if len(sums) else 0

    parts = parts_for(rows.count(), 64)
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(key, weight, F.spark_partition_id().alias("part"))
    shape = ", ".join(f"{c} {k}" for c, k in ranged.dtypes) + ", first long"
    local = write_table(ranged.mapInPandas(run, shape), "numbers")
    totals = local.groupBy("part").agg(F.sum(weight)).collect()
    before, at = {}, 0
    for part, total in sorted(totals):
        before[part] = at
        at += total
    if not before:
        return local.drop("part"), 0
    offsets = rows.sparkSession.createDataFrame(list(before.items()), "part int, before long")
    placed = local.join(F.broadcast(offsets), "part")  # one row per range partition
    return placed.withColumn("first", F.col("first") + F.col("before")).drop("part", "before"), at


#: Join keys need not all be bucket keys: rows bucketed by task stay where they are.
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


def by_task(rows: DataFrame, tasks: int, tag: str) -> DataFrame:
    """``rows`` (with rid, a monotonically increasing id) written to the scratch folder in buckets by the task that made them, and read again.

    A task writes one file, and a later join by (part, rid) moves only the
    other side. Two buckets per task keep most tasks apart.
    """
    spark = rows.sparkSession
    name = f"talus_{tag}_{uuid.uuid4().hex}"
    placed = rows.withColumn("part", F.shiftright("rid", 33).cast("int"))
    writer = placed.write.bucketBy(min(2 * tasks, 50_000), "part").option("compression", "zstd")
    writer.option("path", f"{scratch_dir(spark)}/talus/{name}").saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved: the files stay when the name goes
    spark.sql(f"DROP TABLE {name}")
    return out


def shards(
    docs: DataFrame,
    key: int = 20_240_917,
    tokenizer: str | None = None,
    seq_len: int = SEQ_LEN,
    records: int = RECORDS,
    done: DataFrame | None = None,
) -> DataFrame:
    """One row per shard of the training order, see SHARD_SCHEMA.

    Record r of shard s is slot s * records + r; it holds seq_len tokens of
    two bytes, padded with end tokens; doc_ids, seq_nos and n_tokens tell
    where a record came from and how many of its tokens are real. Sequences
    are numbered by doc_id (nulls first), then a hash of the text, then place
    in the text, so that the order depends on the rows and the key alone
    (repeated rows are alike and take neighbouring numbers). A null or empty
    text is one end token; long texts are cut into sequences and nothing is
    dropped. An empty table gives no shards; other columns are ignored.
    ``tokenizer`` is a file of byte-level BPE ranks that all executors can
    read; None gives a token per byte. ``done`` are shards made before, which
    are left out; they must be of the same order (rows, key, tokenizer and
    sizes), or a ValueError is raised.
    """
    stride = seq_len * WIDTH
    rows = tokenised(docs, tokenizer).withColumn("rid", F.monotonically_increasing_id())
    rows = by_task(rows.withColumn("n_seq", F.ceil(F.col("n") / seq_len)), docs.rdd.getNumPartitions(), "tokens")
    numbers, total = first_numbers(rows.select("rid", "doc_id", "t", "n_seq"), ["doc_id", "t", "rid"], "n_seq", "rid")
    content = rows.agg(F.sum(F.xxhash64("doc_id", "t", "n").cast("decimal(38,0)"))).first()[0]
    order_id = xxhash.xxh3_64_intdigest(repr((key, tokenizer, seq_len, records, total, content)).encode()) >> 1
    if done is not None and not done.where(F.col("order_id") != order_id).isEmpty():
        raise ValueError("the shards made before are of another order: rows, key, tokenizer or sizes differ")

    def permute(batches):
        for pdf in batches:
            n = pdf["n_seq"].to_numpy(np.int64)
            ends = np.cumsum(n)
            index = np.repeat(pdf["first"].to_numpy(np.int64) - ends + n, n) + np.arange(n.sum())
            slots = np.split(feistel(index, total, key), ends[:-1]) if len(n) else []
            yield pd.DataFrame({"rid": pdf["rid"], "slots": [s.tolist() for s in slots]})

    slots = write_table(numbers.select("rid", "first", "n_seq").mapInPandas(permute, "rid long, slots array<long>"), "slots")
    slots = slots.withColumn("part", F.shiftright("rid", 33).cast("int"))
    few = 128 * slots.count() + 16 * total <= BROADCAST_BYTES
    slots = F.broadcast(slots) if few else slots.hint("shuffle_hash")  # a bucket's numbers, at most those of one or two input splits
    placed = rows.join(slots, ["part", "rid"]).select("doc_id", "tokens", "n", F.posexplode("slots").alias("seq_no", "slot"))
    placed = placed.select(
        "slot",
        F.col("doc_id").cast("string").alias("doc_id"),  # exact beside nulls
        "seq_no",
        F.least(F.lit(seq_len), F.col("n") - F.col("seq_no") * seq_len).cast("int").alias("n_tokens"),
        F.expr(f"substring(tokens, seq_no * {stride} + 1, {stride})").alias("record"),
    )
    placed = placed.withColumn("shard", F.floor(F.col("slot") / records))
    if done is not None:
        placed = placed.join(F.broadcast(done.select("shard").distinct()), "shard", "left_anti")  # 8 bytes for each ``records`` sequences
    placed = placed.repartitionByRange(parts_for(total, stride), "shard").sortWithinPartitions("slot")
    end = encoder(tokenizer)[1]

    def write(batches):
        pad = np.uint16(end).tobytes()
        for g in slices(batches, ["shard"]):
            payload = b"".join(r + pad * ((stride - len(r)) // WIDTH) for r in g["record"])
            yield pd.DataFrame(
                {
                    "order_id": [order_id],
                    "shard": [int(g["shard"][0])],
                    "first_slot": [int(g["slot"][0])],
                    "records": [len(g["slot"])],
                    "stride": [stride],
                    "payload": [payload],
                    "doc_ids": [[None if d is None else int(d) for d in g["doc_id"]]],
                    "seq_nos": [g["seq_no"].tolist()],
                    "n_tokens": [g["n_tokens"].tolist()],
                }
            )

    return placed.mapInPandas(write, SHARD_SCHEMA)


def write_shards(docs: DataFrame, path: str, **how) -> DataFrame:
    """Write the shards that ``path`` does not hold yet and read all of them; ``how`` as for :func:`shards`.

    A stopped run is taken up after the last job that was committed; shards
    of another order in ``path`` raise a ValueError and nothing is written.
    """
    spark = docs.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    done = spark.read.schema(SHARD_SCHEMA).parquet(path).select("order_id", "shard") if there else None
    before = spark.conf.get(CO_PARTITION)
    spark.conf.set(CO_PARTITION, "false")
    try:
        shards(docs, done=done, **how).write.mode("append").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CO_PARTITION, before)
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def records_of(made: DataFrame) -> DataFrame:
    """One row per record: slot, shard, record, doc_id, seq_no, n_tokens, crc (of the record's bytes)."""
    each = made.select(
        "shard", "first_slot", "stride", "payload", F.posexplode(F.arrays_zip("doc_ids", "seq_nos", "n_tokens")).alias("record", "r")
    )
    return each.select(
        (F.col("first_slot") + F.col("record")).alias("slot"),
        "shard",
        "record",
        F.col("r.doc_ids").alias("doc_id"),
        F.col("r.seq_nos").alias("seq_no"),
        F.col("r.n_tokens").alias("n_tokens"),
        F.expr("crc32(substring(payload, record * stride + 1, stride))").alias("crc"),
    )


def read_from(spark: SparkSession, path: str, slot: int, records: int = RECORDS) -> DataFrame:
    """Shards from the one that holds ``slot`` on, in order: where a reader resumes."""
    return spark.read.schema(SHARD_SCHEMA).parquet(path).where(F.col("shard") >= slot // records).orderBy("shard")


#: The tokenizer of the registered query.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op1_training_order(spark: SparkSession, sf_dir: str, tokenizer: str | None = TOKENIZER) -> DataFrame:
    """The records of the shards of all documents in training order, from shards written to the scratch folder."""
    path = f"{scratch_dir(spark)}/talus/shards-{uuid.uuid4().hex}"
    return records_of(write_shards(table(spark, sf_dir, "documents"), path, tokenizer=tokenizer))
