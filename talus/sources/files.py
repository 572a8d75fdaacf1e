"""Sources and sinks: tolerant JSON buffers, storefront feeds, upserts into written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.operators.catalog import insert_ignore, latest_wins
from talus.operators.postings import containing

#: Columns that every review-buffer entry may have; other fields are ignored.
BUFFER_SCHEMA = (
    "sourceUrl string, name string, price double, coverImage string, genderHint string,"
    " rawDescription string, imagePlaceholder string, isReviewed boolean"
)


def read_buffer(spark: SparkSession, path: str) -> DataFrame:
    """Entries of JSON-array files, each file read whole; an entry that does not parse is dropped alone, missing fields are null.

    A file that is no JSON array at all gives no entries.
    """
    texts = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    entries = texts.select(F.explode(F.from_json("value", "array<string>")).alias("entry"))
    rows = entries.select(F.from_json("entry", BUFFER_SCHEMA.replace(" ", ":").replace(",:", ", ").join(("struct<", ">")), {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    return rows.where(F.coalesce(*[F.col(f.split()[0]).cast("string") for f in BUFFER_SCHEMA.split(", ")]).isNotNull())


def write_buffer(rows: DataFrame, path: str, entries: int = 10_000) -> None:
    """Rows as JSON-array files of about ``entries`` each, as :func:`read_buffer` takes them."""
    blocks = max(1, -(-rows.count() // entries))
    block = F.pmod(F.xxhash64(*rows.columns, F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("block")
    arrays = rows.select(block, F.struct(*rows.columns).alias("r")).groupBy("block").agg(F.to_json(F.collect_list("r")).alias("value"))
    arrays.write.mode("overwrite").partitionBy("block").text(path)


def read_storefront(spark: SparkSession, path: str) -> DataFrame:
    """One row per product of paged feeds: files of {"products": [...]}; id, title, handle, variants."""
    schema = "products array<struct<id:bigint,title:string,handle:string,tags:array<string>,variants:array<struct<id:bigint,price:string>>>>"
    pages = spark.read.schema(schema).json(path, multiLine=True)
    return pages.select(F.explode("products").alias("p")).select("p.*")


def variant_price(variants: "F.Column") -> "F.Column":
    """Price of the first variant that has one, else null."""
    prices = F.transform(variants, lambda v: F.try_to_number(v["price"], F.lit("999999999.99")).cast("double"))
    return F.get(F.filter(prices, lambda p: p.isNotNull()), F.lit(0))


def upsert_latest(target: DataFrame, new: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """Target after an upsert by unique key in which the newest row wins."""
    return latest_wins(target.unionByName(new), keys, [F.desc_nulls_last(newest)])


def append_new(spark: SparkSession, new: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose key the table does not hold yet (insert or ignore); the table may not exist. One writer at a time."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        new = insert_ignore(spark.read.parquet(path), new, keys).select(new.columns)
    else:
        new = new.dropDuplicates(keys)
    new.write.mode("append").parquet(path)


def append_events(new: DataFrame, path: str) -> None:
    """Plain append of event rows."""
    new.write.mode("append").parquet(path)


def content_version(rows: DataFrame) -> str:
    """SHA-256 over the number of rows and the sums of their hashes' words: equal content in any order, equal version.

    The sums are combined within the tasks; no rows are brought together.
    """
    hashed = rows.select(F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256).alias("h"))
    words = [F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)") for i in range(8)]
    sums = hashed.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(w), F.lit(0)).alias(f"w{i}") for i, w in enumerate(words)])
    return sums.select(F.when(F.col("n") == 0, "").otherwise(F.sha2(F.concat_ws(",", "n", *[f"w{i}" for i in range(8)]), 256))).first()[0]


def seed(spark: SparkSession, rows: DataFrame, path: str, known: str | None) -> str:
    """Replace a table by a seed unless its version is the known one; returns the version."""
    version = content_version(rows)
    if version != known:
        rows.write.mode("overwrite").parquet(path)
    return version


def incremental(rows: DataFrame, id_: str, high_water) -> DataFrame:
    """Rows above the last id that was read: the incremental form of a keyset scan."""
    return rows if high_water is None else rows.where(F.col(id_) > high_water)


def find_brand(brands: DataFrame, name: str) -> DataFrame:
    """Case-insensitive lookup of a brand by part of its name; the least id wins."""
    return brands.where(F.contains(F.lower("name"), F.lit(name.lower()))).orderBy("id").limit(1)


def find_brands(brands: DataFrame, wanted: DataFrame) -> DataFrame:
    """(q, id) of many lookups at once: the least id whose name contains ``q``, in any case; without a hit no row."""
    q = wanted.select(F.lower("q").alias("low")).distinct()
    met = containing(q, "low", brands.groupBy(F.lower("name").alias("name")).agg(F.min("id").alias("id")), "name")
    return met.groupBy("low").agg(F.min("id").alias("id")).select(F.col("low").alias("q"), "id")
