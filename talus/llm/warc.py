"""WARC archives: records written and read by Spark tasks, and a merged capture index.

A task turns captures into records, one gzip member each, and cuts its stream
into archives of bounded size. Of captures with equal payloads one is kept in
full and the others are ``revisit`` records that name it. The archives are
read back by tasks that parse members one by one; the captures of an archive
leave such a task sorted by URL key and time. Runs sorted like this are then
merged: ranges of the order are dealt to tasks, and within a task a loser tree
merges the pieces of its runs, which gives one globally ordered index.

Archives are ordinary ``.warc.gz`` content (Spark's text writer names them
``part-*.txt``): a member per record, and an empty member as the writer's
separator, which readers of gzip skip. Writing goes through Spark's committer,
so a lost executor leaves no half archive behind.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm.common import HOT, drop_table, join_unique, parts_for, scratch_dir, sized, table, write_table

#: Payloads of fewer bytes are never replaced by a revisit.
MIN_REVISIT = 1000
#: An archive is closed after this many compressed bytes; the record that crosses it is its last.
ARCHIVE_BYTES = 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"


def gzipped(data: bytes) -> bytes:
    """One gzip member with a fixed header."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


SEPARATOR = gzipped(b"")


def record_id(page_id: int | None, url: str | None, captured: str, digest: str) -> str:
    """The same capture always has the same record id."""
    seed = hashlib.sha1("\0".join(map(repr, (page_id, url, captured, digest))).encode("utf-8", "surrogatepass")).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=seed[:16], version=5)}>"


def target(url: str | None, page_id: int | None) -> str:
    """A URL fit for a header: characters that would break the line are percent-encoded; without a URL, a name from the page id."""
    if not url:
        return f"urn:page:{'' if page_id is None else page_id}"
    return re.sub(r"[\x00-\x20\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def record(page_id: int | None, url: str | None, captured: str, payload: bytes, digest: str, original: str | None) -> bytes:
    """A WARC/1.1 record; ``original`` is the record id that a revisit names."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if original else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if original else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, url, captured, digest)}",
        f"WARC-Date: {captured}",
        f"WARC-Target-URI: {target(url, page_id)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    if original:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {original}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + CRLF * 2 + block + CRLF * 2


def members(content: bytes, step: int = 1 << 16) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and data of the members of a gzip file, empty ones left out."""
    view, at = memoryview(content), 0
    while at < len(view):
        unpacker, end, data = zlib.decompressobj(31), at, []
        while not unpacker.eof:
            if end >= len(view):
                raise ValueError("archive ends inside a record")
            data.append(unpacker.decompress(view[end : end + step]))
            end += step
        end = min(end, len(view)) - len(unpacker.unused_data)
        whole = b"".join(data)
        if whole:
            yield at, end - at, whole
        at = end


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the HTTP body, of one record."""
    head, _, rest = data.partition(CRLF * 2)
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    size = int(fields["content-length"])
    if rest[size:] != CRLF * 2:
        raise ValueError("record length differs from its header")
    return fields, rest[:size].partition(CRLF * 2)[2]


def url_key(url: str) -> str:
    """Sort key of a URL: host parts reversed and joined by commas, ``www.`` and default ports left out, path and sorted query in lower case."""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname, parts.port
    except ValueError:
        return url.strip().lower()
    if not host:
        return url.strip().lower()
    names = host.removeprefix("www.").split(".")
    port = "" if port in (None, 80, 443) else f":{port}"
    query = "&".join(sorted(q for q in parts.query.lower().split("&") if q))
    return f"{','.join(reversed(names))}{port}){parts.path.lower() or '/'}{'?' + query if query else ''}"


# -- writing ------------------------------------------------------------------


def with_original(captures: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """``captures`` (page_id, url, captured, payload) with n_bytes, digest and ``original``: page_id, url and captured of the capture to name, null where it is that one or none.

    Of equal payloads of ``min_bytes`` or more, the original is the capture of
    the largest page id, then url, then time (nulls first); captures equal in
    all three are alike and all of them originals. Frequent payloads, at most
    1 / HOT of them, meet their original by broadcast, others by a shuffle
    unless all originals are few.
    """
    same = F.sha2("payload", 256)
    rows = captures.select("page_id", "url", "captured", "payload", F.octet_length("payload").cast("long").alias("n_bytes"), F.sha1("payload").alias("digest"), same.alias("same"))
    who = F.struct("page_id", "url", "captured")
    groups = rows.where(F.col("n_bytes") >= min_bytes).groupBy("same").agg(F.count("*").alias("copies"), F.max(who).alias("original"))
    groups = write_table(groups.where("copies > 1"), "copies")
    widest = groups.agg(F.max(F.octet_length("original.url"))).first()[0] or 0
    near = sized(groups, 192 + widest)
    if near is not groups:
        out = rows.join(near, "same", "left")
    else:
        total = rows.count()
        few = F.broadcast(groups.where(F.col("copies") > HOT * total).select("same", F.col("original").alias("hot")))
        rows = rows.join(few, "same", "left")
        # rows without copies spread by their own id, not by the null key
        alone = F.concat_ws("-", F.lit(""), "page_id", "url")
        probe = F.when(F.col("hot").isNull() & (F.col("n_bytes") >= min_bytes), F.col("same")).otherwise(alone)
        out = rows.withColumn("probe", probe).join(groups.select(F.col("same").alias("probe"), "original"), "probe", "left")
        out = out.withColumn("original", F.coalesce("hot", "original")).drop("hot", "probe")
    itself = F.coalesce(F.col("original.page_id").eqNullSafe(F.col("page_id")) & F.col("original.url").eqNullSafe(F.col("url")) & F.col("original.captured").eqNullSafe(F.col("captured")), F.lit(True))
    nameless = F.col("original.page_id").isNull()
    return out.drop("same", "copies").withColumn("original", F.when(~itself & ~nameless, F.col("original")))


def write_archives(captures: DataFrame, path: str, min_bytes: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record per capture: page_id long, url string, captured string (ISO date), payload binary.

    A null payload is an empty one. No shuffle: each task cuts its own rows
    into archives. Other columns are ignored; no rows, no archive.
    """
    payload = F.coalesce(F.col("payload"), F.lit(b"").cast("binary")).alias("payload")
    rows = with_original(captures.select("page_id", "url", "captured", payload), min_bytes)
    rows = rows.select("page_id", "url", "captured", "payload", "digest", "original.*", (F.col("original").isNotNull()).alias("again"))
    rows = rows.toDF("page_id", "url", "captured", "payload", "digest", "first_id", "first_url", "first_at", "again")
    schema = pa.schema([("run", pa.int32()), ("member", pa.binary())])

    def run(batches):
        archive, written = 0, 0
        for batch in batches:
            runs, out, held = [], [], 0
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                first = record_id(*r[5:8], r[4]) if r[8] else None
                member = gzipped(record(*r[:5], first))
                runs.append(archive)
                out.append(member)
                held += len(member)
                written += len(member) + len(SEPARATOR)
                if written >= archive_bytes:
                    archive, written = archive + 1, 0
                if held >= 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(runs, pa.int32()), pa.array(out, pa.binary())], schema=schema)
                    runs, out, held = [], [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(runs, pa.int32()), pa.array(out, pa.binary())], schema=schema)

    packed = rows.mapInArrow(run, "run int, member binary").select("run", F.col("member").cast("string").alias("value"))
    packed.write.partitionBy("run").option("encoding", "ISO-8859-1").option("lineSep", SEPARATOR.decode("latin-1")).text(path)


# -- reading ------------------------------------------------------------------

RECORD = pa.schema(
    [
        ("run", pa.string()), ("seq", pa.int32()), ("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
        ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to_id", pa.string()), ("digest", pa.string()), ("n_bytes", pa.int64()),
        ("offset", pa.int64()), ("length", pa.int64()), ("payload", pa.binary()),
    ]
)
RECORD_DDL = (
    "run string, seq int, url_key string, captured string, page_id long, url string, record_id string, record_type string,"
    " refers_to_id string, digest string, n_bytes long, offset long, length long, payload binary"
)


def capture_order(row: dict) -> tuple:
    return row["url_key"], row["captured"], row["page_id"] is not None, row["page_id"] or 0, row["record_id"]


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """A row per record of the archives under ``path``, see RECORD_DDL.

    Each archive is a run: its rows carry ``seq``, their place in the order of
    URL key, time, page id and record id. ``digest`` and ``n_bytes`` are those
    of the payload found in the record, compared with the header for
    responses; for revisits ``digest`` is the header's and ``n_bytes`` null.
    ``payload`` null unless asked for. A damaged archive raises an error.
    """

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows = []
                for offset, length, data in members(content.as_buffer().to_pybytes()):
                    fields, body = parse(data)
                    again = fields["warc-type"] == "revisit"
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    if not again and hashlib.sha1(body).hexdigest() != digest:
                        raise ValueError(f"payload of {fields['warc-record-id']} differs from its digest")
                    rows.append(
                        {
                            "run": name.as_py(), "url_key": url_key(fields["warc-target-uri"]), "captured": fields["warc-date"],
                            "page_id": int(fields["page-id"]) if "page-id" in fields else None, "url": fields["warc-target-uri"],
                            "record_id": fields["warc-record-id"], "record_type": fields["warc-type"], "refers_to_id": fields.get("warc-refers-to"),
                            "digest": digest, "n_bytes": None if again else len(body), "offset": offset, "length": length,
                            "payload": body if payload and not again else None,
                        }
                    )
                rows.sort(key=capture_order)
                for seq, row in enumerate(rows):
                    row["seq"] = seq
                for k in range(0, len(rows), 500):
                    yield pa.RecordBatch.from_pylist(rows[k : k + 500], schema=RECORD)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, RECORD_DDL)


# -- merging ------------------------------------------------------------------


class LoserTree:
    """Merge of k sorted runs: each inner node keeps the loser of its match, so that a new key meets log k others."""

    def __init__(self, runs: list[Iterable[tuple]]):
        self.sources = [iter(r) for r in runs]
        self.heads = [next(s, None) for s in self.sources]
        self.k = len(runs)
        self.losers = [0] * self.k
        self.winner = self._build(1) if self.k else None

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        first, last = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = last
        return first

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[self.winner] is not None:
            w = self.winner
            yield self.heads[w]
            self.heads[w] = next(self.sources[w], None)
            node = (w + self.k) // 2
            while node >= 1:
                if self._beats(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


ORDER = ["url_key", "captured", "page_id", "record_id", "run", "seq"]


def merged(records: DataFrame) -> DataFrame:
    """``records`` (of :func:`read_archives`, without payload) with ``pos``, the place in the order of all captures, from 0.

    Ranges of the order are dealt to tasks by size; the time, the ids and the
    place are part of it, so the history of one busy URL is split as well.
    """
    rows = records.drop("payload")
    names = rows.columns
    at = {c: names.index(c) for c in ORDER}
    ranged = rows.repartitionByRange(parts_for(rows.count(), 512), *ORDER).withColumn("part", F.spark_partition_id())
    schema = pa.schema([f for f in RECORD if f.name != "payload"] + [("part", pa.int32()), ("place", pa.int64())])

    def run(batches):
        runs: dict[str, list[tuple]] = {}
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                runs.setdefault(r[at["run"]], []).append(r)

        def keyed(piece):
            piece.sort(key=lambda r: r[at["seq"]])  # a shuffle need not keep the order of a run
            for r in piece:
                yield (r[at["url_key"]], r[at["captured"]], r[at["page_id"]] is not None, r[at["page_id"]] or 0, r[at["record_id"]], r[at["run"]], r[at["seq"]]), r

        held = []
        for place, (_, r) in enumerate(LoserTree([keyed(p) for _, p in sorted(runs.items())])):
            held.append((*r, place))
            if len(held) == 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    ddl = RECORD_DDL.removesuffix(", payload binary") + ", part int, place long"
    local = write_table(ranged.mapInArrow(run, ddl), "merged")
    before, total = [], 0
    for part, rows_in in sorted(local.groupBy("part").count().collect()):  # one row per range partition
        before.append((part, total))
        total += rows_in
    if not before:
        return local.select(*names, F.col("place").alias("pos"))
    offsets = F.broadcast(records.sparkSession.createDataFrame(before, "part int, before long"))
    return local.join(offsets, "part").select(*names, (F.col("place") + F.col("before")).alias("pos"))


def resolved(records: DataFrame) -> DataFrame:
    """Records with the payload's n_bytes and digest and ``refers_to``, the page id of the response; revisits take all three from the response they name."""
    again = records.where("record_type = 'revisit'")
    cites = again.groupBy("refers_to_id").agg(F.count("*").alias("cites"))
    full = records.where("record_type <> 'revisit'")
    # equal captures share a record id and are alike: one row for each id
    each = full.groupBy(F.col("record_id").alias("refers_to_id")).agg(
        F.first("page_id").alias("refers_to"), F.first("n_bytes").alias("full_bytes"), F.first("digest").alias("full_digest")
    )
    cited = write_table(each.join(cites, "refers_to_id"), "cited")
    found = join_unique(again, cited, "refers_to_id", "cites", records.count())
    found = found.withColumn("n_bytes", F.col("full_bytes")).withColumn("digest", F.col("full_digest")).drop("full_bytes", "full_digest", "cites")
    return full.withColumn("refers_to", F.lit(None).cast("long")).unionByName(found.select(*records.columns, "refers_to"))


def page_captures(pages: DataFrame) -> DataFrame:
    """Captures of ``pages``, one a second in order of page id (a null id: the first second)."""
    when = F.timestamp_seconds(F.lit(1_704_067_200) + F.coalesce(F.col("page_id"), F.lit(0)) % F.lit(3_000_000_000))
    date = F.concat(F.date_format(F.to_utc_timestamp(when, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return pages.select("page_id", "url", date.alias("captured"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))


def op12_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from its archive and found in the merged index.

    A null html is an empty payload; null ids and URLs are kept (the ids null,
    the URL as a name from the id); repeated rows are records of their own, of
    one record id. Of pages with equal payloads and the same largest id, the
    one of the largest URL is the response; rows equal in both all are.
    """
    path = f"{scratch_dir(spark)}/talus/warc-{uuid.uuid4().hex}"
    captures = page_captures(table(spark, sf_dir, "pages"))
    write_archives(captures, path)
    runs = write_table(read_archives(spark, path, payload=False), "captures")
    index = write_table(merged(runs), "capture-index")
    drop_table(runs)
    return resolved(index).select(
        "page_id", F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to"
    )


ORACLE = """
with p as (
  select page_id, url, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as n from pages
), o as (
  select *, max(page_id) over same as last, first_value(url) over (same order by page_id desc nulls last, url desc nulls last) as last_url
  from p window same as (partition by html)
), r as (
  select *, coalesce(n >= 1000 and (page_id is distinct from last or url is distinct from last_url) and last is not null, false) as again from o
)
select page_id, n::bigint as payload_bytes, sha1(html) as payload_digest, case when again then 'revisit' else 'response' end as record_type,
  case when again then last end as refers_to
from r
"""
