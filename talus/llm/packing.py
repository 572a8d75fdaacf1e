"""Operator 8: variable-capacity best-fit packing.

Sequences are dealt by hash into groups of a bounded number of pieces; inside
a group, best-fit decreasing packs them into bins whose size is chosen among
several permitted capacities. Each group is packed once for every opening
policy ("open no bin below this capacity"), each bin is then downsized to the
least capacity that holds its contents, and the policy with the least total
cost wins: the permitted sizes are optimised jointly. A longer input means
more groups, not larger ones.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm.common import arrow_schema, table, word_count

CAPACITIES = (512, 1024, 2048, 4096)
SCHEMA = "doc_id long, piece int, length int, bin_id long, capacity int, offset int"


def bin_cost(capacity: int, attention: float) -> float:
    """Linear cost of a sequence plus its quadratic (attention) share."""
    return capacity * (1 + capacity * attention)


def pack_group(
    lengths: list[int], capacities: tuple[int, ...], attention: float
) -> tuple[list[int], list[int]]:
    """Bins of pieces that come longest first: (bin of each piece, capacity of each bin)."""
    best = None
    for floor in capacities:
        bins, left, used, full = [], {}, [], 0  # full: bit r is set if a bin has r left
        for length in lengths:
            at = full >> length
            if at:
                room = length + (at & -at).bit_length() - 1
                b = left[room].pop()
                if not left[room]:
                    full &= ~(1 << room)
            else:
                room = min((c for c in capacities if c >= max(length, floor)), key=lambda c: bin_cost(c, attention))
                b = len(used)
                used.append(0)
            used[b] += length
            bins.append(b)
            room -= length
            if room:
                left.setdefault(room, []).append(b)
                full |= 1 << room
        sizes = [min(c for c in capacities if c >= u) for u in used]
        cost = sum(bin_cost(c, attention) for c in sizes)
        if best is None or cost < best[0]:
            best = cost, bins, sizes
    return best[1], best[2]


def pack(
    items: DataFrame,
    capacities: tuple[int, ...] = CAPACITIES,
    attention: float = 1 / 16384,
    group_rows: int = 8192,
) -> DataFrame:
    """Pack rows (doc_id, length) into bins of the permitted capacities.

    Returns one row per piece: doc_id, piece (from 0), length, bin_id,
    capacity (of the bin after downsizing), offset (in the bin). A row longer
    than the largest capacity is cut into pieces of that capacity and a rest;
    nothing is dropped. Null or non-positive lengths count as 1 (the end
    token alone); null ids are kept. Repeated rows are packed as often as they
    occur and are spread over the groups like all others; ties are taken by
    doc_id, then piece. An empty table gives no rows; other columns are
    ignored. ``group_rows`` is the number of pieces of one task's group
    (groups are dealt by hash, so it holds up to chance), whatever the
    input's size, the lengths and the repeated rows. ``items`` must come from
    files, not from a shuffle, so that a lost task deals its rows alike again.
    """
    capacities = tuple(sorted(capacities))
    top = capacities[-1]
    length = F.greatest(F.coalesce(F.col("length"), F.lit(1)), F.lit(1)).cast("long")
    last = F.floor((length - 1) / top)
    n_pieces = items.agg(F.sum(last + 1)).first()[0] or 0
    groups = max(1, -(-n_pieces // group_rows))
    rows = items.select(F.col("doc_id").cast("long").alias("doc_id"), length.alias("total"), F.monotonically_increasing_id().alias("row"))
    pieces = rows.select("doc_id", "total", "row", F.explode(F.sequence(F.lit(0), F.floor((F.col("total") - 1) / top).cast("int"))).alias("piece")).select(
        "doc_id",
        "piece",
        F.least(F.lit(top), F.col("total") - F.col("piece") * top).cast("int").alias("length"),
        F.pmod(F.xxhash64("row", "piece"), F.lit(groups)).alias("grp"),
    )
    schema = arrow_schema(SCHEMA)

    def group(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")]))
        length = rows["length"].to_pylist()
        bins, sizes = pack_group(length, capacities, attention)
        used, offset = [0] * len(sizes), []
        for b, n in zip(bins, length):
            offset.append(used[b])
            used[b] += n
        first = rows["grp"][0].as_py() << 32
        columns = {
            "doc_id": rows["doc_id"], "piece": rows["piece"], "length": rows["length"],
            "bin_id": [first + b for b in bins], "capacity": [sizes[b] for b in bins], "offset": offset,
        }
        return pa.table(columns, schema=schema)

    return pieces.groupBy("grp").applyInArrow(group, SCHEMA)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents by words plus one end token; a row per piece."""
    return pack(lengths(table(spark, sf_dir, "documents")))


def lengths(docs: DataFrame) -> DataFrame:
    """Sequence lengths of documents: words plus the end token; null text is empty."""
    return docs.select("doc_id", (word_count(F.col("text")) + 1).alias("length"))
