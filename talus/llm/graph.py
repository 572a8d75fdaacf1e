"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.common import drop_table, join_unique, write_table


def components(links: DataFrame, tag: str = "components") -> DataFrame:
    """(node, root) of every node of ``links`` (u, v); root is the least node of its component.

    Links between a node and itself give that node alone; null ends are
    ignored. Each round is written to the shared folder; no node or link is
    held by the driver. A node with very many links is joined with its
    neighbours by broadcast, so that none of the tasks gets all of them.
    """
    links = links.where("u is not null and v is not null")
    edges = write_table(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), tag)
    state = None
    while True:
        total = 2 * (state[0] if state else edges.count())
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = write_table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), tag)
        large = join_unique(both, least, "u", "n", total).where("v >= u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = write_table(large, tag)
        low = write_table(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), tag)
        joined = join_unique(large, low, "u", "n", total)
        small = joined.select("v", "m").union(joined.select("u", "m")).toDF("u", "v").distinct()
        after = write_table(small, tag)
        drop_table(edges, least, large, low)
        before, edges = state, after
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
