"""Event logic: distinct viewers, retention, rate limits, sessions, weighted votes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def unique_viewers(views: DataFrame, card: str, viewer: str) -> DataFrame:
    """Each (card, viewer) counts once; first view by event id."""
    return views.groupBy(card).agg(F.count_distinct(viewer).alias("viewers"), F.count("*").alias("views"))


def fixed_window_limit(events: DataFrame, key: str, at: str, order: str, window_us: int, limit: int) -> DataFrame:
    """Decide each event: allowed or not under ``limit`` events per window and key.

    A window starts at the first event after the previous one ended (not at
    multiples of its length): a fold over a key's events in time order, ties
    by ``order``. The fold runs over sorted partitions batch by batch and holds
    one window's start and count, however many events a key has. Rows with a
    null key or time take no part.
    """
    types = dict(events.dtypes)
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = events.select(key, at, order).where(F.col(key).isNotNull() & F.col(at).isNotNull())
    rows = rows.repartition(parts, key).sortWithinPartitions(key, at, order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, start, n = None, 0, 0
        for pdf in batches:
            k, t = pdf[key].to_numpy(), pdf[at].to_numpy()
            count = np.zeros(len(k), np.int32)
            cuts = np.append(np.flatnonzero(k[1:] != k[:-1]) + 1, len(k))
            i = 0
            for end in cuts if len(k) else ():
                if last is None or k[i] != last:
                    last, start, n = k[i], int(t[i]), 0
                while i < end:
                    stop = i + int(np.searchsorted(t[i:end], start + window_us))
                    count[i:stop] = np.arange(n + 1, n + 1 + stop - i)
                    n += stop - i
                    i = stop
                    if i < end:
                        start, n = int(t[i]), 0
            yield pd.DataFrame({key: pdf[key], order: pdf[order], "window_count": count, "allowed": count <= limit})

    return rows.mapInPandas(run, f"{key} {types[key]}, {order} {types[order]}, window_count int, allowed boolean")


def retained(rows: DataFrame, at: Column, as_of: Column, days: int) -> DataFrame:
    """Rows that have not expired at a given time, with their expiry."""
    expires = at + F.make_dt_interval(F.lit(days))
    return rows.withColumn("expires_at", expires).where(F.col("expires_at") >= as_of)


def vote(answers: DataFrame, weights: DataFrame, by: str) -> DataFrame:
    """Weighted vote: winner and runner-up code per voter, total power and its grade."""
    sums = answers.join(F.broadcast(weights), "answer").groupBy(by, "code").agg(F.sum("weight").alias("votes"))
    w = Window.partitionBy(by).orderBy(F.desc("votes"), F.asc("code"))
    ranked = sums.withColumn("rn", F.row_number().over(w))
    out = ranked.groupBy(by).agg(
        F.max(F.when(F.col("rn") == 1, F.col("code"))).alias("winner"), F.max(F.when(F.col("rn") == 2, F.col("code"))).alias("runner_up"), F.sum("votes").alias("power")
    )
    return out.withColumn("grade", F.when(F.col("power") >= 300, "high").when(F.col("power") >= 150, "middle").otherwise("low"))


def answer_path(steps: DataFrame, session: str, order: str, step: str) -> DataFrame:
    """Answer path per session: answering a step again cuts the path from that step on.

    A step stays if no smaller one was answered after its last time, so only the
    last order of each step is needed. A null step cuts the whole path and
    stays only where nothing follows. At equal order the smaller step is first.
    """
    last = steps.groupBy(session, F.col(step).cast("long").alias("_s")).agg(F.max(order).alias("_o"))
    by = Window.partitionBy(session)
    smaller = F.max("_o").over(by.orderBy(F.asc_nulls_first("_s")).rowsBetween(Window.unboundedPreceding, -1))
    end = F.max(F.struct("_o", "_s")).over(by)
    last = last.withColumn("_m", smaller).withColumn("_e", end)
    stays = F.coalesce(F.col("_o") >= F.col("_m"), F.col("_m").isNull()) & (F.col("_s").isNotNull() | F.col("_e._s").isNull())
    path = F.transform(F.array_sort(F.collect_list(F.struct("_s"))), lambda e: e["_s"])
    return last.where(stays).groupBy(session).agg(path.alias("path"))
