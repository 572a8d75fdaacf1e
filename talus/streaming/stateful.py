"""Keyed streaming state with timers and expiry: rate limits, unique viewers, retained sessions.

All need the RocksDB state store, which :func:`use_rocksdb` sets for the
session. State of a key is read and written piece by piece; no processor
holds the rows that a key has in a micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """Rows as plain objects: frames with other kinds of text columns cannot be put together by the writer."""
    return pd.DataFrame(rows, columns=columns, dtype=object)


class RateLimit(StatefulProcessor):
    """Fixed windows per key that start at the first event after the last one ended, in event time.

    Rows wait in a map from time slot to their times and ids. Once the
    watermark has passed a slot no earlier row can come: its timer folds it,
    in order of time and id, into the key's window (start, count). A window
    that ended before the watermark is cleared by a timer of its own.
    """

    def __init__(self, key: str, at: str, order: str, order_type: str, window_us: int, limit: int, slot_us: int):
        self.key, self.at, self.order, self.order_type = key, at, order, order_type
        self.window_us, self.limit, self.slot_us = window_us, limit, slot_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "slot long", f"times array<long>, orders array<{self.order_type}>")
        self.window = handle.getValueState("window", "start long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for slot, part in pdf.groupby(pdf[self.at] // self.slot_us):
                slot = int(slot)
                times, orders = [int(t) for t in part[self.at]], part[self.order].tolist()
                if self.pending.containsKey((slot,)):
                    old = self.pending.getValue((slot,))
                    times, orders = [*old[0], *times], [*old[1], *orders]
                else:
                    self.handle.registerTimer(-(-(slot + 1) * self.slot_us // 1000))
                self.pending.updateValue((slot,), (times, orders))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        start, n = self.window.get() if self.window.exists() else (None, 0)
        slots = sorted(int(s[0]) for s in self.pending.keys())
        due = [s for s in slots if (s + 1) * self.slot_us <= now]
        out = []
        for slot in due:
            rows = sorted(zip(*self.pending.getValue((slot,))))
            self.pending.removeKey((slot,))
            for t, order in rows:
                if start is None or t >= start + self.window_us:
                    start, n = t, 0
                n += 1
                out.append((key[0], order, n, n <= self.limit))
        if start is not None:
            end = start + self.window_us
            if end <= now:
                self.window.clear()  # the next row is later than the watermark and starts a window of its own
            else:
                self.window.update((start, n))
                self.handle.registerTimer(-(-end // 1000))
        yield frame(out, [self.key, self.order, "window_count", "allowed"])


def rate_limited(events: DataFrame, key: str, at: str, order: str, window_us: int, limit: int, late: str, slot_us: int | None = None) -> DataFrame:
    """(key, order, window_count, allowed) of a stream: what :func:`talus.operators.events.fixed_window_limit` gives for its rows.

    ``at`` is a timestamp; rows later than ``late`` behind the newest are
    dropped, rows with a null key or time take no part. A row is decided once
    the watermark has passed its slot of ``slot_us`` (an eighth of the window).
    """
    types = dict(events.dtypes)
    rows = events.select(key, at, order).where(F.col(key).isNotNull() & F.col(at).isNotNull())
    rows = rows.withWatermark(at, late).withColumn("at_us_", F.unix_micros(at))
    step = RateLimit(key, "at_us_", order, types[order], window_us, limit, slot_us or max(1000, window_us // 8))
    shape = f"{key} {types[key]}, {order} {types[order]}, window_count long, allowed boolean"
    return rows.groupBy(key).transformWithStateInPandas(step, shape, "Append", "EventTime")


class FirstViews(StatefulProcessor):
    """Each viewer of a card once, for as long as the state keeps the viewer."""

    def __init__(self, card: str, viewer: str, viewer_type: str, ttl_ms: int | None):
        self.card, self.viewer, self.viewer_type, self.ttl_ms = card, viewer, viewer_type, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", f"viewer {self.viewer_type}", "n long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            new = []
            for viewer, n in pdf[self.viewer].value_counts().items():
                if not self.seen.containsKey((viewer,)):
                    new.append(viewer)
                    self.seen.updateValue((viewer,), (1,))
            yield frame([(key[0], v) for v in new], [self.card, self.viewer])


def unique_viewers(events: DataFrame, card: str, viewer: str, ttl_ms: int | None = None) -> DataFrame:
    """(card, viewer) of a stream, each pair once within ``ttl_ms`` of its first view (processing time); rows with a null take no part."""
    types = dict(events.dtypes)
    rows = events.select(card, viewer).where(F.col(card).isNotNull() & F.col(viewer).isNotNull())
    step = FirstViews(card, viewer, types[viewer], ttl_ms)
    return rows.groupBy(card).transformWithStateInPandas(step, f"{card} {types[card]}, {viewer} {types[viewer]}", "Append", "ProcessingTime")


class Retained(StatefulProcessor):
    """The newest row of a key, and its end: a timer drops it once the watermark is past its time to live."""

    def __init__(self, key: str, at: str, value: str, value_type: str, keep_us: int):
        self.key, self.at, self.value, self.value_type, self.keep_us = key, at, value, value_type, keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", f"at long, value {self.value_type}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, value = self.row.get() if self.row.exists() else (None, None)
        before = at
        for pdf in rows:
            k = int(np.lexsort((pdf[self.value].astype(str), pdf[self.at]))[-1])  # newest; ties to the greater value
            t, v = int(pdf[self.at].iloc[k]), pdf[self.value].iloc[k]
            if at is None or (t, str(v)) > (at, str(value)):
                at, value = t, v
        if at != before or before is None:
            self.handle.registerTimer(-(-(at + self.keep_us) // 1000))
        self.row.update((at, value))
        yield frame([(key[0], value, False)], [self.key, self.value, "expired"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.row.exists():
            at, value = self.row.get()
            if at + self.keep_us <= timerValues.getCurrentWatermarkInMs() * 1000:  # not renewed since
                self.row.clear()
                yield frame([(key[0], value, True)], [self.key, self.value, "expired"])


def retained(events: DataFrame, key: str, at: str, value: str, days: float, late: str) -> DataFrame:
    """Changes of a table of the newest value per key: (key, value, expired); a key expires ``days`` after its newest row.

    Rows with a null key or time take no part; a null value is an empty text.
    """
    types = dict(events.dtypes)
    rows = events.select(key, at, value).where(F.col(key).isNotNull() & F.col(at).isNotNull()).na.fill("", [value])
    rows = rows.withWatermark(at, late).withColumn("at_us_", F.unix_micros(at))
    step = Retained(key, "at_us_", value, types[value], int(days * 86_400_000_000))
    shape = f"{key} {types[key]}, {value} {types[value]}, expired boolean"
    return rows.groupBy(key).transformWithStateInPandas(step, shape, "Append", "EventTime")
