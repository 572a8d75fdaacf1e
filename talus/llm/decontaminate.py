"""Operator 4: benchmark decontamination by pigeonhole edit matching.

With an error budget of e edits, an item cut into e + 1 pieces leaves at least
one piece unharmed: exact hits of any piece (one automaton over all pieces)
give the windows of a text in which the item can lie, and Myers' bit-parallel
distance verifies them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm.common import map_batches, table

#: Edits that an item may carry, as a share of its characters.
RATE = 0.08
#: Items of fewer characters are common phrases: they match a document only as its whole text.
SHORT = 24
SCHEMA = "doc_id long, item_id long, distance int, begin int, finish int"


def normal(text: str | None) -> str:
    """Lower case, each run of white space one blank, trimmed."""
    return " ".join((text or "").lower().split())


def places(text: str) -> list[int]:
    """For each character of ``normal(text)`` the place in ``text`` that it comes from."""
    out: list[int] = []
    for m in re.finditer(r"\S+", text):
        if out:
            out.append(m.start() - 1)
        for at, c in enumerate(m[0], m.start()):
            out += [at] * len(c.lower())
    return out


def budget(length: int, rate: float) -> int:
    return int(length * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors`` + 1 contiguous pieces of about equal length with their offsets."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def splits_word(text: str, at: int) -> bool:
    """Whether a stretch that begins or ends at ``at`` cuts a word (scripts from U+2E80 on write no blanks)."""
    if not 0 < at < len(text):
        return False
    a, b = text[at - 1], text[at]
    return a.isalnum() and b.isalnum() and a < "⺀" and b < "⺀"


class Myers:
    """Bit-parallel approximate search for one pattern; any length fits a Python integer."""

    def __init__(self, pattern: str):
        self.m = len(pattern)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def ends(self, text: str, limit: int, anchored: bool = False) -> list[tuple[int, int]]:
        """(distance, end) of each end at which a stretch of ``text`` is within ``limit`` of the pattern.

        ``anchored``: the stretch starts where the text starts.
        """
        masks, m = self.masks, self.m
        full, top = (1 << m) - 1, 1 << (m - 1)
        up, down, score = full, 0, m
        found = []
        carry = 1 if anchored else 0
        for i, c in enumerate(text, 1):
            eq = masks.get(c, 0)
            zero = (((eq & up) + up) ^ up) | eq | down
            plus, minus = down | (full & ~(zero | up)), up & zero
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
            plus = plus << 1 | carry
            minus <<= 1
            up, down = (minus | ~(zero | plus)) & full, plus & zero & full
            if score <= limit:
                found.append((score, i))
        return found


class Item(NamedTuple):
    item_id: int
    text: str
    errors: int
    ahead: Myers
    back: Myers

    def nearest(self, text: str, spans: list[list[int]]) -> tuple[int, int, int] | None:
        """(distance, begin, finish) of the stretch of whole words within the budget: least distance, first end, first begin."""
        at = text.find(self.text)
        while at >= 0:
            if not splits_word(text, at) and not splits_word(text, at + len(self.text)):
                return 0, at, at + len(self.text)
            at = text.find(self.text, at + 1)
        best = None
        for a, b in spans:
            a = max(a, 0)
            for d, n in sorted(self.ahead.ends(text[a:b], self.errors)):
                if best is not None and d > best[0]:
                    break
                end = a + n
                if splits_word(text, end):
                    continue
                start = max(0, end - len(self.text) - self.errors)
                for e, length in self.back.ends(text[start:end][::-1], self.errors, anchored=True):
                    if not splits_word(text, end - length) and (best is None or (e, end, end - length) < best):
                        best = e, end, end - length
        return best and (best[0], best[2], best[1])

    def whole(self, text: str) -> int | None:
        """Distance of the item from the whole text, if within the budget."""
        last = self.ahead.ends(text, self.errors, anchored=True)[-1:]
        return last[0][0] if last and last[0][1] == len(text) else None


class Pieces:
    """One automaton over the pieces of some items."""

    def __init__(self, items: list[Item]):
        import ahocorasick

        self.items = items
        owners: dict[str, list[tuple[int, int]]] = {}
        for k, item in enumerate(items):
            for at, piece in pieces(item.text, item.errors):
                owners.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, own in owners.items():
            self.automaton.add_word(piece, (len(piece), own))
        self.automaton.make_automaton()

    def windows(self, text: str) -> Iterator[tuple[Item, list[list[int]]]]:
        """Items of which a piece occurs, with the stretches of text in which they can lie."""
        if not self.items:
            return
        near: dict[int, list[list[int]]] = {}
        for last, (size, own) in self.automaton.iter(text):
            for k, at in own:
                item = self.items[k]
                a = last + 1 - size - at - item.errors
                near.setdefault(k, []).append([a, a + len(item.text) + 2 * item.errors])
        for k, spans in sorted(near.items()):
            spans.sort()
            merged = spans[:1]
            for a, b in spans[1:]:
                if a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            yield self.items[k], merged


class Matcher:
    """All items of one block; those of fewer than ``short`` characters match whole texts only."""

    def __init__(self, items: list[tuple[int, str]], rate: float, short: int = SHORT):
        own = []
        for item_id, text in items:
            text = normal(text)
            if text:
                own.append(Item(item_id, text, budget(len(text), rate), Myers(text), Myers(text[::-1])))
        self.limit = short
        self.long = Pieces([i for i in own if len(i.text) >= short])
        self.short = Pieces([i for i in own if len(i.text) < short])

    def match(self, raw: str | None) -> Iterator[tuple[int, int, int, int]]:
        """(item_id, distance, begin, finish) of the best place of each item found, in the normalised text."""
        text = normal(raw)
        for item, spans in self.long.windows(text):
            best = item.nearest(text, spans)
            if best is not None:
                yield item.item_id, *best
        if len(text) < 2 * self.limit:
            for item, _ in self.short.windows(text):
                d = item.whole(text)
                if d is not None:
                    yield item.item_id, d, 0, len(text)

    def located(self, raw: str | None) -> list[tuple[int, int, int, int]]:
        """The same with places in the text itself."""
        got, at = list(self.match(raw)), None
        for k, (item_id, d, a, b) in enumerate(got):
            at = at or places(raw)
            got[k] = item_id, d, at[a], at[b - 1] + 1
        return got


def blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``block_bytes``, one at a time; their size is measured first."""
    items = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).where("text <> ''")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + total // block_bytes
    for b in range(n):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield sorted(((r.item_id, r.text) for r in block.collect()), key=lambda r: (r[0] is None, r))


def matches(docs: DataFrame, items: DataFrame, rate: float = RATE, block_bytes: int = 8 << 20, short: int = SHORT) -> DataFrame:
    """Rows (doc_id, item_id, distance, begin, finish) of documents that hold an item.

    An item of n characters may differ by ``int(rate * n)`` edits; case and
    white space do not count, and a match begins and ends with whole words.
    The best place of an item in a document is given, as places of the text's
    own characters: least distance, then first end. An item of fewer than
    ``short`` characters, a common phrase, matches only a document that is
    nothing else; with 0 every item matches wherever it stands. Null and
    empty texts and items match nothing; null ids are kept; texts of any
    length are read whole; repeated rows match as often as they occur; an
    empty table on either side gives no rows; other columns are ignored. The
    items' size is measured first; they are sent to the tasks in blocks of
    about ``block_bytes``, and every document is matched against every block,
    so the work is the product of the two.
    """
    docs = docs.select("doc_id", "text")
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    out = None
    for own in blocks(items, block_bytes):

        def make(own=own):
            matcher = Matcher(own, rate, short)

            def of(batch):
                rows = [(d, *m) for d, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()) for m in matcher.located(t)]
                return dict(zip(names, zip(*rows))) if rows else {c: [] for c in names}

            return of

        part = map_batches(docs, make, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item within the error budget, with the item."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def clean_texts(own: list[tuple[int, str]], rate: float, short: int = SHORT):
    """A column function: whether a text holds none of the items."""
    built: list[Matcher] = []

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        if not built:
            built.append(Matcher(own, rate, short))
        return pd.Series([next(built[0].match(t), None) is None for t in texts], dtype=bool)

    return clean


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str, rate: float = RATE, block_bytes: int = 8 << 20, short: int = SHORT) -> DataFrame:
    """Pipeline stage: documents without a benchmark item, all columns kept.

    Each row is judged by its own text in one pass: ids, null ones too, and
    repeated rows play no part. Null and empty texts stay.
    """
    for own in blocks(table(spark, sf_dir, "benchmark"), block_bytes):
        docs = docs.where(clean_texts(own, rate, short)(F.col("text")))
    return docs
