"""Rule-table text logic: signals, evidence, intent, classification. Rules are data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions.columns import is_blank, sentences


@dataclass(frozen=True)
class Rule:
    """A class with its patterns and the weights of the sources they may occur in."""

    code: str
    patterns: tuple[str, ...]
    weights: dict[str, int]


def haystack(*xs: Column) -> Column:
    """Lower-case text of all parts that are not blank."""
    return F.lower(F.concat_ws(" ", *[F.when(~is_blank(x), F.trim(x)) for x in xs]))


def signal(text: Column, positive: str, negative: str) -> Column:
    """Positive pattern without the negative one."""
    t = F.coalesce(text, F.lit(""))
    return ~t.rlike(negative) & t.rlike(positive)


def evidence(items: DataFrame, id_: str, sources: dict[str, str], rules: list[tuple[str, str, str]]) -> DataFrame:
    """(id, signal, polarity, text, source): sentences that a rule (signal, positive, negative) hits.

    Sources are looked at in order; a sentence that the negative pattern hits
    gives negative evidence only; equal (signal, polarity, text) count once, in
    their first place.
    """
    def tagged(k: int, name: str):
        return lambda s: F.struct(F.lit(k).alias("k"), F.lit(name).alias("source"), s.alias("text"))

    parts = F.flatten(F.array(*[F.transform(sentences(F.col(c)), tagged(k, n)) for k, (n, c) in enumerate(sources.items())]))
    rows = items.select(id_, F.posexplode(parts).alias("at", "p")).select(id_, "at", "p.source", "p.text")
    low = F.lower("text")
    hits = F.array_compact(
        F.array(
            *[
                F.when(low.rlike(neg), F.struct(F.lit(sig).alias("signal"), F.lit("negative").alias("polarity"))).when(
                    low.rlike(pos), F.struct(F.lit(sig).alias("signal"), F.lit("positive").alias("polarity"))
                )
                for sig, pos, neg in rules
            ]
        )
    )
    rows = rows.select(id_, "at", "source", "text", F.inline(hits))
    return rows.groupBy(id_, "signal", "polarity", "text").agg(F.min_by("source", "at").alias("source"))


def source_score(sources: dict[str, Column], rule: Rule) -> Column:
    """Sum over sources and patterns of the source's weight where the pattern occurs."""
    score = F.lit(0)
    for name, weight in rule.weights.items():
        for p in rule.patterns:
            score = score + F.when(F.coalesce(sources[name], F.lit("")).rlike(p), weight).otherwise(0)
    return score


def classified(rows: DataFrame, sources: dict[str, Column], rules: list[Rule], least: int, default: str, kind: str = "kind", best: str = "best") -> DataFrame:
    """Add the best score and its code, first in declared order, or the default below ``least``.

    The scores are one array, so that each pattern is tried once per row.
    """
    codes = F.array(*[F.lit(r.code) for r in rules])
    rows = rows.withColumn("_scores", F.array(*[source_score(sources, r) for r in rules])).withColumn(best, F.array_max("_scores"))
    code = F.element_at(codes, F.array_position("_scores", F.col(best)).cast("int"))
    return rows.withColumn(kind, F.when(F.col(best) < least, F.lit(default)).otherwise(code)).drop("_scores")


def stored_wins(stored: Column, inferred: Column, known: tuple[str, ...]) -> Column:
    return F.when(stored.isin(*known), stored).otherwise(inferred)


def decided(cases: list[tuple[Column, str, str, float]], value: str) -> Column:
    """Decision list: struct of value, reason and confidence of the first case that holds."""
    pack = lambda v, r, c: F.struct(F.lit(v).alias("value"), F.lit(r).alias("reason"), F.lit(c).alias("confidence"))
    out = None
    for test, v, reason, confidence in cases:
        out = F.when(test, pack(v, reason, confidence)) if out is None else out.when(test, pack(v, reason, confidence))
    return out.otherwise(pack(value, "default", 0.0))
