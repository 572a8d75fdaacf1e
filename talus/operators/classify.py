"""Classification with reasons: audience, type by audience, subtype under its type, safe patches; description candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions.columns import is_blank, stripped_html
from talus.operators.rules import decided

#: Rows of a hierarchy (a pair of codes and a number) that may be broadcast.
SMALL_DIMENSION = 100_000
#: One case of a decision list: pattern, value, reason, confidence.
Case = tuple[str, str, str, float]


def by_pattern(text: Column, cases: list[Case], default: str) -> Column:
    """Struct (value, reason, confidence) of the first pattern that occurs."""
    return decided([(F.coalesce(text, F.lit("")).rlike(p), v, r, c) for p, v, r, c in cases], default)


def audience(stored: Column, hard: Column, soft: Column, brand: Column, hard_cases: list[Case], soft_cases: list[Case], brands: dict[str, str], default: str, known: tuple[str, ...]) -> Column:
    """Hard patterns overrule a stored value; a stored value overrules soft patterns; then brand defaults; else ``default``."""
    cases = [(F.coalesce(hard, F.lit("")).rlike(p), v, r, c) for p, v, r, c in hard_cases]
    cases += [(stored == k, k, "stored", 0.9) for k in known]
    cases += [(F.coalesce(soft, F.lit("")).rlike(p), v, r, c) for p, v, r, c in soft_cases]
    cases += [(brand == b, v, "brand", 0.62) for b, v in brands.items()]
    return decided(cases, default)


def type_of(audience: Column, text: Column, first: list[Case], by_audience: dict[str, list[Case]], default: str) -> Column:
    """Decision list over all (accessories and the like), then the audience's own classifier."""
    t = F.coalesce(text, F.lit(""))
    cases = [(t.rlike(p), v, r, c) for p, v, r, c in first]
    for who, own in by_audience.items():
        cases += [((audience == who) & t.rlike(p), v, r, c) for p, v, r, c in own]
    return decided(cases, default)


def under(parent: Column, code: Column, children: dict[str, tuple[str, ...]]) -> Column:
    """``code`` where the parent type has it, else null."""
    ok = reduce(lambda a, b: a | b, [(parent == p) & code.isin(*c) for p, c in children.items()], F.lit(False))
    return F.when(ok, code)


def under_table(rows: DataFrame, parent: str, codes: list[str], dimension: DataFrame) -> DataFrame:
    """``rows`` with ``subtype``, the first of the columns ``codes`` that ``dimension`` (parent, child, ordinal) has under the row's parent, and its ``ordinal``.

    The hierarchy is data: a changed row of the dimension changes the result.
    It is broadcast if it is small by count; else both sides are dealt by
    (parent, child), never by the parent alone.
    """
    small, out = dimension.count() <= SMALL_DIMENSION, rows
    for k, code in enumerate(codes):
        one = dimension.select(F.col("parent").alias(f"p{k}_"), F.col("child").alias(f"c{k}_"), F.col("ordinal").alias(f"o{k}_"))
        out = out.join(F.broadcast(one) if small else one, (F.col(parent) == F.col(f"p{k}_")) & (F.col(code) == F.col(f"c{k}_")), "left")
    hit = F.coalesce(*[F.when(F.col(f"c{k}_").isNotNull(), F.struct(F.col(f"c{k}_").alias("c"), F.col(f"o{k}_").alias("o"))) for k in range(len(codes))])
    return out.select(*rows.columns, hit["c"].alias("subtype"), hit["o"].alias("ordinal"))


def safe_patch(old: tuple[Column, Column], new: tuple[Column, Column], risk: Column, evidence: Column, safe: tuple[str, ...], risky: tuple[str, ...]) -> Column:
    """Whether a type and subtype may be written without a person: a safe type, no risky word, some evidence, and a change."""
    change = ~(new[0].eqNullSafe(old[0]) & new[1].eqNullSafe(old[1]))
    return F.coalesce(new[0].isin(*safe), F.lit(False)) & ~F.coalesce(risk, F.lit("")).rlike("|".join(risky)) & ~is_blank(evidence) & change


def description(page: Column, least: int = 24, most: int = 600) -> Column:
    """Struct (text, source, confidence) of the first usable description: meta, JSON-LD, paragraph, title; the last one is a mere hint."""
    raw = F.coalesce(page, F.lit(""))
    meta = F.array(F.regexp_extract(raw, r'(?i)<meta\s+name="description"\s+content="([^"]*)"', 1))
    data = F.array(F.regexp_extract(raw, r'"description"\s*:\s*"([^"]*)"', 1))
    paragraphs = F.regexp_extract_all(raw, F.lit(r"(?s)<p>(.*?)</p>"), F.lit(1))
    title = F.array(F.regexp_extract(raw, r"(?s)<title>(.*?)</title>", 1))
    found = None
    for texts, source, confidence in ((meta, "meta", 0.95), (data, "json_ld", 0.95), (paragraphs, "block", 0.82), (title, "title", 0.62)):
        text = F.get(F.filter(F.transform(texts, stripped_html), lambda t: F.length(t) >= least), F.lit(0))
        one = F.when(text.isNotNull(), F.struct(F.substring(text, 1, most).alias("text"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence")))
        found = one if found is None else F.coalesce(found, one)
    return found


def rule_price(text: Column, rules: list[tuple[str, float]], default: float | None = None) -> Column:
    """Price by the first pattern that occurs."""
    t = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(default).cast("double")
    for pattern, price in reversed(rules):
        out = F.when(t.rlike(pattern), F.lit(price)).otherwise(out)
    return out


def variant_price(variants: Column) -> Column:
    """The first variant whose price parses, else the first variant: (title, price)."""
    good = F.filter(variants, lambda v: v["price"].try_cast("double").isNotNull())
    return F.coalesce(F.get(good, F.lit(0)), F.get(variants, F.lit(0)))


def kept_if_empty(new: Column, old: Column) -> Column:
    """The new array, or the old one where the new is empty or null."""
    return F.when(F.size(F.coalesce(new, F.array().cast("array<string>"))) > 0, new).otherwise(old)
