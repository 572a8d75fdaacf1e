"""Ingest helpers: parameters, names, placeholders, hints, embedded JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talus.functions.columns import ascii_edges, first_filled, is_blank, squeezed


def parameters(rows: DataFrame, id_: str, text: Column, names: dict[str, str], limit: int = 220) -> DataFrame:
    """(id, name, value) of ``key: value`` pairs: known keys by their canonical name, first value wins.

    Placeholders (-, n/a, none) and values longer than ``limit`` are dropped.
    """
    pairs = F.regexp_extract_all(text, F.lit(r"([^:;\n]+:[^;\n]+)"), F.lit(1))
    flat = rows.select(id_, F.posexplode(pairs).alias("at", "pair"))
    key = F.lower(F.trim(F.split_part("pair", F.lit(":"), F.lit(1))))
    value = squeezed(F.regexp_replace("pair", "^[^:]*:", ""))
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    named = flat.select(id_, "at", F.try_element_at(table, key).alias("name"), value.alias("value"))
    good = named.where(F.col("name").isNotNull() & ~is_blank(F.col("value")) & ~F.col("value").rlike("(?i)^(-+|n/?a|none)$") & (F.length("value") <= limit))
    return good.groupBy(id_, "name").agg(F.min_by("value", "at").alias("value"))


def specs(given: dict[str, Column], defaults: dict[str, Column]) -> list[Column]:
    """Given values over defaults, field by field."""
    return [F.coalesce(given.get(n, F.lit(None)), d).alias(n) for n, d in defaults.items()]


def tags(text: Column, rules: list[tuple[str, str]], limit: int = 8) -> Column:
    """Tags of labelled lines (``tags: a, b``), then keyword tags; each once, first ``limit``."""
    line = F.regexp_extract(F.lower(F.coalesce(text, F.lit(""))), r"(?m)^tags?:\s*(.+)$", 1)
    labelled = F.filter(F.transform(F.split(line, "[,/|]"), lambda t: F.trim(t)), lambda t: t != "")
    words = F.array_compact(F.array(*[F.when(F.lower(F.coalesce(text, F.lit(""))).rlike(p), F.lit(t)) for t, p in rules]))
    return F.slice(F.array_distinct(F.concat(labelled, words)), 1, limit)


def slug(name: Column) -> Column:
    """Lower-case words of letters and digits joined by dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def first_sentence(text: Column) -> Column:
    return F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), r"^([^.!?。！？\n]*[.!?。！？]?)", 1))


def display_name(name: Column, brand: Column, noise: str, limit: int = 60) -> Column:
    """A name without noise words and a leading brand, squeezed and cut to ``limit`` characters."""
    out = squeezed(F.regexp_replace(F.coalesce(name, F.lit("")), f"(?i){ascii_edges(noise)}", " "))
    low = F.lower(F.coalesce(brand, F.lit("")))
    led = (low != "") & F.startswith(F.lower(out), F.concat(low, F.lit(" ")))
    return F.left(F.when(led, F.trim(F.substr(out, F.length(low) + 1))).otherwise(out), F.lit(limit))


def country_patch(brand: Column, country: Column, aliases: dict[str, str], overrides: dict[str, str]) -> Column:
    """Brand override, else the canonical spelling of a country, else what is stored; struct with reason."""
    canon = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    fixed = F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv])
    a, b = F.try_element_at(fixed, F.lower(brand)), F.try_element_at(canon, F.lower(F.trim(country)))
    why = F.when(a.isNotNull(), "override").when(b.isNotNull(), "alias").otherwise("stored")
    return F.struct(F.coalesce(a, b, country).alias("value"), why.alias("reason"))


def merged_hint(hints: Column) -> Column:
    """Equal hints keep their value, different ones become unisex."""
    distinct = F.array_distinct(F.array_compact(hints))
    return F.when(F.size(distinct) == 1, distinct[0]).when(F.size(distinct) > 1, F.lit("unisex"))


def filled_from(items: DataFrame, config: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fill only missing fields from a registry that is matched by lower-case key."""
    c = config.select(F.lower(key).alias("low"), *[F.col(f).alias(f"cfg_{f}") for f in fields])
    out = items.withColumn("low", F.lower(F.trim(key))).join(c, "low", "left")
    return out.select(*[first_filled(F.col(x), F.col(f"cfg_{x}")).alias(x) if x in fields else F.col(x) for x in items.columns])


def renumbered(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Dense positions from 1 inside each list."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(order)))


def gallery(primary: Column, secondary: Column, limit: int = 24) -> Column:
    return F.slice(F.array_union(F.coalesce(primary, F.array().cast("array<string>")), F.coalesce(secondary, F.array().cast("array<string>"))), 1, limit)


URL = r"https?://[^\s<>\"]+"


def masked(text: Column) -> Column:
    """Struct of the text with its links as {{0}}, {{1}}, ... and the list of links."""
    links = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({URL})"), F.lit(1)))
    longest = F.array_sort(F.transform(links, lambda u, i: F.struct((-F.length(u)).alias("n"), i.alias("i"), u.alias("u"))))  # a link may start another
    out = F.aggregate(longest, F.coalesce(text, F.lit("")), lambda t, x: F.replace(t, x["u"], F.concat(F.lit("{{"), x["i"].cast("string"), F.lit("}}"))))
    return F.struct(out.alias("text"), links.alias("links"))


def unmasked(text: Column, links: Column) -> Column:
    pairs = F.transform(links, lambda u, i: F.struct(i.alias("i"), u.alias("u")))
    return F.aggregate(pairs, text, lambda t, x: F.replace(t, F.concat(F.lit("{{"), x["i"].cast("string"), F.lit("}}")), x["u"]))


def balanced_json(text: Column, marker: str) -> Column:
    """The JSON object that follows a marker, by brace depth outside strings; null if it never closes."""
    after = F.substring_index(F.concat(text, F.lit("")), marker, -1)
    rest = F.when(F.contains(text, F.lit(marker)) & F.contains(after, F.lit("{")), F.substr(after, F.locate("{", after)))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("i"), F.lit(0).alias("end"))

    def step(s: Column, c: Column) -> Column:
        live = s["end"] == 0
        quote = (c == '"') & ~s["escaped"]
        depth = s["depth"] + F.when(~s["quoted"] & (c == "{"), 1).when(~s["quoted"] & (c == "}"), -1).otherwise(0)
        i = s["i"] + 1
        return F.struct(
            F.when(live, depth).otherwise(s["depth"]).alias("depth"),
            (s["quoted"] != quote).alias("quoted"),
            (s["quoted"] & (c == "\\") & ~s["escaped"]).alias("escaped"),
            i.alias("i"),
            F.when(live & (depth == 0) & ~s["quoted"], i).otherwise(s["end"]).alias("end"),
        )

    end = F.aggregate(F.split(rest, ""), start, step, lambda s: s["end"])
    return F.when(end > 0, F.left(rest, end))


def json_ld_nodes(doc: Column) -> Column:
    """Nodes of a JSON-LD text as JSON strings: the members of @graph, of an array, or the object itself."""
    graph = F.get_json_object(doc, "$.@graph")
    items = F.coalesce(F.from_json(graph, "array<string>"), F.from_json(F.when(F.startswith(F.trim(doc), F.lit("[")), doc), "array<string>"))
    return F.coalesce(items, F.array(doc))
