"""Column helpers of the catalog rules: blanks, keys, links, prices, JSON text."""

from __future__ import annotations

import base64
import re

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it (inside lambdas too)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_blank(x: Column) -> Column:
    """Null, or nothing but white space (no-break and ideographic blanks too)."""
    return ~F.coalesce(x, F.lit("")).rlike(r"[^\s\x{A0}\x{3000}\x{FEFF}]")


def is_filled(value: Column, kind: str) -> Column:
    """Whether a value of a type (as ``dtypes`` names it) holds something: text but blanks, elements, entries, fields; other types: not null.

    A VARIANT is filled unless it is null, blank text, or an empty array or object.
    """
    if kind == "string":
        return ~is_blank(value)
    if kind.startswith(("array", "map")):
        return F.coalesce(F.size(value) > 0, F.lit(False))
    if kind == "variant":
        text = F.trim(F.coalesce(F.to_json(value), F.lit("")))
        return ~text.isin("", "null", "[]", "{}") & ~text.rlike(r'^"(\s|\\[nrtf])*"$')
    return value.isNotNull()


def first_filled(*xs: Column) -> Column:
    """First value that is not blank."""
    return F.coalesce(*[F.when(~is_blank(x), x) for x in xs])


def squeezed(x: Column) -> Column:
    """White space (no-break and ideographic blanks too) as single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"[\s 　]+", " "))


def name_key(x: Column) -> Column:
    """Lower case; only Han characters, a-z and digits stay."""
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{IsHan}a-z0-9]+", "")


def without_affixes(key: Column, prefixes: tuple[str, ...], suffixes: tuple[str, ...]) -> Column:
    """A name key without the known prefixes and suffixes."""
    out = F.regexp_replace(key, f"^(?:{'|'.join(prefixes)})+", "") if prefixes else key
    return F.regexp_replace(out, f"(?:{'|'.join(suffixes)})+$", "") if suffixes else out


def char_dice(a: Column, b: Column) -> Column:
    """Dice coefficient of the character sets; 0 if either is empty."""
    x, y = (F.array_distinct(F.split(F.coalesce(v, F.lit("")), "")) for v in (a, b))
    x, y = (F.filter(v, lambda c: c != "") for v in (x, y))
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(2.0 * both / (F.size(x) + F.size(y)))


def mergeable(a: Column, b: Column) -> Column:
    """Equal keys, one inside the other (six characters or more), or alike enough."""
    shorter = F.least(F.length(a), F.length(b))
    inside = (shorter >= 6) & (F.contains(a, b) | F.contains(b, a))
    return (a != "") & (b != "") & ((a == b) | inside | (char_dice(a, b) >= 0.72))


def url_host(url: Column) -> Column:
    """Host of a link, lower case, without www; blank if there is none."""
    return F.regexp_replace(F.lower(F.split_part(F.split_part(F.split_part(url, F.lit("/"), F.lit(3)), F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))), r"^www\.", "")


#: Query parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "spm", "fbclid", "gclid")


def canonical_url(url: Column, tracking: tuple[str, ...] = TRACKING) -> Column:
    """scheme-free link key: lower host without www, path without a last slash, kept parameters in order, no hash."""
    bare = F.regexp_replace(F.split_part(F.trim(F.coalesce(url, F.lit(""))), F.lit("#"), F.lit(1)), r"(?i)^https?://", "")
    path = F.regexp_replace(F.split_part(bare, F.lit("?"), F.lit(1)), r"/+$", "")
    host = F.regexp_replace(F.lower(F.split_part(path, F.lit("/"), F.lit(1))), r"^www\.", "")
    rest = F.regexp_replace(path, r"^[^/]*", "")
    params = F.filter(F.split(F.split_part(bare, F.lit("?"), F.lit(2)), "&"), lambda p: (p != "") & ~F.split_part(p, F.lit("="), F.lit(1)).isin(*tracking))
    return F.concat(host, rest, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(F.lit("")))


def item_id(url: Column) -> Column:
    """Number in the last path step of a link, null if there is none."""
    got = F.regexp_extract(F.coalesce(url, F.lit("")), r"/(\d+)(?:\.html)?/?(?:[?#].*)?$", 1)
    return F.when(got != "", got)


def numbers(text: Column) -> Column:
    """All decimal numbers of a text, in order."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=\d),(?=\d{3})", "")
    return F.transform(F.regexp_extract_all(plain, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double"))


def lowest_price(text: Column, limit: float = 100_000.0) -> Column:
    """Least number in (0, limit), null if there is none."""
    return F.array_min(F.filter(numbers(text), lambda p: (p > 0) & (p < limit)))


def first_price(text: Column) -> Column:
    return F.get(numbers(text), F.lit(0))


def plausible(primary: Column, secondary: Column, limit: float = 5000.0) -> Column:
    """First plausible amount, else any amount."""
    ok = [F.when((x > 0) & (x < limit), x) for x in (primary, secondary)]
    return F.coalesce(*ok, primary, secondary)


def minor_units(p: Column) -> Column:
    """Whole amounts of 1000 or more are in minor units."""
    return F.when((p == F.floor(p)) & (p >= 1000), p / 100).otherwise(p)


def positive_price(p: Column, currency: Column) -> Column:
    """A positive amount, else null; whole euro amounts of 1000 or more are in minor units, other currencies stay."""
    good = F.when(~F.isnan(p) & (p > 0) & (p < float("inf")), p)
    return F.when(F.upper(F.coalesce(currency, F.lit(""))) == "EUR", minor_units(good)).otherwise(good)


def converted(price: Column, rate: float = 7.2) -> Column:
    return F.floor(price * rate + 0.5)


def smallest_capture(text: Column, patterns: tuple[str, ...], low: float, high: float) -> Column:
    """Least number captured by any pattern within the limits, rounded."""
    found = reduce(lambda a, b: F.concat(a, b), [F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(1)) for p in patterns])
    values = F.transform(found, lambda x: F.floor(x.cast("double") + 0.5))
    return F.array_min(F.filter(values, lambda v: v.between(low, high)))


def waterproof_level(text: Column) -> Column:
    """IPXn if named, else 7 for submersible, 4 for splash-proof, else null."""
    named = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)ipx\s?(\d)", 1)
    return F.coalesce(
        F.when(named != "", named.cast("int")),
        F.when(text.rlike(r"(?i)submersible|fully waterproof"), 7),
        F.when(text.rlike(r"(?i)splash|water.?resistant"), 4),
    )


_ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&middot;": "·", "&copy;": "©", "&amp;": "&"}


def stripped_html(x: Column) -> Column:
    """Text of a piece of HTML: no scripts, styles and tags; named entities decoded; white space squeezed."""
    out = F.regexp_replace(F.coalesce(x, F.lit("")), r"(?is)<(script|style)\b.*?</\1>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for name, sign in _ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(sign))
    return squeezed(out)


def sentences(text: Column) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), r"(?<=[。！？!?.；;])\s+|\n+")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


#: A word's edge where letters, digits and _ are ASCII only, as in DuckDB and JavaScript; Java's \b counts accented letters up to version 18.
_EDGE = "(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"


def ascii_edges(pattern: str) -> str:
    """A Java pattern whose \\b is the edge of an ASCII word on every version."""
    return re.sub(r"\\(.)", lambda m: _EDGE if m[1] == "b" else m[0], pattern, flags=re.S)


def lowered(text: Column) -> Column:
    """Lower case, null as empty; a dotted capital I gives one i, as in DuckDB, not i and a combining dot."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u0130"), F.lit("i")))


def compacted(text: Column) -> Column:
    """Lower case without anything but Han characters, a-z and digits."""
    return name_key(text)


def distinctive_tokens(text: Column, generic: tuple[str, ...], limit: int = 24, phrases: tuple[str, ...] = ()) -> Column:
    """Latin words of three characters or more that begin with a letter and are not generic, known phrases, and Han runs.

    A phrase counts where the compacted text has it. Han runs count whole up
    to five characters, else by their 2-, 3- and 4-grams. Each token once, in
    this order, first ``limit``.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    latin = F.filter(F.regexp_extract_all(low, F.lit(r"([a-z][a-z0-9]{2,})"), F.lit(1)), lambda w: ~w.isin(*generic) if generic else F.lit(True))
    keys = [k for k in dict.fromkeys("".join(c for c in p.lower() if c.isalnum()) for p in phrases) if k]
    said = F.array_compact(F.array(*[F.when(F.contains(compacted(text), F.lit(k)), F.lit(k)) for k in keys])) if keys else F.array().cast("array<string>")
    runs = F.regexp_extract_all(low, F.lit(r"([\p{IsHan}]{2,})"), F.lit(1))
    of = lambda r, n: F.transform(F.sequence(F.lit(1), F.length(r) - (n - 1)), lambda i: F.substring(r, i, F.lit(n)))
    grams = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) <= 5, F.array(r)).otherwise(F.concat(of(r, 2), of(r, 3), of(r, 4)))))
    return F.slice(F.filter(F.array_distinct(F.concat(latin, said, grams)), lambda w: F.length(w) >= 2), 1, limit)


def recall(tokens: Column, hay: Column) -> Column:
    """Share of the tokens that occur in a text; null without tokens."""
    hit = F.size(F.filter(tokens, lambda t: F.contains(F.lower(hay), t)))
    return F.when(F.size(tokens) > 0, hit / F.size(tokens))


def overlap(a: Column, b: Column) -> Column:
    """Elements of a that b holds; repeats in a count."""
    return F.size(F.filter(a, lambda x: F.array_contains(b, x)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the common length, 0 for empty or zero vectors; double precision."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, 1, n), F.slice(b, 1, n)

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.coalesce(size, F.lit(0.0)) == 0, 0.0).otherwise(dot(a, b) / size)


def json_set(doc: Column, key: str, value: Column) -> Column:
    """A flat JSON object with one key set; null and 'null' count as an empty object."""
    return F.to_json(F.map_concat(_flat(doc, drop=(key,)), F.create_map(F.lit(key), value.cast("string"))))


def json_merge(old: Column, new: Column) -> Column:
    """Shallow merge of flat JSON objects; keys of the second win, its null values remove nothing."""
    kept = F.map_filter(_flat(new), lambda k, v: v.isNotNull())
    base = F.map_filter(_flat(old), lambda k, v: ~F.map_contains_key(kept, k))
    return F.to_json(F.map_concat(base, kept))


def _flat(doc: Column, drop: tuple[str, ...] = ()) -> Column:
    got = F.from_json(F.when((doc == "null") | is_blank(doc), "{}").otherwise(F.coalesce(doc, F.lit("{}"))), "map<string,string>")
    return F.map_filter(F.coalesce(got, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*drop)) if drop else got


def chunks(text: Column, limit: int) -> Column:
    """Whole lines joined to chunks of at most ``limit`` characters; longer lines are cut, blank lines between chunks go.

    The fold carries the first line and the length of the open chunk, and the
    borders of those that are done; texts are put together afterwards, so the
    work grows with the number of lines.
    """
    none = F.array().cast("array<struct<a:int,b:int>>")
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("a"), F.lit(0).alias("n"), none.alias("done"))

    def step(s: Column, size: Column) -> Column:
        joined = F.when(s["n"] > 0, s["n"] + 1 + size).otherwise(size)
        fits, long = joined <= limit, size > limit
        closed = F.when(s["n"] > 0, F.concat(s["done"], F.array(F.struct(s["a"].alias("a"), (s["i"] - 1).alias("b"))))).otherwise(s["done"])
        own = F.concat(closed, F.array(F.struct(s["i"].alias("a"), s["i"].alias("b"))))
        return F.struct(
            (s["i"] + 1).alias("i"),
            F.when(fits & (s["n"] > 0), s["a"]).otherwise(s["i"]).alias("a"),
            F.when(fits, joined).when(long, 0).otherwise(size).alias("n"),
            F.when(fits, s["done"]).when(long, own).otherwise(closed).alias("done"),
        )

    end = lambda s: F.when(s["n"] > 0, F.concat(s["done"], F.array(F.struct(s["a"].alias("a"), (s["i"] - 1).alias("b"))))).otherwise(s["done"])

    def cut(lines: Column) -> Column:
        ranges = F.aggregate(F.transform(lines, lambda x: F.length(x)), start, step, end)
        texts = F.transform(ranges, lambda r: F.array_join(F.slice(lines, r["a"] + 1, r["b"] - r["a"] + 1), "\n"))
        pieces = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / limit).cast("int")), lambda k: F.substring(x, k * limit + 1, F.lit(limit)))
        return F.flatten(F.transform(texts, pieces))

    whole = F.regexp_replace(F.coalesce(text, F.lit("")), "\r", "\n")
    return let(whole, lambda w: F.when(F.length(w) <= limit, F.array(w)).otherwise(let(F.split(w, "\n"), cut)))


def usd_rates(text: Column) -> Column:
    """Map from currency to its rate, of ``"USDxxx": ["rate"`` entries in a text; the last positive one of a currency counts."""
    entry = F.lit(r'"USD([A-Z]{3})"\s*:\s*\[\s*"([0-9.]+)"')
    names, rates = (F.regexp_extract_all(F.coalesce(text, F.lit("")), entry, F.lit(k)) for k in (1, 2))
    pairs = F.transform(F.arrays_zip(names.alias("c"), rates.alias("r")), lambda p: F.struct(p["c"].alias("c"), p["r"].try_cast("double").alias("r")))
    good = F.filter(pairs, lambda p: p["r"] > 0)
    last = F.filter(good, lambda p, i: ~F.exists(F.slice(good, i + 2, F.size(good)), lambda q: q["c"] == p["c"]))
    return F.map_from_arrays(F.transform(last, lambda p: p["c"]), F.transform(last, lambda p: p["r"]))


def cross_rates(rates: Column, to: str, needed: str, fallback: dict[str, float]) -> Column:
    """Units of ``to`` for one unit of each currency, from rates per dollar; the fallback if ``to`` or ``needed`` has no rate."""
    base = F.try_element_at(rates, F.lit(to))
    own = F.transform_values(rates, lambda c, r: F.when(c == to, F.lit(1.0)).otherwise(base / r))
    fixed = F.create_map(*[x for c, r in fallback.items() for x in (F.lit(c), F.lit(float(r)))])
    return F.when(base.isNotNull() & F.map_contains_key(rates, F.lit(needed)), own).otherwise(fixed)


def encrypted(payload: Column, key: Column) -> Column:
    """Struct (algorithm, iv, authTag, ciphertext; base64) of a text under AES-256-GCM with a new iv; ``key`` is 32 bytes."""
    sealed = F.aes_encrypt(payload.cast("binary"), key, F.lit("GCM"))

    def parts(b: Column) -> Column:
        size = F.octet_length(b)
        piece = lambda at, n: F.base64(F.substr(b, at, n))
        return F.struct(
            F.lit("aes-256-gcm").alias("algorithm"), piece(F.lit(1), F.lit(12)).alias("iv"), piece(size - 15, F.lit(16)).alias("authTag"), piece(F.lit(13), size - 28).alias("ciphertext")
        )

    return F.get(F.transform(F.array(sealed), parts), F.lit(0))  # the iv is random: sealed once, then taken apart


def decrypted(parts: Column, key: Column) -> Column:
    """The text of :func:`encrypted`; null if a part was changed or the key is another one."""
    sealed = F.concat(F.unbase64(parts["iv"]), F.unbase64(parts["ciphertext"]), F.unbase64(parts["authTag"]))
    return F.try_aes_decrypt(sealed, key, F.lit("GCM")).cast("string")


def secret_key(raw: str) -> Column:
    """A key of 32 bytes from 64 hex digits or base64; ValueError for anything else."""
    raw = raw.strip()
    try:
        key = bytes.fromhex(raw) if len(raw) == 64 and all(c in "0123456789abcdefABCDEF" for c in raw) else base64.b64decode(raw)
    except ValueError:
        key = b""
    if len(key) != 32:
        raise ValueError("the key must be 32 bytes, in hex or base64")
    return F.unhex(F.lit(key.hex()))
