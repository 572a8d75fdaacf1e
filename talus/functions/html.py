"""HTML by built-in functions: character references, attributes, meta, page signals, and JSON-LD as VARIANT."""

from __future__ import annotations

from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from talus.functions.columns import let, squeezed

#: Names that count without a semicolon too; longer ones first.
_BARE = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
_NAMED = "|".join(["[A-Za-z][A-Za-z0-9]*;", *_BARE])
REFERENCE = rf"&(?:#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|{_NAMED})"
_COMMON = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&nbsp;": " "}
#: What numbers from 128 to 159 stand for.
_WINDOWS = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)}


def _table(entries: dict) -> Column:
    """A constant map; ``str_to_map`` of a literal is folded once, before any row."""
    return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in entries.items())), F.lit("\x01"), F.lit("\x02"))


def _number(code: Column) -> Column:
    """The character of a code point; the replacement character where there is none, nothing for other control characters."""
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    bad = code.isNull() | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    control = code.between(1, 8) | code.between(14, 31) | (code == 11) | (code == 127) | code.between(0xFDD0, 0xFDEF) | (code % 65536 >= 65534)
    windows = F.try_element_at(_table(_WINDOWS), code.cast("string"))
    return F.when(bad, "�").when(control, "").when(code.between(128, 159), windows).otherwise(char)


def unescaped(text: Column) -> Column:
    """Character references decoded once, named and numbered, as browsers do; null stays null."""
    parts = F.regexp_extract_all(text, F.lit(rf"(?s)({REFERENCE}|[^&]+|&)"), F.lit(1))

    def one(p: Column) -> Column:
        return F.when(~p.startswith("&") | (p == "&"), p).otherwise(F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in _COMMON.items() for x in kv]), p), rare(p)))

    def rare(p: Column) -> Column:
        digits = F.regexp_replace(F.regexp_extract(p, r"^&#[xX]?([0-9A-Fa-f]+);?$", 1), "^0+", "")
        base16 = F.conv(digits, 16, 10).cast("long")
        code = F.when(digits == "", F.lit(0)).when(F.length(digits) > 7, F.lit(0x110000)).when(p.rlike("^&#[xX]"), base16).otherwise(digits.try_cast("long"))
        known = F.try_element_at(_table({f"&{k}": v for k, v in html5.items()}), p)
        # an unknown name with a semicolon may begin with a known one without
        prefix = F.regexp_extract(p, f"^&({'|'.join(_BARE)})", 1)
        short = F.concat(F.try_element_at(_table({k: html5[k] for k in _BARE}), prefix), F.substr(p, F.length(prefix) + 2))
        return F.when(p.startswith("&#"), _number(code)).otherwise(F.coalesce(known, F.when(prefix != "", short), p))

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(parts, one), "")).otherwise(text)


def attribute(tag: Column, name: str, decode: bool = True) -> Column:
    """The value of a tag's attribute, in single, double or no quotes, its references decoded; null without it."""
    quoted = r"""(?:[^\s"'>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?[\s/]*)*?"""
    head = rf"""(?is)^<[a-z][^\s/>]*[\s/]+{quoted}\b{name}\s*=\s*"""
    double, single, bare = (F.regexp_extract(tag, head + p, 1) for p in (r'"([^"]*)"', r"'([^']*)'", r"""([^\s"'>]+)"""))
    value = F.when(tag.rlike(head + r'"[^"]*"'), double).when(tag.rlike(head + "'[^']*'"), single).when(tag.rlike(head + r"""[^\s"'>]"""), bare)
    return unescaped(value) if decode else value


_TAG = r"""(?:[^"'>]|"[^"]*"|'[^']*')*"""
#: Comments, whole scripts and the like, tags, texts: the pieces of a page.
PIECES = rf"(?is)(<!--.*?(?:-->|$)|<(?:script|style|noscript|template)\b{_TAG}>.*?(?:</(?:script|style|noscript|template)\s*>|$)|</?[a-z]{_TAG}>|<![^>]*>|[^<]+|<)"


def pieces(html: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(PIECES), F.lit(1))


def text_of(html: Column, gap: str = " ") -> Column:
    """Text of a piece of HTML: pieces that are no tags, decoded and squeezed; ``gap`` stands where tags were."""
    shown = F.transform(pieces(html), lambda p: F.when(p.rlike(r"(?is)^<[a-z!/]"), F.lit(gap)).otherwise(unescaped(p)))
    return squeezed(F.array_join(shown, ""))


def meta(html: Column, key: str) -> Column:
    """Content of the first meta tag with this name or property and a filled content, attributes in any order; blank without one."""
    tags = F.filter(pieces(html), lambda p: p.rlike(r"(?i)^<meta\b"))
    named = F.filter(tags, lambda p: F.lower(F.coalesce(attribute(p, "name", False), attribute(p, "property", False))) == key.lower())
    values = F.filter(F.transform(named, lambda p: F.coalesce(attribute(p, "content", False), F.lit(""))), lambda v: squeezed(v) != "")
    return F.coalesce(squeezed(unescaped(F.get(values, F.lit(0)))), F.lit(""))


def page_signals(html: Column, blocked: str, limit: int = 5000) -> Column:
    """Struct (title, heading, meta_title, body, blocked): what a page says it is about.

    The heading is the first h1, else the first element with "title" in its
    class; meta_title is og:title, else the meta tag ``title``; body is cut to
    ``limit`` characters, and ``blocked`` looks for its pattern in all of them.
    """

    def of(page: Column) -> Column:
        title = text_of(F.regexp_extract(page, rf"(?is)<title\b{_TAG}>(.*?)</title", 1), "")
        h1 = text_of(F.regexp_extract(page, rf"(?is)<h1\b{_TAG}>(.*?)</h1", 1), "")
        classed = text_of(F.regexp_extract(page, r"""(?s)<([a-zA-Z][a-zA-Z0-9]*)\b[^>]*?\bclass\s*=\s*["'][^"']*[tT]itle[^"']*["'][^>]*>(.*?)</\1""", 2), "")
        inside = F.regexp_extract(page, rf"(?is)<body\b{_TAG}>(.*)", 1)
        body = let(inside, lambda b: text_of(F.when(b != "", b).otherwise(F.regexp_replace(page, r"(?is)<head\b.*?</head\s*>", ""))))
        og, plain = meta(page, "og:title"), meta(page, "title")
        return F.struct(
            title.alias("title"),
            let(h1, lambda x: F.when(x != "", x).otherwise(classed)).alias("heading"),
            let(og, lambda x: F.when(x != "", x).otherwise(plain)).alias("meta_title"),
            body.alias("body"),
        )

    def signals(s: Column) -> Column:
        every = F.concat_ws("\n", s["title"], s["heading"], s["meta_title"], s["body"])
        return F.struct(s["title"].alias("title"), s["heading"].alias("heading"), s["meta_title"].alias("meta_title"), F.left(s["body"], F.lit(limit)).alias("body"), every.rlike(f"(?i){blocked}").alias("blocked"))

    page = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "")
    return let(let(page, of), signals)


def json_ld(html: Column, depth: int = 3) -> Column:
    """Array of the JSON-LD nodes (VARIANT objects) of a page: members of arrays and of @graph, nested up to ``depth`` deep.

    A script that does not parse, even with its character references decoded, gives none.
    """
    scripts = F.filter(pieces(html), lambda p: p.rlike(r"(?i)^<script\b") & (F.lower(F.trim(attribute(p, "type", False))) == "application/ld+json"))
    bodies = F.transform(scripts, lambda p: F.regexp_extract(p, rf"(?is)^<script\b{_TAG}>(.*?)(?:</script\s*>)?$", 1))
    parsed = F.transform(bodies, lambda b: F.coalesce(F.try_parse_json(b), F.try_parse_json(unescaped(b))))

    def members(v: Column) -> Column:
        many = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$['@graph']", "array<variant>"))
        return F.coalesce(many, F.array(v))

    nodes = reduce(lambda nodes, _: F.flatten(F.transform(nodes, members)), range(depth), F.filter(parsed, lambda v: v.isNotNull()))
    return F.filter(nodes, lambda v: F.schema_of_variant(v).startswith("OBJECT"))


def json_ld_texts(html: Column, field: str, kind: str) -> Column:
    """Squeezed, filled values of a text field of the JSON-LD nodes whose @type (one or several) fits the pattern ``kind``."""

    def typed(v: Column) -> Column:
        return F.coalesce(F.try_variant_get(v, "$['@type']", "string"), F.lit("")).rlike(f"(?i){kind}")

    values = F.transform(F.filter(json_ld(html), typed), lambda v: squeezed(F.coalesce(F.try_variant_get(v, f"$['{field}']", "string"), F.lit(""))))
    return F.filter(values, lambda t: t != "")


def description(html: Column, least: int = 24, most: int = 600, kind: str = "product") -> Column:
    """Struct (text, source) of the first description of ``least`` characters: meta, og, JSON-LD of a product, description blocks; cut at a sentence's last comma."""
    block = rf"""(?is)<(div|section|p)\b[^>]*?(?:class\s*=\s*["'][^"']*(?:description|rte)[^"']*["']|itemprop\s*=\s*["']description["'])[^>]*>(.*?)</\1"""
    blocks = F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(block), F.lit(2)), lambda b: text_of(b))
    sources = (("meta", F.array(meta(html, "description"))), ("og", F.array(meta(html, "og:description"))), ("json_ld", json_ld_texts(html, "description", kind)), ("block", blocks))
    found = []
    for source, texts in sources:
        text = F.get(F.filter(texts, lambda t: F.length(t) >= least), F.lit(0))
        short = F.concat(F.regexp_replace(F.left(text, F.lit(most)), r"[，。,.!?！？；;]\S*$", ""), F.lit("。"))
        found.append(F.when(text.isNotNull(), F.struct(F.when(F.length(text) > most, short).otherwise(text).alias("text"), F.lit(source).alias("source"))))
    return F.coalesce(*found)
