"""Queries over pages: signals, tables, JSON-LD. Pages without tables or JSON-LD get them from their own navigation and headings."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.functions import html as H
from talus.functions.columns import squeezed
from talus.operators import tags as T
from talus.plans.registry import query, table

REFS = "{0}"  # the references that the given pages have; the query knows all
for _name, _sign in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("#39", "''"), ("lt", "<"), ("gt", ">"), ("nbsp", " "), ("amp", "&")):
    REFS = f"regexp_replace({REFS}, '&{_name};?', '{_sign}', 'g')"
SQUEEZED = "trim(regexp_replace({0}, '[\\s  　]+', ' ', 'g'))"
BARE = r"regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g')"


def _text(x: str, gap: str = " ") -> str:
    return SQUEEZED.format(REFS.format(f"regexp_replace({x}, '(?s)<[^>]*>', '{gap}', 'g')"))


@query(
    rf"""WITH b AS (SELECT page_id, {BARE} AS h FROM pages)
    SELECT page_id, {_text("regexp_extract(h, '(?is)<title[^>]*>(.*?)</title', 1)", "")} AS title, {_text("regexp_extract(h, '(?is)<h1[^>]*>(.*?)</h1', 1)", "")} AS heading, '' AS meta_title,
      left({_text("regexp_extract(h, '(?is)<body[^>]*>(.*)', 1)")}, 5000) AS body, regexp_matches(h, '(?i)login|captcha') AS blocked FROM b"""
)
def page_signals(spark, sf_dir):
    """What a page says it is about: title, heading, meta title, visible text, and whether it is a login or captcha page."""
    s = H.page_signals(F.col("html"), "login|captcha")
    return table(spark, sf_dir, "pages").select("page_id", s.alias("s")).select("page_id", "s.*")


LINK = r'<li><a href="([^"]*)">([^<]*)</a></li>'
ROW = r"<tr CLASS='a>b'><td>$1<td><b>$2</b></tr>"


@query(
    rf"""WITH l AS (SELECT page_id, unnest(list_zip(regexp_extract_all(html, '{LINK}', 1), regexp_extract_all(html, '{LINK}', 2))) AS x FROM pages)
    SELECT page_id, {SQUEEZED.format(REFS.format("x[1]"))} AS name, {SQUEEZED.format(REFS.format("x[2]"))} AS value FROM l WHERE trim(x[1]) <> '' AND trim(x[2]) <> ''"""
)
def dsc_table_pairs(spark, sf_dir):
    """Names and values of the tables of pages, their lists of links written as tables, by nesting depth and not by pattern."""
    rows = F.regexp_replace("html", LINK, ROW)
    tables = F.replace(F.replace(rows, F.lit("<ul>"), F.lit("<table id=x>")), F.lit("</ul>"), F.lit("</table>"))
    cells = T.table_cells(table(spark, sf_dir, "pages").select("page_id", tables.alias("html")), "page_id", "html")
    return T.row_pairs(cells, "page_id").select("page_id", "name", "value")


@query(
    rf"""WITH b AS (SELECT page_id, url, {_text(f"regexp_extract({BARE}, '(?is)<h1[^>]*>(.*?)</h1', 1)", "")} AS h FROM pages)
    SELECT page_id, 4 AS n_nodes, {SQUEEZED.format('''h || ' "quoted" \\ <' || '/b> ' || url''')} AS first, {SQUEEZED.format("h || ' ' || page_id")} AS last FROM b"""
)
def json_ld_products(spark, sf_dir):
    """Descriptions of the products in JSON-LD with escapes, lists and nested graphs, made of the pages' headings and put into the pages."""
    heading = H.page_signals(F.col("html"), "login")["heading"]
    text = lambda *c: F.to_json(F.struct(F.lit("Product").alias("@type"), F.concat(*c).alias("description")))
    one = text(heading, F.lit(' "quoted" \\ <'), F.lit("/b> "), F.col("url"))
    two = text(heading, F.lit(" "), F.col("page_id").cast("string"))
    graph = F.concat(F.lit('{"@graph": [{"@graph": ['), one, F.lit(']}, {"@type": "Offer", "description": "{no}"}]}'))
    several = F.concat(F.lit('[{"@type": ["Thing", "Product"]}, '), two, F.lit("]"))
    script = lambda body: F.concat(F.lit("<script id=a TYPE = 'application/ld+json'>"), body, F.lit("</script>"))
    page = F.concat(F.coalesce("html", F.lit("")), script(graph), script(several), script(F.lit("{broken")))
    p = table(spark, sf_dir, "pages").select("page_id", page.alias("page"))
    texts = H.json_ld_texts(F.col("page"), "description", "product")
    out = p.select("page_id", F.size(H.json_ld(F.col("page"))).alias("n_nodes"), texts.alias("t"))
    return out.select("page_id", "n_nodes", squeezed(F.get("t", F.lit(0))).alias("first"), squeezed(F.get("t", F.lit(1))).alias("last"))
