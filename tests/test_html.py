"""HTML functions against Python's own parsers."""

import html
import json
import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from talus.functions import html as H
from talus.operators import tags as T


def squeeze(s):
    return " ".join(s.replace(" ", " ").split())


def test_unescaped_as_python(spark):
    r = random.Random(1)
    names = sorted(html.entities.html5)
    bits = ["&", "&amp;", "&amp;lt;", "&#60;", "&#x3C;", "&#0;", "&#x110000;", "&#xD800;", "&#128;", "&#1;", "&#99999999999;", "&copy 2", "&copyx;", "&notit;", "&;", "a", "é", "\n", ";", "#", "&#38", "&nosuch;", "&#x1F600;", "&#"]
    texts = ["".join(r.choice([r.choice(bits), f"&{r.choice(names)}"]) for _ in range(8)) for _ in range(400)] + ["", "plain"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", H.unescaped(F.col("t")).alias("u")).collect()
    bad = [(x.t, x.u, html.unescape(x.t)) for x in got if x.u != html.unescape(x.t)]
    assert not bad, bad[:3]


def test_attributes_and_meta(spark):
    tags = [
        """<meta name="description" content="a &amp; b">""", """<META content='x "y"' property=og:title>""", """<meta name=title content=plain />""",
        """<meta data-content="no" content = "yes" name='k'>""", """<meta content>""", """<meta title="content='trap'" content="real">""",
    ]
    got = spark.createDataFrame([(t,) for t in tags], "t string").select(H.attribute(F.col("t"), "content").alias("c")).collect()
    assert [x.c for x in got] == ["a & b", 'x "y"', "plain", "yes", None, "real"]
    page = "<!-- <meta name=description content=hidden> --><meta name=description content=''>" + "".join(tags)
    one = spark.createDataFrame([(page,)], "h string").select(H.meta(F.col("h"), "description").alias("d"), H.meta(F.col("h"), "og:title").alias("o"), H.meta(F.col("h"), "none").alias("n")).first()
    assert tuple(one) == ("a & b", 'x "y"', "")


def test_page_signals(spark):
    pages = [
        "<html><head><title>T &amp; t</title><meta content='M' property='og:title'></head><body><script>'<h1>no</h1>'</script><h1 class=x>Big <b>one</b></h1><p>Text&nbsp;here</p></body></html>",
        "<div class='page-Title big'>Named</div><p>Slide to Verify</p>", None, "",
    ]
    got = spark.createDataFrame([(p,) for p in pages], "h string").select(H.page_signals(F.col("h"), "slide to verify").alias("s")).select("s.*").collect()
    assert [tuple(x) for x in got] == [
        ("T & t", "Big one", "M", "Big one Text here", False), ("", "Named", "", "Named Slide to Verify", True), ("", "", "", "", False), ("", "", "", "", False),
    ]


def test_json_ld_nodes(spark):
    docs = [
        {"@type": "Product", "description": 'say "hi" {not} \\ [x] </b>'}, [{"@type": ["Thing", "Product"], "description": "b"}, {"@type": "Offer", "description": "no"}],
        {"@graph": [{"@graph": [{"@type": "product", "description": "deep"}]}, {"@type": "Product"}, 5]}, [[{"@type": "Product", "description": "in lists"}]], "text", 7,
    ]
    script = lambda t, body: f"<script data-x='1' type={t}>{body}</script>"
    page = "".join(script("'application/ld+json'", json.dumps(d)) for d in docs) + script("text/x", json.dumps(docs[0])) + script('"application/ld+json"', "{broken")
    page += script("application/ld+json", "{&quot;@type&quot;: &quot;Product&quot;, &quot;description&quot;: &quot;escaped&quot;}")
    df = spark.createDataFrame([(page,), (None,)], "h string")
    got = df.select(F.size(H.json_ld(F.col("h"))).alias("n"), H.json_ld_texts(F.col("h"), "description", "product").alias("d")).collect()
    assert got[0].d == ['say "hi" {not} \\ [x] </b>', "b", "deep", "in lists", "escaped"] and got[0].n == 7
    assert got[1].n == 0
    long = "word, " * 200
    two = spark.createDataFrame([(script("application/ld+json", json.dumps({"@type": "Product", "description": long})),), ("<p itemprop='description'>A block of <b>some length</b> it is</p>",)], "h string")
    assert [(x.source, len(x.text) <= 601, x.text[-1]) for x in two.select(H.description(F.col("h")).alias("d")).select("d.*").collect()] == [("json_ld", True, "。"), ("block", True, "s")]


class Cells(HTMLParser):
    """Cells by a stack of open tables; end tags of cells and rows may be missing."""

    def __init__(self):
        super().__init__()
        self.stack, self.cells, self.skip = [], [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        if tag == "table":
            self.stack.append({"rows": 0, "cell": None})
        elif self.stack and tag == "tr":
            self.stack[-1]["rows"] += 1
            self.stack[-1]["cell"] = None
        elif self.stack and tag in ("td", "th"):
            cell = {"depth": len(self.stack), "head": tag == "th", "row": (id(self.stack[-1]), self.stack[-1]["rows"]), "text": []}
            self.stack[-1]["cell"] = cell
            self.cells.append(cell)

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style")
        if tag == "table" and self.stack:
            self.stack.pop()
        elif self.stack and tag in ("td", "th", "tr"):
            self.stack[-1]["cell"] = None

    def handle_data(self, data):
        for t in self.stack if not self.skip else ():
            if t["cell"]:
                t["cell"]["text"].append(data)


def a_table(r, depth=0):
    rows = []
    for _ in range(r.randint(0, 3)):
        cells = []
        for _ in range(r.randint(0, 3)):
            tag = r.choice(["td", "th", "TD"])
            inner = r.choice(["x", "a &lt; b", "<b>bold</b> t", "", "<script>'<td>'</script>s", "<!-- <td>c</td> -->", " "]) if depth > 1 or r.random() < 0.8 else a_table(r, depth + 1) + " after"
            cells.append(f"""<{tag} title="a>b" class='{r.choice("xy")}'>{inner}""" + (f"</{tag}>" if r.random() < 0.7 else ""))
        rows.append("<tr>" + "".join(cells) + ("</tr>" if r.random() < 0.7 else ""))
    return "<table>" + "".join(rows) + "</table>"


def test_table_cells_as_a_parser(spark):
    r = random.Random(5)
    pages = ["".join(r.choice(["<p>out</p>", "</table>", "text ", ""]) + a_table(r) for _ in range(r.randint(0, 3))) for _ in range(80)] + [None, "<td>no table"]
    got = T.table_cells(spark.createDataFrame(list(enumerate(pages)), "id int, html string"), "id", "html").collect()
    found, want = {}, {}
    for c in sorted(got, key=lambda c: c.cell):
        found.setdefault(c.id, []).append((c.depth, c.head, c.text))
    for k, page in enumerate(pages):
        p = Cells()
        p.feed(page or "")
        p.close()
        if p.cells:
            want[k] = [(c["depth"], c["head"], squeeze(" ".join(c["text"]))) for c in p.cells]
    assert found == want


def test_pairs(spark):
    page = "<table><tr><th>Size</th><td>5 <i>mm</i></td></tr><tr><td>Make<td>Acme &amp; Co<td>x</tr><tr><td>alone</td></tr></table><table><td>k<td>v</table>"
    cells = T.table_cells(spark.createDataFrame([(1, page)], "id int, html string"), "id", "html")
    assert sorted((x.name, x.value) for x in T.row_pairs(cells, "id").collect()) == [("Make", "Acme & Co"), ("Size", "5 mm"), ("k", "v")]
    assert sorted((x.name, x.value) for x in T.spec_pairs(cells, "id").collect()) == [("5 mm", "Make"), ("k", "v")]
