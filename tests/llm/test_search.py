"""Nearest neighbours, decontamination and page text against brute force."""

import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from talus.llm.htmltext import main_text
from talus.llm import ann, htmltext
from talus.llm import decontaminate as dc


def vectors(n=900, dim=24):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, dim)) * 2
    x = (centres[rng.integers(0, 6, n)] + rng.normal(size=(n, dim))).astype(np.float32)
    x[200:500] = x[7]  # copies: ties by id
    rows = [(i, x[i].tolist(), "c") for i in range(n)]
    rows += [(2000, None, "c"), (2001, [0.0] * dim, "c"), (2002, [float("nan")] + [1.0] * (dim - 1), "c"), (2003, [None] + [1.0] * (dim - 1), "c"), (2004, [float("inf")] * dim, "c"), (None, [1.0] * dim, "c"), rows[3]]
    return rows, x.astype(float)


@pytest.mark.parametrize("block", [100, 8192])
def test_neighbours(spark, block):
    rows, x = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=20, code_block=block, query_block=block // 4).collect():
        got.setdefault(r.query_id, []).append(r)
    ids = np.arange(len(x))
    hits = total = 0
    assert sorted(got) == [i for i in ids if i % 20 == 0]
    for q, rs in got.items():
        rs.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == list(range(1, 21))
        s = np.array([float(np.dot(v, x[q])) for v in x])
        order = [i for i in np.lexsort((ids, -np.round(s, 9))) if i != q][:20]
        hits += len(set(order) & {r.vec_id for r in rs})
        total += 20
        assert all(abs(r.score - s[r.vec_id]) < 1e-9 for r in rs)
        assert all(a.score > b.score - 1e-12 and (a.score - b.score > 1e-9 or a.vec_id < b.vec_id or a.score != b.score) for a, b in zip(rs, rs[1:]))
    assert hits / total >= 0.99


def test_few_candidates_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 0.0]), (20, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 20, 5.0), (0, 2, 1, 1.0), (20, 1, 0, 5.0), (20, 2, 1, 1.0)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_repeated_ids_are_rows(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [0.5, 0.5]), (7, [2.0, 0.0]), (2**53 + 1, [0.1, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") == 20).collect())
    one = [(1, 7, 2.0), (2, 20, 1.0), (3, 20, 0.5), (4, 2**53 + 1, 0.1)]
    other = [(1, 7, 1.0), (2, 20, 0.5), (3, 20, 0.5), (4, 2**53 + 1, 0.05)]
    assert got == sorted((20, *r) for r in one + one + other)


def test_few_are_reranked():
    """On sf0.1 under a tenth of the rows survive the bounds, with nearly all of the nearest among them."""
    x = np.array([r[0] for r in duckdb.sql("select embedding from '/root/testdata/sf0.1/embeddings.parquet' order by vec_id").fetchall()])
    coder = ann.BitCoder(x, x.shape[1])
    words, near, norm, align = coder.encode(x)
    q = x[::20]
    exact = q @ x.T
    floor = np.sort(exact, axis=1)[:, -21]
    kept = np.zeros(exact.shape, bool)
    for c in range(len(coder.centres)):
        at = np.flatnonzero(near == c)
        i, j, est = coder.survivors(q, c, words[at], norm[at], align[at], floor)
        kept[i, at[j]] = True
        assert np.abs(est - exact[i, at[j]]).max() < 0.2
    assert kept.mean() < 0.1
    assert kept[exact >= floor[:, None]].mean() > 0.97


def slow_distance(item, text):
    """Least edit distance of an item to any stretch of a text, and its first end."""
    row = list(range(len(item) + 1))
    best, end = row[-1], 0
    for j, c in enumerate(text, 1):
        new = [0]
        for i, d in enumerate(item, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (c != d)))
        row = new
        if row[-1] < best:
            best, end = row[-1], j
    return best, end


def test_bit_parallel_distance():
    rng = random.Random(1)
    for _ in range(200):
        item = "".join(rng.choices("abc", k=rng.randint(1, 90)))
        text = "".join(rng.choices("abc", k=rng.randint(0, 120)))
        best = min([(len(item), 0), *dc.Myers(item).ends(text, len(item))])
        assert best == slow_distance(item, text)
        whole = [d for d, end in dc.Myers(item).ends(text, 10**6, anchored=True) if end == len(text)]
        assert whole == ([slow_edit(item, text)] if text else [])


def slow_edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def slow_place(item, text, errors):
    """(distance, end, begin) of the best stretch of whole words of a normalised text, trying all."""
    if len(item) < dc.SHORT:
        d = slow_edit(item, text)
        return (d, len(text), 0) if d <= errors and text else None
    best = None
    for a in range(len(text)):
        if dc.splits_word(text, a):
            continue
        row = list(range(len(item) + 1))
        for b in range(a + 1, min(len(text), a + len(item) + errors) + 1):
            new = [b - a]
            for i, d in enumerate(item, 1):
                new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (text[b - 1] != d)))
            row = new
            if row[-1] <= errors and not dc.splits_word(text, b):
                best = min(best or (99, 0, 0), (row[-1], b, a))
    return best


def test_matches_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(4, 16)))) for i in range(12)] + [(50, None), (51, ""), (52, "short one"), (53, "the"), (None, " ".join(word() for _ in range(9)))]
    docs = []
    for i in range(60):
        text = " ".join(word() for _ in range(20))
        if i % 2:
            it = list(items[rng.randrange(13) if i % 3 else 16][1] or "x")
            for _ in range(rng.randint(0, 6)):
                it[rng.randrange(len(it))] = rng.choice("abcdefghij ")
            glue = rng.choice(["", " "])
            text = text[:40] + "\n" + "".join(it).upper() + glue + text[40:]
        docs.append((i, text))
    docs += [(100, None), (101, ""), docs[1], (102, "Short  onE"), (103, "a short one"), (104, "other THE"), (105, "The"), (2**53 + 1, f"x {items[0][1]} y"), (None, f"x {items[1][1]}, y")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: tuple((x is None, x) for x in r)
    for size in (300, 8 << 20):
        got = sorted(((r.doc_id, r.item_id, r.distance, r.begin, r.finish) for r in dc.matches(d, b, block_bytes=size).collect()), key=key)
        want = []
        for i, t in docs:
            for k, it in items:
                n, text = dc.normal(it), dc.normal(t)
                best = slow_place(n, text, int(len(n) * dc.RATE)) if n else None
                if best:
                    at = dc.places(t)
                    want.append((i, k, best[0], at[best[2]], at[best[1] - 1] + 1))
        assert got == sorted(want, key=key)
        assert {r[0] for r in got} > {102, 105, 2**53 + 1, None} and not {r[0] for r in got} & {103, 104}
    assert dc.matches(d, b.limit(0)).collect() == [] and dc.matches(d.limit(0), b).collect() == []


def test_places_of_normalised_text():
    for t in ("  A b\n\tC ", "İx ΑΣ  y", "a", ""):
        at = dc.places(t)
        assert len(at) == len(dc.normal(t)) and at == sorted(at)
    assert [" A  bC "[i] for i in dc.places(" A  bC ")] == ["A", " ", "b", "C"]


def slow_cut(unary, edges):
    best = None
    for m in range(1 << len(unary)):
        lab = [m >> i & 1 for i in range(len(unary))]
        cost = sum((-u if lx else 0) if u < 0 else (0 if lx else u) for u, lx in zip(unary, lab)) + sum(w for (i, j), w in edges.items() if lab[i] != lab[j])
        best = cost if best is None else min(best, cost)
    return best


def test_cut_is_least():
    rng = random.Random(6)
    for _ in range(150):
        n = rng.randint(1, 9)
        unary = [rng.uniform(-2, 2) for _ in range(n)]
        edges = {(i, j): rng.uniform(0, 2) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}
        lab = htmltext.min_cut(unary, edges)
        cost = sum((-u if lx else 0) if u < 0 else (0 if lx else u) for u, lx in zip(unary, lab)) + sum(w for (i, j), w in edges.items() if lab[i] != lab[j])
        assert abs(cost - slow_cut(unary, edges)) < 1e-9


PAGE = """<html><head><title>no</title><style>p{}</style></head><body class="has-sidebar"><!-- x > y --><header><div class="logo">Site</div>
<ul class=menu><li><a href=/>Home</a></li></ul></header><div id="cookie-notice">We use cookies to improve your visit. Accept them all please.</div>
<div class="wrap with-sidebar"><main><article class="post"><header><h1>A title here</h1></header><p>First &amp; foremost, a
paragraph.&nbsp;It has <b>text</b>.<div class="ad-slot"><p>Buy this great thing now. It is cheap. Really cheap.</p></div><p>Second &#233;t follows<br>here.</p>
<ul><li>short item<li>another item</ul><aside>Related stories that we want you to read.</aside><form><label>Email</label><button>Go</button></form></article>
<section class="comments"><h2>Comments</h2><article class="comment"><p>I really like this article. It is great. Thanks so much.</p></article></section></main>
<div class="sidebar"><p>About the author: they write many things. Read it all.</p></div></div><script>var a = "<p>not text</p>"</script><footer>&copy; 2020 all of it</footer>"""


def test_page_text():
    want = "A title here\nFirst & foremost, a paragraph. It has text.\nSecond ét follows here.\nshort item\nanother item"
    assert htmltext.main_text(PAGE) == want


PROSE = "A long paragraph of prose stands here, with many words in it. It has two sentences at least, and they go on for a while."


@pytest.mark.parametrize(
    "name", "side-effects related-work links toc social-science search-results-study menu-recipes legal-analysis share-prices comment-history form-of-government notice-of-appeal flash-fiction".split()
)
def test_names_do_not_outweigh_prose(name):
    page = f"<nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{PROSE}</p><div class={name}><p>Kept {PROSE}</p></div><p>{PROSE}</p></article><footer>foot</footer>"
    assert htmltext.main_text(page) == f"Title\n{PROSE}\nKept {PROSE}\n{PROSE}"


@pytest.mark.parametrize("name", "comments ad ad-slot cookie-notice share-buttons sidebar newsletter-signup related-posts commentList".split())
def test_names_of_boilerplate(name):
    page = f"<article><h1>Title</h1><p>{PROSE}</p><div class='{name}'><p>Gone {PROSE}</p></div><p>{PROSE}</p></article>"
    assert htmltext.main_text(page) == f"Title\n{PROSE}\n{PROSE}"


def test_whole_page_in_a_form():
    page = f"<body><form id=f><div id=nav><a href=x>Home</a></div><h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p></form>"
    assert htmltext.main_text(page) == f"Title\n{PROSE}\n{PROSE}"


@pytest.mark.parametrize("tag", ["math", "svg", "object", "noscript", "fieldset"])
def test_elements_that_hold_article_text(tag):
    assert "zz yy" in htmltext.main_text(f"<article><p>{PROSE}</p><p>Here <{tag}>zz yy</{tag}> end of it.</p><p>{PROSE}</p></article>")


def test_unclosed_quotes_are_markup():
    assert htmltext.main_text(f'<article><p>{PROSE} <a href="x>link</a> more</p></article>') == f"{PROSE} link more"


def test_the_cut_changes_labels():
    """Short blocks go with what stands around them: prose keeps them, a linked list takes them along."""
    for page, text, alone, want in (
        (f"<div><p>{PROSE}</p><p>Yes.</p><p>{PROSE}</p></div>", "Yes.", False, True),
        ("<div><ul><li><a>one</a></li><li>Two words: three; four. Five!</li><li><a>six</a></li><li><a>seven</a></li></ul></div>", "Two words: three; four. Five!", True, False),
    ):
        blocks, costs, keep = htmltext.labelled(page)
        k = [b.text for b in blocks].index(text)
        assert (costs[k] > 0) == alone and keep[k] == want


def test_pages_of_the_test_data():
    """Their main text is the article; on some pages the cut and not the cost alone makes it so."""
    changed = 0
    for (page,) in duckdb.sql("select html from '/root/testdata/sf0.1/pages.parquet'").fetchall():
        blocks, costs, keep = htmltext.labelled(page)
        changed += any((c > 0) != k for c, k in zip(costs, keep))
        article = page.split("<article>")[1].split("</article>")[0]
        assert [b.text for b, k in zip(blocks, keep) if k] == [b.text for b in htmltext.parsed(article)[1]]
    assert changed > 0


@pytest.mark.parametrize("unit", ['<a b="c ', '<a b="c>', "<div>", "<p>a.<b>", "</p><div>", "<select>", "<a '\">", "<p>word. <li><a>x</a>"])
def test_broken_pages_take_linear_time(unit):
    began = time.perf_counter()
    htmltext.main_text(unit * (1_000_000 // len(unit)))
    assert time.perf_counter() - began < 10


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!-- never closed", "<script>x", "<p class='a>b", "</div></p>", "&amp", "<a" * 5000, "<div>" * 3000 + "x"])
def test_broken_pages(page):
    assert isinstance(htmltext.main_text(page), str)


def test_extract_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "t"), (2, None, None, "t"), (1, "u", PAGE, "t"), (None, "v", "<nav>x</nav>", None), (2**53 + 1, "w", PAGE, None)], "page_id long, url string, html string, text string")
    rows = htmltext.extract(df).collect()
    assert len(rows) == 5 and {2**53 + 1, None} < {r.page_id for r in rows} and all(r.n_chars == len(r.text) for r in rows)
    assert [r.text for r in rows if r.page_id in (2, None)] == ["", ""]
    assert htmltext.extract(df.limit(0)).collect() == []


def test_short_pages_and_comment_headings():
    long = "Long text here, with words. " * 20
    cases = {
        "<nav><a href=/>Home</a></nav><h1>Notice</h1><p>Closed.</p><footer>2020 us</footer>": "Notice\nClosed.",
        "<p>Hello.</p>": "Hello.",
        "<div>Roses are red</div><div>violets are blue</div>": "Roses are red\nviolets are blue",
        f"<article><h1>T</h1><p>{long}</p><section><h2>Kommentare</h2><p>Great article, I liked it very much.</p></section></article>": f"T\n{long.strip()}",
        f"<article><h1>T</h1><p>{long}</p><h2>Reader comments (3)</h2><p>I liked it very much, thank you.</p><h2>Sources</h2><p>One more paragraph, of sentences. And more.</p></article>": f"T\n{long.strip()}\nSources\nOne more paragraph, of sentences. And more.",
        f"<noscript>Please enable JavaScript to view this page.</noscript><p>{long}</p>": long.strip(),
        "<nav><a href=/>Home</a></nav>": "",
        "<div class=cookie>We use cookies</div>": "",
    }
    for page, want in cases.items():
        assert main_text(page) == want


def test_short_items_match_anywhere_if_asked():
    items = [(1, "Short one"), (2, "the")]
    assert [m[0] for m in dc.Matcher(items, dc.RATE).match("a short ONE here")] == []
    assert [m[0] for m in dc.Matcher(items, dc.RATE, 0).match("a short ONE here")] == [1]
    assert [m[0] for m in dc.Matcher(items, dc.RATE, 0).match("in the other")] == [2]
    assert [m[0] for m in dc.Matcher(items, dc.RATE, 0).match("in other places")] == []
