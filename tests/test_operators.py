"""Edge rows of the catalog operators on hand-built frames."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talus.functions import columns as X
from talus.operators import adjustments as A
from talus.operators import candidates as C
from talus.operators import catalog as K
from talus.operators import events as E
from talus.operators import ingest as I
from talus.operators import ranking as R
from talus.operators import related
from talus.operators import rules as T
from talus.operators import scoring as S


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_soft_filters_let_unknown_values_pass(spark):
    p = C.Preferences(budget=(0, 100), max_noise=40, waterproof=5)
    df = spark.createDataFrame([(1, 50.0, None, None), (2, None, 41, 7), (3, None, 30, 7), (4, 100.0, 40, 4)], "id int, price double, noise int, w int")
    assert [r.id for r in df.where(C.soft_ok(F.col("price"), F.col("noise"), F.col("w"), p)).collect()] == [1, 3]
    free = C.Preferences(max_noise=0, waterproof=0)
    assert df.where(C.soft_ok(F.col("price"), F.col("noise"), F.col("w"), free)).count() == 4


@pytest.mark.parametrize(
    ("price", "band"), [(99.99, "under_100"), (100.0, "100_to_300"), (300.0, "100_to_300"), (500.0, "300_to_500"), (1000.0, "500_to_1000"), (1000.01, "over_1000")]
)
def test_price_bands(spark, price, band):
    assert one(spark, b=C.price_band(F.lit(price), (100.0, 300.0, 500.0, 1000.0))).b == band


def test_half_up_below_zero(spark):
    assert one(spark, a=S.half_up(F.lit(-2.5)), b=S.half_up(F.lit(2.5))) == (-2, 3)


def test_ties_go_by_id(spark):
    df = spark.createDataFrame([(i, "a", "b", 10.0, 5, None) for i in (3, 1, 2)], "id int, kind string, brand string, price double, noise int, waterproof int")
    top = S.top_ranked(S.score_columns(df, C.Preferences(kind="a", budget=(0.0, 20.0), max_noise=9), S.PRESETS["balanced"]), 3)
    assert [(r.id, r["rank"]) for r in top.orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 3)]


def test_preset_share(spark):
    df = spark.createDataFrame([(1,), (1,), (0,)], "m int")
    assert S.preset_by_share(df, F.col("m") == 1, 0.35, "y", "n").first().preset == "y"
    assert S.preset_by_share(df.limit(0), F.col("m") == 1, 0.35, "y", "n").first().preset == "n"


def test_diversity_equals_greedy(spark):
    rng = random.Random(0)
    for _ in range(5):
        labels = [rng.choice("abc") for _ in range(12)]
        seen, want = set(), []
        for i, x in enumerate(labels):
            if x not in seen:
                seen.add(x)
                want.append(i)
        want += [i for i in range(12) if i not in want]
        df = spark.createDataFrame([(i, x, i + 1) for i, x in enumerate(labels)], "id int, label string, rank int")
        got = [r.id for r in R.diversified(df, "label", 6).orderBy("pick").collect()]
        assert got == want[:6]


def test_constant_pool_and_unknowns(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, None)], "id int, x double")
    got = {r.id: r.v for r in R.with_range(df, "x").select("id", R.min_max("x").alias("v")).collect()}
    assert got == {1: 0.5, 2: 0.5, 3: -1.0}


def test_reconcile_repeats_and_padding(spark):
    pool = spark.createDataFrame([(i, i) for i in range(1, 6)], "id long, rank int")
    ext = spark.createDataFrame([(4, 1), (4, 2), (99, 3), (2, 4)], "id long, ext_rank int")
    assert [r.id for r in R.reconciled(pool, ext, 3).orderBy("final_rank").collect()] == [4, 2, 1]


def test_text_keys(spark):
    r = one(
        spark,
        squeezed=X.squeezed(F.lit(" a 　 b\n")),
        key=X.name_key(F.lit("“Ab-C” 3™ 中文")),
        dice=X.char_dice(F.lit("abc"), F.lit("abd")),
        empty=X.char_dice(F.lit(""), F.lit("a")),
        blank=X.is_blank(F.lit(None).cast("string")),
        affix=X.without_affixes(F.lit("thefoopro"), ("the",), ("pro", "max")),
    )
    assert r.squeezed == "a b" and r.key == "abc3中文" and r.blank and r.affix == "foo"
    assert abs(r.dice - 4 / 6) < 1e-9 and r.empty == 0


@pytest.mark.parametrize(("a", "b", "yes"), [("abc", "abc", True), ("abcdef", "xxabcdefyy", True), ("ab", "abzzzzzzq", False), ("", "a", False), ("abcd", "wxyz", False)])
def test_mergeable(spark, a, b, yes):
    assert one(spark, m=X.mergeable(F.lit(a), F.lit(b))).m is yes


def test_links(spark):
    r = one(
        spark,
        a=X.canonical_url(F.lit("HTTPS://www.Shop.com/Item/?utm_source=x&id=5#top")),
        b=X.canonical_url(F.lit("shop.com/Item")),
        none=X.canonical_url(F.lit(None).cast("string")),
        host=X.url_host(F.lit("http://www.A.org?x=1")),
        item=X.item_id(F.lit("http://a/b/533.html?x")),
        no=X.item_id(F.lit("http://a/b")),
    )
    assert r.a == "shop.com/Item?id=5" and r.b == "shop.com/Item" and r.none == "" and r.host == "a.org" and r.item == "533" and r.no is None


def test_prices(spark):
    r = one(
        spark,
        low=X.lowest_price(F.lit("was 1,299.50 now 999 (0)")),
        none=X.lowest_price(F.lit("call us")),
        p=X.plausible(F.lit(9999.0), F.lit(20.0)),
        m=X.minor_units(F.lit(12900.0)),
        fx=X.converted(F.lit(10.0)),
        db=X.smallest_capture(F.lit("below 45.6 dB, <50dB, 5 dB"), (r"(\d+(?:\.\d+)?)\s?dB",), 15, 90),
        ip=X.waterproof_level(F.lit("IPX6 rated")),
        sub=X.waterproof_level(F.lit("fully waterproof")),
    )
    assert (r.low, r.none, r.p, r.m, r.fx, r.db, r.ip, r.sub) == (999.0, None, 20.0, 129.0, 72, 46, 6, 7)


def test_json(spark):
    r = one(
        spark,
        s=X.json_set(F.lit('{"a":"1"}'), "a", F.lit("2")),
        n=X.json_set(F.lit("null"), "a", F.lit("2")),
        m=X.json_merge(F.lit('{"a":"1","b":"2"}'), F.lit('{"b":null,"c":"3"}')),
    )
    assert r.s == '{"a":"2"}' and r.n == '{"a":"2"}' and r.m == '{"a":"1","b":"2","c":"3"}'


def test_vectors(spark):
    d = lambda *v: F.array(*map(F.lit, v)).cast("array<double>")
    r = one(spark, a=X.cosine(d(1.0, 0.0), d(1.0, 0.0, 9.0)), z=X.cosine(d(0.0, 0.0), d(1.0, 1.0)), n=X.cosine(F.lit(None).cast("array<double>"), d(1.0)), o=X.overlap(d(1, 1, 2), d(1, 3)))
    assert (r.a, r.z, r.n, r.o) == (1.0, 0.0, 0.0, 2)


def test_html_and_sentences(spark):
    r = one(spark, h=X.stripped_html(F.lit("<p>a &amp; b<script>x<y</script></p><br>c&nbsp;d")), s=X.sentences(F.lit("One. Two!\nThree；")))
    assert r.h == "a & b c d" and r.s == ["One.", "Two!", "Three；"]
    c = one(spark, c=X.chunks(F.lit("aa\nbb\ncccccc\nd"), 5)).c
    assert c == ["aa\nbb", "ccccc", "c", "d"]
    c = one(spark, c=X.chunks(F.lit("\n\naa\r\nbb\n\n\n"), 4)).c
    assert c == ["aa\n", "bb\n\n"]


def plain_chunks(text, most):
    text = text.replace("\r", "\n")
    if len(text) <= most:
        return [text]
    out, open_ = [], ""
    for line in text.split("\n"):
        more = f"{open_}\n{line}" if open_ else line
        if len(more) <= most:
            open_ = more
            continue
        out += [open_] if open_ else []
        open_ = line if len(line) <= most else ""
        out += [] if len(line) <= most else [line[i : i + most] for i in range(0, len(line), most)]
    return [c for c in [*out, open_] if c]


def test_chunks_as_a_loop_and_in_linear_time(spark):
    import random
    import time

    r = random.Random(1)
    texts = ["\n".join("x" * r.choice([0, 0, 1, 3, 7, 30]) for _ in range(r.randint(0, 12))) for _ in range(200)] + ["", "\n\n"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.chunks(F.col("t"), 10).alias("c")).collect()
    assert all(x.c == plain_chunks(x.t, 10) for x in got)
    long = "\n".join("line %d" % i for i in range(100_000))
    df = spark.createDataFrame([(long,)], "t string").select(X.chunks(F.col("t"), 14_000).alias("c"))
    began = time.time()
    c = df.first().c
    assert "\n".join(c) == long and max(map(len, c)) <= 14_000 and time.time() - began < 20


def test_rates_and_secrets(spark):
    text = F.lit('x "USDCNY": ["7.0"], "USDTWD" : [ "35.0", 1], "USDEUR":["0.5"], "USDEUR":["0.8"], "USDBAD":["."], "USDNIL":["0"]')
    rates = X.usd_rates(text)
    r = one(spark, r=rates, c=X.cross_rates(rates, "CNY", "TWD", {"TWD": 0.22}), f=X.cross_rates(X.usd_rates(F.lit('"USDCNY":["7"]')), "CNY", "TWD", {"CNY": 1, "TWD": 0.22}))
    assert r.r == {"CNY": 7.0, "TWD": 35.0, "EUR": 0.8} and r.c == {"CNY": 1.0, "TWD": 0.2, "EUR": 8.75} and r.f == {"CNY": 1.0, "TWD": 0.22}
    key, other = X.secret_key("00" * 32), X.secret_key("QUJD" * 10 + "QUI=")
    df = spark.createDataFrame([('{"a": "é"}',), ("",), (None,)], "p string").withColumn("e", X.encrypted(F.col("p"), key))
    df = spark.createDataFrame(df.collect(), df.schema)  # as stored
    assert [x.e.algorithm for x in df.collect()[:2]] == ["aes-256-gcm"] * 2 and len({x.e.iv for x in df.collect()}) >= 2
    flipped = F.col("e").withField("authTag", F.translate("e.authTag", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghij", "BADCFEHGJILKNMPORQTSVUXWZYbadcfehgji"))
    got = df.select("p", X.decrypted(F.col("e"), key).alias("d"), X.decrypted(flipped, key).alias("t"), X.decrypted(F.col("e"), other).alias("o")).collect()
    assert all(x.d == x.p and x.t is None and x.o is None for x in got)
    for bad in ("", "00", "zz" * 32):
        with pytest.raises(ValueError):
            X.secret_key(bad)


def test_tokens_of_han_and_latin(spark):
    got = one(spark, t=X.distinctive_tokens(F.lit("The Rose 玫瑰 中文字符测试词 rose"), ("the",))).t
    assert got == ["rose", "玫瑰", "中文", "文字", "字符", "符测", "测试", "试词", "中文字", "文字符", "字符测", "符测试", "测试词", "中文字符", "文字符测", "字符测试", "符测试词"]
    got = one(spark, t=X.distinctive_tokens(F.lit("4ever 9 Po-Lly x2y ab 小猫 咪"), (), 24, ("Polly", "小猫咪", "none"))).t
    assert got == ["ever", "lly", "x2y", "polly", "小猫咪", "小猫"]
    assert one(spark, r=X.recall(F.array(F.lit("ab"), F.lit("zz")), F.lit("xABx"))).r == 0.5


def test_fallback_join_and_fan_out(spark):
    items = spark.createDataFrame([(1, 7, "x"), (2, None, "ACME"), (3, None, " ")], "id int, b int, name string")
    brands = spark.createDataFrame([(7, "foo", "US"), (8, "acme", "DE"), (9, "Acme", "FR")], "b int, name string, country string")
    got = sorted((r.id, r.country) for r in K.fallback_join(items, brands, "b", "name").collect() if r.country)
    assert got == [(1, "US"), (2, "DE"), (2, "FR")]


def test_duplicates_merge_and_partition(spark):
    df = spark.createDataFrame([(1, "k", 5, "", "short"), (2, "k", 9, "b", "longest text"), (3, " ", 1, None, "x"), (4, "z", 1, "c", "y")], "id int, key string, score int, a string, t string")
    got = K.duplicate_groups(df, "key", F.col("score"), "id").collect()
    assert {(r.id, r.keeper) for r in got} == {(1, 2), (2, 2)}
    m = K.merged_fields(df.where("key = 'k'"), "key", [F.col("id")], ["a"], ["t"]).first()
    assert (m.a, m.t) == ("b", "longest text")
    rows = spark.createDataFrame([(1, "n", "B"), (2, "n", ""), (3, "m", "x"), (4, "m", "y"), (5, "m", None)], "id int, name string, brand string")
    keys = {r.id: r.group_key for r in K.brand_partition(rows, "name", "brand").collect()}
    assert keys == {1: "n|b", 2: "n|b", 3: "m|x", 4: "m|y", 5: "m|"}


def test_keep_first_spares_placeholders(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "ph"), (4, "ph"), (5, None), (6, None)], "o int, k string")
    got = K.keep_first(df, ["k"], "o", F.coalesce(F.col("k") == "ph", F.lit(False)))
    assert sorted(r.o for r in got.collect()) == [1, 3, 4, 5]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, x string, y int")
    new = spark.createDataFrame([(2, None, 5), (3, "c", None)], "id int, x string, y int")
    assert sorted(K.keep_filled(old, new, "id").collect()) == [(1, "a", 1), (2, "b", 5), (3, "c", None)]
    assert sorted(r.id for r in K.insert_ignore(old, new.unionByName(new), ["id"]).collect()) == [3]
    how = {r.id: (r.target_order, r.matched_by) for r in K.two_key_match(
        spark.createDataFrame([(1, "q", "B"), (9, "A", "b"), (8, "zz", "b")], "id int, name string, brand string"),
        spark.createDataFrame([(1, "x", "y"), (2, "a", "B")], "id int, name string, brand string"), "id", "name", "brand", "id").collect()}
    assert how == {1: (1, "id"), 9: (2, "name_brand"), 8: (None, "insert")}


def test_rate_limit_windows_start_at_events(spark):
    df = spark.createDataFrame([("u", 0, 1), ("u", 50, 2), ("u", 99, 3), ("u", 100, 4), ("v", 70, 5)], "k string, t long, id int")
    got = {r.id: (r.window_count, r.allowed) for r in E.fixed_window_limit(df, "k", "t", "id", 100, 2).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (3, False), 4: (1, True), 5: (1, True)}


def test_rules(spark):
    df = spark.createDataFrame([(1, "It is loud. Not loud at all! It is loud.", "loud thing")], "id int, d string, n string")
    got = {(r.polarity, r.text, r.source) for r in T.evidence(df, "id", {"d": "d", "n": "n"}, [("loud", "loud", "not loud")]).collect()}
    assert got == {("positive", "It is loud.", "d"), ("negative", "Not loud at all!", "d"), ("positive", "loud thing", "n")}
    rules = [T.Rule("a", ("x",), {"t": 3}), T.Rule("b", ("x", "y"), {"t": 3})]
    src = {"t": F.col("t")}
    rows = T.classified(spark.createDataFrame([("x",), ("x y",), ("q",), (None,)], "t string"), src, rules, 3, "none").collect()
    assert [(r.kind, r.best) for r in rows] == [("a", 3), ("b", 6), ("none", 0), ("none", 0)]


def test_masks_round_trip(spark):
    t = 'see http://a.b/c and http://a.b/c/d, "https://x.y"'
    m = I.masked(F.lit(t))
    r = one(spark, m=m["text"], back=I.unmasked(m["text"], m["links"]))
    assert r.m == 'see {{0}} and {{1}} "{{2}}"' and r.back == t


def test_embedded_json(spark):
    t = 'x = 1; data = {"a": "}{", "b": {"c": "\\"}"}} ; tail {"z": 1}'
    r = one(spark, j=I.balanced_json(F.lit(t), "data ="), n=I.balanced_json(F.lit("data = {"), "data ="), none=I.balanced_json(F.lit("nothing"), "data ="))
    assert r.j == '{"a": "}{", "b": {"c": "\\"}"}}' and r.n is None and r.none is None
    g = one(spark, a=I.json_ld_nodes(F.lit('{"@graph": [{"x": 1}, {"y": 2}]}')), b=I.json_ld_nodes(F.lit('{"x": 1}')), c=I.json_ld_nodes(F.lit('[{"x": 1}]')))
    assert len(g.a) == 2 and g.b == ['{"x": 1}'] and len(g.c) == 1


def test_ingest_scalars(spark):
    s = lambda *v: F.array(*map(F.lit, v))
    r = one(
        spark,
        slug=I.slug(F.lit("  Foo & Bär 2! ")),
        sent=I.first_sentence(F.lit("One. Two.")),
        same=I.merged_hint(s("a", "a", None)),
        diff=I.merged_hint(s("a", "b")),
        none=I.merged_hint(F.array(F.lit(None).cast("string"))),
        gal=I.gallery(s("a", "b"), s("b", "c"), 2),
        tags=I.tags(F.lit("Tags: red, blue/red\nvery soft"), [("soft", "soft"), ("blue", "blue")]),
        name=I.display_name(F.lit("Acme  official Thing"), F.lit("ACME"), r"\bofficial\b"),
        dev=A.device_candidate(F.lit("USB motor (gift box)"), F.lit("x"), ("x",), "refill", r"\(.*?\)", "motor"),
        boost=A.boosted(F.lit(1), F.lit("k"), {"k": 2}),
        nob=A.boosted(F.lit(1), F.lit(None).cast("string"), {"k": 2}),
    )
    assert (r.slug, r.sent, r.same, r.diff, r.none, r.gal, r.name) == ("foo-bär-2", "One.", "a", "unisex", None, ["a", "b"], "Thing")
    assert r.tags == ["red", "blue", "soft"] and r.dev and (r.boost, r.nob) == (3, 1)


def test_tuning_folds():
    p = A.tuned(C.Preferences(budget=(100, 200), max_noise=40), ["cheaper", "quieter", "quieter", "nonsense"])
    assert p.budget == (0.0, 160.0) and p.max_noise == 20


def test_answer_path_aggregates_before_it_collects(spark):
    import random

    from talus.operators.events import answer_path

    rng = random.Random(3)
    rows = [(u, rng.choice([None, *range(30)]) if u % 3 else i, rng.choice([None, *range(9)])) for u in range(60) for i in range(rng.randrange(1, 25))]
    want = {}
    low = lambda v: -1 if v is None else v
    for u, _, s in sorted(rows, key=lambda r: (r[0], low(r[1]), low(r[2]))):
        want[u] = [x for x in want.get(u, []) if None not in (x, s) and x < s] + [s]
    got = answer_path(spark.createDataFrame(rows, "u int, o int, s int"), "u", "o", "s")
    assert {r.u: r.path for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    collected, below = plan.split("collect_list", 1)
    assert "max(" in below and "Aggregate [u" in below


def test_related_against_all_pairs(spark, monkeypatch):
    """Blocks, ragged, null, zero, tiny and not finite vectors, ties and repeated ids give what the plain join gives."""
    rng = random.Random(8)
    for name, n in (("ROWS", 7), ("QUERIES", 3), ("STRIPE", 2), ("PAIRS", 5), ("TAGS", 2)):
        monkeypatch.setattr(related, name, n)
    odd = [None, [], [0.0] * 4, [1.0, None, 2.0, 3.0], [float("nan"), 1.0, 1.0, 1.0], [float("inf"), 1.0, 1.0, 1.0], [1e-170] * 4, [1e-200, 0.0, 0.0, 0.0], [1.0, 2.0], [3e160] * 4]
    vecs = odd + [[float(rng.randint(-2, 2)) for _ in range(rng.choice((4, 4, 4, 5)))] for _ in range(90)]
    rows = [(i % 97, rng.choice((1, 2, None)) if i > 20 else 1, v, rng.choice((["a", "b", "a"], ["b", "c", None], [], None, list("defg"))), rng.choice((None, 0.0, 2.0))) for i, v in enumerate(vecs)]
    e = spark.createDataFrame(rows, "id long, g int, v array<double>, tags array<string>, plus double")
    got = related.related(e, "g", "id", "v", F.col("id") % 3 == 0, 4, 6, 100.0, "tags", 8.0, F.col("plus"))
    q = e.where("id % 3 = 0").select(F.col("id").alias("q"), "g", F.col("v").alias("qv"), F.col("tags").alias("qt"))
    empty = F.array().cast("array<string>")
    score = 100 * X.cosine(F.col("qv"), F.col("v")) + 8 * X.overlap(F.coalesce("qt", empty), F.coalesce("tags", empty)) + F.coalesce("plus", F.lit(0.0))
    s = q.join(e, "g").where("q <> id").select("q", F.col("id").alias("c"), F.round(score, 6).alias("score"))
    want = s.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))).where("rank <= 4")
    plain = lambda df: sorted(repr((r.q, r.rank, r.c, r.score + 0.0)) for r in df.collect())
    assert plain(got.withColumn("score", F.round("score", 6))) == plain(want) and want.count() > 90
    one_row = related.related(e.where("id = 0 AND v IS NULL"), "g", "id", "v", F.lit(True), 3, 9)
    assert one_row.collect() == [] and related.related(e.limit(0), "g", "id", "v", F.lit(True), 3, 9).collect() == []
    count = [[sum(t in (b or ()) for t in a or () if t is not None) for b in (["a"], list("bcd"), None)] for a in (list("aba"), list("dcbb"), [None], None)]
    assert related.overlaps([list("aba"), list("dcbb"), [None], None], [["a"], list("bcd"), None]).tolist() == count
    assert related.half_up(np.array([0.0009765625, -0.0009765625, 2.5e-7]), 9).tolist() == [0.000976563, -0.000976563, 2.5e-7]
